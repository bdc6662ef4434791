"""Archives by an exact round trip."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from doctopics.llm.q_pages import op10_warc
from doctopics.llm.warc import archive_pages, inflate, normalise_archives, read_archives, split_records, write_archives


def brute(rows):
    groups = defaultdict(list)
    for i, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        last = max(ids) if ids and len(groups[html or ""]) > 1 else None
        refers = last if last is not None and i != last else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert result(op10_warc(spark, sf_dir)) == brute(rows)


ROWS = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, None, "same"), (4, "v", None), (5, "v", ""), (None, "w", "same"), (None, "w", "alone")]
ROWS += [(6, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n"), (7, "é", "é\n\r\n\r\n\u0000\U0001f642"), (8, "y", "z" * 3_000_000), (-9, "n", "neg")]
ROWS += [(10, "d", "dup"), (10, "d", "dup"), (11, "big", "".join(f"{k}<p>" for k in range(400_000)))]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, archive string")


def test_edges(spark):
    assert result(archive_pages(pages(spark), file_records=3)) == brute([(i, h) for i, _, h in ROWS])
    assert archive_pages(pages(spark, [])).count() == 0


def test_streams_are_bounded_by_bytes(spark, tmp_path):
    """Pages of different sizes go into streams of their own, and none holds more than its bytes."""
    rows = [(k, f"u{k}", f"{k}-" * 10) for k in range(30)] + [(100 + k, "v", f"{k}" * 70_000) for k in range(8)] + [(200, "w", "x" * (1 << 20))]
    write_archives(pages(spark, rows), f"{tmp_path}/in", file_bytes=1 << 21)
    sizes = [[len(r) for _, r in split_records(inflate(p.read_bytes()))] for p in sorted((tmp_path / "in").rglob("*.gz"))]
    assert sum(map(len, sizes)) == len(rows) and all(sum(x) < (1 << 21) + 1000 * len(x) for x in sizes)
    assert not any(min(x) < 1 << 16 <= max(x) for x in sizes)
    archives = normalise_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert archives.count() == len(sizes)
    back = read_archives(archives, f"{tmp_path}/out")
    assert {r["page_id"] for r in back.collect()} == {r[0] for r in rows}


def test_read_back_in_as_many_tasks_as_archives(spark, tmp_path):
    rows = [(k, "u", f"page {k}") for k in range(400)]
    write_archives(pages(spark, rows), f"{tmp_path}/in", file_records=5)
    archives = normalise_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    back = read_archives(archives, f"{tmp_path}/out").withColumn("task", F.spark_partition_id())
    of = back.groupBy("archive").agg(F.max("task").alias("task")).collect()
    assert back.rdd.getNumPartitions() == archives.count() >= 80
    assert max(Counter(r["task"] for r in of).values()) <= 0.1 * len(of)


def test_smaller_payloads_are_responses(spark):
    kinds = {r["page_id"]: r["record_type"] for r in archive_pages(pages(spark), min_bytes=4).collect()}
    assert kinds[1] == kinds[2] == "revisit" and kinds[3] == kinds[4] == kinds[5] == "response"


def test_normalised_files(spark, tmp_path):
    write_archives(pages(spark), f"{tmp_path}/in", file_records=2)
    archives = normalise_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert archives.count() > 1 and sum(r["records"] for r in archives.collect()) == len(ROWS)
    plain_in, plain_out = Counter(), Counter()
    for path in (tmp_path / "in").rglob("*.gz"):
        plain_in.update(r for _, r in split_records([gzip.decompress(path.read_bytes())]))
    for name in os.listdir(tmp_path / "out"):
        if name.endswith(".warc.gz"):
            data = (tmp_path / "out" / name).read_bytes()
            places = [json.loads(x) for x in (tmp_path / "out" / name.replace(".warc.gz", ".index.jsonl")).read_text().splitlines()]
            assert [p["offset"] for p in places] == [sum(q["length"] for q in places[:k]) for k in range(len(places))]
            for p in places:  # a member can be opened alone
                one = gzip.GzipFile(fileobj=io.BytesIO(data[p["offset"] : p["offset"] + p["length"]])).read()
                assert len(list(split_records([one]))) == 1
                plain_out[one] += 1
    assert plain_in == plain_out
    again = normalise_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert read_archives(again, f"{tmp_path}/out").count() == len(ROWS)


def test_broken_streams():
    good = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" * 3)
    assert len(list(split_records(inflate(good + good)))) == 6
    for bad in (good[:-12], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises(ValueError):
            list(split_records(inflate(bad)))
