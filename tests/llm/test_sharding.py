"""Shards against plain sorting."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from doctopics.llm.q_text import op6_sharding
from doctopics.llm.sharding import stratified_shards


def brute(rows, shards=24, seed="42"):
    """(doc_id, size, crc, shard, slot) of ``(doc_id, text, source)`` rows."""
    by = defaultdict(list)
    for d, t, s in rows:
        data = (t or "").encode()
        crc = zlib.crc32(data)
        key = int(hashlib.md5(f"{seed}-{'null' if d is None else d}-{crc}".encode()).hexdigest()[:13], 16)
        by["none" if s is None else "=" + s].append((key, d is not None, d or 0, crc, len(data) + 8))
    order = []
    for s, own in by.items():
        own.sort()
        order += [((2 * k + 1) / (2 * len(own)), s, *x) for k, x in enumerate(own)]
    order.sort()
    n, out, slots = len(order), [], Counter()
    for p, (_, _, _, known, d, crc, size) in enumerate(order):
        shard = p * shards // n
        out.append((d if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = op6_sharding(spark, sf_dir)
    assert result(out) == brute(rows)
    sizes = Counter(r["shard"] for r in out.collect())
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    assert out.filter("law <> 'rows' OR grown_shard IS NOT NULL").count() == 0


def test_mixture_and_edges(docs_of):
    rows = [(k, f"t{k}") for k in range(900)] + [(None, None), (5, ""), (7, "t7"), (7, "t7"), (1000, "é" * 10_000)]
    df = docs_of(rows, shard=("int", [1] * len(rows)), _source=("int", [1] * len(rows))).drop("source")
    df = df.selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 50 = 1 THEN NULL ELSE concat('s', doc_id % 4) END AS source")
    plain = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = stratified_shards(df, 10)
    assert result(got) == brute(plain, 10)
    source = {r[0]: r[2] for r in plain}
    hot = Counter(r["shard"] for r in got.collect() if source[r["doc_id"]] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    assert stratified_shards(docs_of([])).count() == 0
    assert sorted(r["shard"] for r in stratified_shards(docs_of(rows[:3])).collect()) == [0, 8, 16]
