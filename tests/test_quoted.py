"""Quoted CSV in byte ranges: the same rows as Spark's reader of whole files, in many tasks."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from doctopics.sources import labelled
from doctopics.sources.quoted import quoted_records, read_quoted_csv

SCHEMA = "`Class Index` int, Title string, Description string"


@pytest.fixture()
def small_ranges(spark):
    """Files are cut into ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write(path, rows, encoding="utf-8", newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["Class Index", "Title", "Description"])
        out.writerows(rows)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = ["plain", 'a "quoted" word', "comma, here", "line\nbreak", "\n\n", '"', "é", "", "x" * 50, '",\n"', "tail \n"]
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 8)))) for k in range(n)]


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_same_rows_as_the_whole_file_reader(spark, small_ranges, tmp_path, encoding):
    rows = rows_of(3) + [(1000, "long", "one\n" * 2000), (1001, "after", "it")]
    write(tmp_path / "a.csv", rows, encoding)
    write(tmp_path / "b.csv", rows_of(4, 30), encoding)
    out = read_quoted_csv(spark, str(tmp_path), SCHEMA, encoding, place_col="place")
    whole = spark.read.schema(SCHEMA).options(**labelled.CSV_OPTIONS).option("encoding", encoding).option("multiLine", True).csv(str(tmp_path))
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, x) for x in r)
    got = sorted([tuple(r)[:3] for r in out.collect()], key=key)
    assert got == sorted([tuple(r) for r in whole.collect()], key=key) and len(got) == len(rows) + 30
    assert quoted_records(spark, str(tmp_path / "a.csv"), encoding).select("block").distinct().count() > 20
    first = out.filter(F.col("place.file").endswith("a.csv")).orderBy("place").select("Class Index").collect()
    assert [r[0] for r in first] == [r[0] for r in rows]


def test_line_ends_and_odd_files(spark, small_ranges, tmp_path):
    write(tmp_path / "crlf.csv", [(1, "a", "b\r\nc"), (2, 'say "x"', "")], newline="\r\n")
    assert sorted(tuple(r) for r in read_quoted_csv(spark, str(tmp_path / "crlf.csv"), SCHEMA).collect()) == [(1, "a", "b\r\nc"), (2, 'say "x"', None)]
    (tmp_path / "blank.csv").write_text('Class Index,Title,Description\n\n1,"a",b\n\n\n2,c,"d\n\ne"')
    assert sorted(tuple(r) for r in read_quoted_csv(spark, str(tmp_path / "blank.csv"), SCHEMA).collect()) == [(1, "a", "b"), (2, "c", "d\n\ne")]
    for name, text in (("empty.csv", ""), ("header.csv", "Class Index,Title,Description\n")):
        (tmp_path / name).write_text(text)
        assert read_quoted_csv(spark, str(tmp_path / name), SCHEMA).count() == 0


def test_one_file_in_many_tasks(spark, tmp_path):
    """A file of some 40 MB whose records span lines."""
    rows = [(k, f"title {k}", f"first line {k}\nsecond, \"line\" " + "word " * 60) for k in range(110_000)]
    write(tmp_path / "big.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        out = read_quoted_csv(spark, str(tmp_path / "big.csv"), SCHEMA)
        assert quoted_records(spark, str(tmp_path / "big.csv")).select("block").distinct().count() >= 15
        found = out.agg(F.count("*"), F.countDistinct("Class Index"), F.sum("Class Index"), F.min(F.length("Description"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(found) == (110_000, 110_000, sum(range(110_000)), min(len(d) for _, _, d in rows))
