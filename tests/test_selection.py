"""Splits, folds, labels and sources against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from doctopics.sources import labelled, selection


@pytest.fixture(scope="module")
def skewed(spark):
    """One label holds most rows."""
    rows = [(i, "big" if i % 10 < 7 else f"s{i % 3}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, labels string").repartition(7), rows


def expected_train(rows, want):
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append((hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
    return {i for label, g in groups.items() for _, i in sorted(g)[: want[label] if isinstance(want, dict) else want(len(g))]}


def test_stratified_fraction(skewed):
    df, rows = skewed
    out = selection.stratified_split(df)
    train = {r["doc_id"] for r in out.filter("split = 'train'").collect()}
    assert train == expected_train(rows, lambda n: math.floor(n * 0.8 + 0.5))
    assert out.count() == len(rows)


@pytest.mark.parametrize("fraction", [0.0, 1.0])
def test_stratified_edges(skewed, fraction):
    df, rows = skewed
    out = selection.stratified_split(df, train_fraction=fraction)
    assert out.filter("split = 'train'").count() == fraction * len(rows)
    assert out.count() == len(rows)


def test_stratified_size(skewed):
    df, rows = skewed
    assert selection.stratified_split(df, train_size=1000).filter("split = 'train'").count() == 1000


@pytest.mark.parametrize("k", [2, 3, 7])
def test_kfold(spark, k):
    ids = [i * i * 37 - 10**12 for i in range(1000)] + [2**62, -(2**62)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    got = {r["doc_id"]: r["fold"] for r in selection.kfold(df, k).collect()}
    n, want, at = len(ids), {}, 0
    for fold in range(k):
        size = n // k + (1 if fold < n % k else 0)
        want.update({i: fold for i in sorted(ids)[at : at + size]})
        at += size
    assert got == want


def test_cut_points_with_copies(spark):
    values = [5] * 400 + [7] * 100 + [9] * 3
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert selection.cut_points(df, "v", [0, 399, 400, 502]) == [5, 5, 7, 9]


def test_labels(spark):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, None), (4, "2.0")], "doc_id long, labels string")
    rows = selection.label_to_zero_based(df).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["label0"]) for r in rows] == [(1, 2), (4, 1)]
    ids = spark.createDataFrame([(1,), (4,), (9,)], "i int")
    assert [r[0] for r in ids.select(selection.label_lookup(F.col("i"))).collect()] == ["World", "Science/Tech", None]
    names = spark.createDataFrame([("Sports",), ("?",)], "n string")
    assert [r[0] for r in names.select(selection.label_reverse_lookup(F.col("n"))).collect()] == [2, None]


def test_cache_is_written_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("train", ""), ("test", None)], "split string, title string")

    for _ in range(2):
        df = labelled.cleaned_cache(spark, str(tmp_path / "news"), build)
    assert len(calls) == 1
    assert {(r["split"], r["title"]) for r in df.collect()} == {("train", ""), ("test", None)}


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "q", b', "line\nbreak é ☃"), (2, "", None), (3, " lead ", "back\\slash")]
    df = spark.createDataFrame(rows, labelled.NEWS_SCHEMA)
    labelled.write_csv(df, str(tmp_path / "c"))
    got = labelled.read_labelled_csv(spark, str(tmp_path / "c"), encoding="UTF-8").orderBy("labels").collect()
    # CSV has no way to tell an empty text from a missing one; both come back as null.
    assert [tuple(r) for r in got] == [(a, b or None, c) for a, b, c in rows]
