"""Decontamination against SQL and brute force."""

from __future__ import annotations

import hashlib
import re

import pytest

from doctopics.llm.decontaminate import contamination, drop_contaminated
from doctopics.llm.q_text import OP3_SQL, op3_decontamination
from tests.harness import difference, duck


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_matches_sql(spark, sf_dir):
    got = op3_decontamination(spark, sf_dir).toPandas()
    assert got["contaminated"].any() and not got["contaminated"].all()
    assert difference(got, duck(sf_dir).sql(OP3_SQL).df()) is None


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, " .,"), (5, "rare"), (2, "again other")]
ITEMS += [(None, "no id here"), (10, "one TWO three four five six seven eight nine ten"), (11, "É é ñ x0 y1 z2 a b a b a b a b"), (12, "never seen at all")]
LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, LONG), (2, "x " + LONG.upper().replace(" ", "--") + " y"), (3, "one two three four five six seven eight nine"), (4, None), (5, "")]
DOCS += [(None, "a short item, short. item"), (6, "rare rare"), (7, "É é ñ x0 y1 z2 a b a b a b a b a b"), (7, "É é ñ x0 y1 z2 a b a b a b a b a b"), (8, "é é ñ x0 y1 z2 a b a b")]
DOCS += [(9, "no id here"), (10, "two three four five six seven eight nine ten eleven " * 3), (11, "word " * 50_000 + "short item"), (12, "ten eleven twelve")]


@pytest.mark.parametrize("block", [200_000, 3])
@pytest.mark.parametrize("window", [2, 10])
def test_edges(spark, docs_of, window, block):
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, gram int")
    docs = docs_of(DOCS, anchor=("int", [1] * len(DOCS)), n_words=("string", ["a"] * len(DOCS)), item_id=("int", [1] * len(DOCS)))
    assert result(contamination(docs, items, window, block)) == brute(DOCS, ITEMS, window)


def test_empty_tables_and_dropping(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(DOCS, _bad=("int", [1] * len(DOCS)))
    assert result(contamination(docs, items.limit(0))) == brute(DOCS, [])
    assert contamination(docs_of([]), items).count() == 0
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in DOCS if d not in bad)


def test_passage_in_many_documents(spark, docs_of):
    items = spark.createDataFrame([(k, f"i{k} " + LONG) for k in range(20)], "item_id long, text string")
    docs = [(k, f"a{k} b{k} i{k % 30} {LONG} c{k}") for k in range(300)]
    assert result(contamination(docs_of(docs), items)) == brute(docs, [(k, f"i{k} " + LONG) for k in range(20)])
