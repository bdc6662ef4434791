"""Encoders: bounded vocabularies, words outside them, mutual information; lexicons of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctopics.functions.tokens import map_tokens
from doctopics.operators import encoders
from doctopics.operators import embeddings as emb


@pytest.fixture(scope="module")
def topics(spark):
    """Two topics with words of their own, some seen once."""
    rng = np.random.default_rng(3)
    words = [[f"alpha{k}" for k in range(12)], [f"omega{k}" for k in range(12)]]
    rows = []
    for i in range(160):
        text = list(rng.choice(words[i % 2], 12))
        text += [f"{words[i % 2][0][:5]}rare{i}"]
        rows.append((i, i % 2, [str(w) for w in text]))
    return spark.createDataFrame(rows, "doc_id long, topic int, tokens array<string>").persist()


def unit(v):
    return np.array(v) / np.linalg.norm(v)


@pytest.mark.parametrize("fit", [encoders.fit_word2vec, encoders.fit_pmi])
def test_every_word_and_document_has_a_vector(spark, topics, fit):
    vectors = fit(topics, size=8, min_count=2)
    assert sorted(vectors.terms) == sorted(f"{p}{k}" for p in ("alpha", "omega") for k in range(12))
    docs = vectors.embed(topics).collect()
    assert all(len(r["embedding"]) == 8 and np.linalg.norm(r["embedding"]) > 0 for r in docs)
    odd = spark.createDataFrame([(["alpharare7", "alpharare9"],), (["日本"],), ([],), (None,)], "tokens array<string>")
    rare, foreign, empty, missing = [r["embedding"] for r in vectors.embed(odd).collect()]
    assert np.linalg.norm(rare) > 0 and np.linalg.norm(foreign) > 0 and not any(empty) and not any(missing)
    # a word that was not trained lies with the words it shares letters with
    same = [unit(v) @ unit(rare) for t, v in zip(vectors.terms, vectors.matrix) if t.startswith("alpha")]
    other = [unit(v) @ unit(rare) for t, v in zip(vectors.terms, vectors.matrix) if t.startswith("omega")]
    assert np.mean(same) > np.mean(other)


def test_pmi_separates_topics(topics):
    vectors = encoders.fit_pmi(topics, size=4)
    rows = vectors.embed(topics).collect()
    x = np.array([unit(r["embedding"]) for r in rows])
    means = [unit(x[[r["topic"] == t for r in rows]].mean(0)) for t in (0, 1)]
    right = [int(np.argmax([v @ m for m in means])) == r["topic"] for v, r in zip(x, rows)]
    assert np.mean(right) >= 0.99


def test_vocabulary_is_filled_at_the_bound(spark):
    """Of words tied at the bound the first terms stay; none goes because another one ties."""
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"] * 3 + ["f"] * 9 + ["x"],)], "tokens array<string>")
    assert encoders.bounded_vocabulary(df, "tokens", 2, 4) == (["f", "a", "b", "c"], True)
    assert encoders.bounded_vocabulary(df, "tokens", 2, 6) == (["f", "a", "b", "c", "d", "e"], False)
    vectors = encoders.fit_word2vec(df, size=4, max_vocabulary=4, max_iter=1)
    assert sorted(vectors.terms) == ["a", "b", "c", "f"]
    assert np.linalg.norm(vectors.embed(spark.createDataFrame([(["e"],)], "tokens array<string>")).first()["embedding"]) > 0
    nothing = df.limit(0)
    for fit in (encoders.fit_word2vec, encoders.fit_pmi):
        assert fit(nothing, size=4).embed(df).first()["embedding"] != [0.0] * 4


def test_document_is_mean_of_its_words(spark, topics, monkeypatch):
    vectors = encoders.fit_word2vec(topics, size=6, max_iter=1)
    long = [["alpha1", "omega2", "new", None, "alpha1"] * 50, ["omega3"], [], ["new"] * 7]
    df = spark.createDataFrame([(t,) for t in long], "tokens array<string>")
    at = dict(zip(vectors.terms, vectors.matrix))

    def mean(words):
        return np.mean([at[w] if w in at else vectors.unseen(w or "") for w in words], axis=0) if words else np.zeros(6)

    got = [r["embedding"] for r in vectors.embed(df).collect()]
    assert np.allclose(got, [mean(t) for t in long])


def test_cooccurrences(spark):
    tokens = [["a", "b", "x", "a"], ["b"], [], None, ["a", "a"]]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in encoders.cooccurrences(df, ["a", "b"], window=2).collect()}
    expected = {}
    for words in tokens:
        for i, u in enumerate(words or []):
            for j, v in enumerate(words):
                if i != j and abs(i - j) <= 2 and {u, v} <= {"a", "b"}:
                    key = ("ab".index(u), "ab".index(v))
                    expected[key] = expected.get(key, 0) + 1
    assert got == expected


@pytest.mark.parametrize("slice_tokens, held", [(3, 4), (1, 1), (7, 10**6)])
def test_cooccurrences_by_slices(spark, monkeypatch, slice_tokens, held):
    """However short the slices and however few pairs a task holds, all pairs within a text are counted."""
    rng = np.random.default_rng(3)
    tokens = [list(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 9, 30)] + [["a"] * 8]
    df = spark.createDataFrame([([str(w) for w in t],) for t in tokens], "tokens array<string>").coalesce(1)
    monkeypatch.setattr(encoders, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(encoders, "HELD_PAIRS", held)
    got = {(r["a"], r["b"]): r["n"] for r in encoders.cooccurrences(df, ["a", "b", "c"], window=3).collect()}
    expected = {}
    for words in tokens:
        for i, u in enumerate(words):
            for j, v in enumerate(words):
                if i != j and abs(i - j) <= 3 and {u, v} <= set("abc"):
                    key = ("abc".index(u), "abc".index(v))
                    expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_long_rows_of_the_matrix_are_cut(spark, monkeypatch):
    """A row of the matrix may hold the whole vocabulary; tasks get it in short pieces and add up their products."""
    written, write = [], encoders.materialise
    monkeypatch.setattr(encoders, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(encoders, "ROW_CELLS", 4)
    m = np.random.default_rng(6).normal(size=(15, 15))
    m = m + m.T
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(15) for j in range(15)], "a int, b int, x double")
    values, vectors = encoders.symmetric_directions(cells, 15, 3, rounds=60)
    assert written[0].agg(F.max(F.size("b"))).first()[0] == 4
    exact = np.linalg.eigvalsh(m)
    assert np.allclose(values, exact[np.argsort(-np.abs(exact))][:3], atol=1e-5) and np.allclose(m @ vectors, vectors * values, atol=1e-4)


def test_trigrams_of_many_words_at_once():
    words = ["", "a", "é", "häuser", "日本語", "x😀y", "abc_1", "a" * 40, ""]
    flat, sizes = encoders.word_buckets(words)
    each = [encoders.subword_buckets(w) for w in words]
    assert sizes.tolist() == [len(x) for x in each] and flat.tolist() == sum(each, [])


@pytest.mark.parametrize("broadcast", [0, 2, 100])
def test_word_sums(spark, broadcast):
    """Sums of word vectors are added up where the words stand; a word's row never meets a document's cells one by one."""
    from doctopics.plans.check_queries import _word_sums

    docs = [(1, ["a", "b", "a"]), (2, ["c"]), (2, ["a", "d"]), (None, ["b", "b"]), (3, []), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    vectors = {"a": [1.0, 2.0], "b": [10.0, 20.0], "c": [100.0, 200.0], "d": [0.5, 0.25]}
    words = spark.createDataFrame([(t, n, vectors[t]) for t, n in zip("abcd", (3, 3, 1, 1))], "term string, n long, v array<double>")
    got = {r["doc_id"]: (r["v_0"], r["v_1"]) for r in _word_sums(df, words, ["v"], 2, broadcast).collect()}
    assert got == {1: (12.0, 24.0), 2: (101.5, 202.25), None: (20.0, 40.0)}


def test_directions(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 30)) * (rng.random((30, 30)) < 0.3)
    m = m + m.T
    cells = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    values, vectors = encoders.symmetric_directions(spark.createDataFrame(cells, "a int, b int, x double"), 30, 4, rounds=60)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-4)
    exact = np.linalg.eigvalsh(m)
    assert np.allclose(values, exact[np.argsort(-np.abs(exact))][:4], atol=1e-5)


def test_both_encoders_are_named(topics):
    docs, words = emb.embed_pmi(topics, size=4)
    assert docs.columns == [*topics.columns, "embedding"] and words.columns == ["term", "vector"] and words.count() == 24


@pytest.mark.parametrize("shipped", [100, 3, 1])
def test_lexicon_of_any_size(spark, shipped):
    """Looked up in the row or joined: repeated forms, repeated and null ids, null tokens, unknown words."""
    rows = [(1, ["a", "b"]), (1, ["a"]), (None, ["c", "a", "c"]), (None, []), (2, None), (3, ["z", None, "a"]), (1, ["a", "b"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "a"), ("c", "k"), ("d", "m"), ("e", None), (None, "n"), ("a", "y")], "form string, lemma string")
    got = sorted([(r["doc_id"], r["tokens"]) for r in map_tokens(df, lexicon, max_shipped=shipped).collect()], key=repr)
    lemma = {"a": "x", "b": "a", "c": "k", "d": "m"}
    assert got == sorted([(d, [lemma.get(w, w) for w in t or []]) for d, t in rows], key=repr)


def test_numbers_of_rows(spark):
    assert map_tokens(spark.createDataFrame([], "doc_id long, tokens array<string>"), spark.createDataFrame([("a", "b")], "form string, lemma string"), max_shipped=0).count() == 0
    many = spark.range(50).select(F.lit(7).alias("doc_id"), F.array(F.lit("a"), F.lit("q")).alias("tokens"))
    out = map_tokens(many, spark.createDataFrame([("a", "b")], "form string, lemma string"), max_shipped=0)
    assert out.count() == 50 and {tuple(r["tokens"]) for r in out.collect()} == {("b", "q")}


def test_pmi_cells_keeps_no_raw_words_in_the_cache(spark, monkeypatch):
    """The words are read back from a written table, so a task reads their compressed columns."""
    from doctopics.plans import vector_queries

    written, write = [], vector_queries.materialise
    monkeypatch.setattr(vector_queries, "materialise", lambda df, name: written.append(name) or write(df, name))
    assert vector_queries.pmi_cells(spark, "/root/testdata/sf0.001").count() > 0
    assert written == ["tokens", "pairs"]


def test_documents_are_embedded_once(spark):
    from doctopics.plans import vector_queries

    rows = vector_queries.embed_documents(spark, "/root/testdata/sf0.001")
    assert str(rows._jdf.queryExecution().executedPlan().toString()).count("encode(") == 1
    assert rows.filter("pos IS NULL OR x IS NULL").count() == 0
