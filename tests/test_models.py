"""Invariants of trained models on data with a known answer."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doctopics.operators import comparison as cmp
from doctopics.operators import describe, evaluation, factor, lda, supervised, terms, topic_jobs
from doctopics.operators import embeddings as emb
from doctopics.operators.coherence import coherence_cv


@pytest.fixture(scope="module")
def blocks(spark):
    """Four classes with disjoint vocabularies of 12 words."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        c = i % 4
        words = [f"w{c}x{j}" for j in rng.integers(0, 12, size=25)]
        rows.append((i, c + 1, "train" if i < 180 else "test", words))
    return spark.createDataFrame(rows, "doc_id long, labels int, split string, tokens array<string>").persist()


@pytest.fixture(scope="module")
def vectors(blocks):
    fitted = terms.fit_vectorizer(blocks, 48)
    return fitted, fitted.tfidf(blocks).persist()


def dense(vectors):
    rows = vectors.orderBy("doc_id").select(F.unwrap_udt("features").alias("v")).collect()
    out = np.zeros((len(rows), 48))
    for i, r in enumerate(rows):
        out[i, r["v"]["indices"]] = r["v"]["values"]
    return out


def test_lda(spark, blocks):
    corpus = lda.prepare_corpus(blocks, 48)
    model = lda.lda_fit(corpus.bow_train, corpus.vectorizer, 4, 60)
    sums = model.topic_terms(spark).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in sums)
    dist = lda.doc_topic_dist(model, corpus.bow_test).select("distribution").collect()
    assert all(abs(sum(r[0]) - 1) < 1e-6 for r in dist)
    assert lda.lda_perplexity(model, corpus.bow_test) > 1
    again = lda.lda_fit(corpus.bow_train, corpus.vectorizer, 4, 60)
    assert np.allclose(model.model.topicsMatrix().toArray(), again.model.topicsMatrix().toArray())
    _, alignment, accuracy = lda.evaluate_against_labels(model, corpus.bow_test, (1, 2, 3, 4))
    assert accuracy.first()["Aligned_Accuracy"] >= 0.7
    assert alignment.count() <= 4


def test_nmf(spark, vectors, blocks):
    fitted, df = vectors
    model = factor.nmf_fit(df, 4, fitted.size, max_iter=100)
    assert (model.h >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(model.objective, model.objective[1:]))
    scored = model.transform(df).orderBy("doc_id").select("labels", "scores").collect()
    w = np.array([r["scores"] for r in scored])
    x = dense(df)
    assert (w >= 0).all()
    assert abs(0.5 * ((x - w @ model.h) ** 2).sum() - model.objective[-1]) <= 0.05 * model.objective[0]
    topics = w.argmax(axis=1)
    assert len({(r["labels"], t) for r, t in zip(scored, topics)}) == 4


def test_lsa_and_pca(vectors):
    _, df = vectors
    x = dense(df)
    svd = factor.lsa_fit(df, 6)
    assert np.allclose(svd.directions.T @ svd.directions, np.eye(6), atol=1e-8)
    assert np.allclose(svd.strengths, np.linalg.svd(x, compute_uv=False)[:6])
    scores = np.array([r[0] for r in svd.transform(df).orderBy("doc_id").select("scores").collect()])
    assert np.allclose(np.abs(scores), np.abs(x @ svd.directions), atol=1e-9)
    assert np.allclose(svd.head(3).directions, svd.directions[:, :3])
    pca = factor.pca_fit(df, 4)
    scores = np.array([r[0] for r in pca.transform(df).orderBy("doc_id").select("scores").collect()])
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-9)
    cov = np.cov(scores.T)
    assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-8)
    assert np.allclose(np.diag(cov), pca.strengths)


def test_classifiers_beat_majority(blocks):
    results = supervised.experiment_bow_tfidf(blocks, bow_features=(48,), tfidf_features=(48,)).collect()
    assert len(results) == 16
    assert all(r["Accuracy"] > 0.9 for r in results)


def test_experiment_shapes(blocks):
    nmf = supervised.experiment_nmf(blocks, components=(4,), max_features=48, max_iter=30)
    assert {r["Classifier"] for r in nmf.collect()} == {"Logistic Regression", "Random Forest", "Linear SVC", "Naive Bayes"}
    lsa = supervised.experiment_lsa(blocks, max_features=(48,), components=(3, 6))
    assert lsa.count() == 8
    topics, report = supervised.experiment_pca(blocks, max_features=48)
    assert topics.count() == 40
    assert report.filter("class = 'accuracy' AND f1 > 0.9").count() == 4


def brute_windows(docs, a, b, size):
    total = hits = 0
    for words in docs:
        for start in range(max(1, len(words) - size + 1)):
            window = words[start : start + size]
            total += 1
            hits += a in window and b in window
    return hits, total


def test_coherence_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [[f"t{j}" for j in rng.integers(0, 9, size=n)] for n in (0, 1, 4, 5, 6, 30, 41)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    topic = ["t0", "t1", "t2"]
    words = spark.createDataFrame([(0, t) for t in topic], "topic int, term string")
    got = coherence_cv(df, words, window=5).first()["coherence"]
    p = np.zeros((3, 3))
    for i, a in enumerate(topic):
        for j, b in enumerate(topic):
            hits, total = brute_windows(docs, a, b, 5)
            p[i, j] = hits / total
    single = np.diag(p)
    npmi = np.log((p + 1e-12) / np.outer(single, single)) / -np.log(p + 1e-12)
    s = npmi.sum(axis=0)
    want = np.mean([v @ s / np.linalg.norm(v) / np.linalg.norm(s) for v in npmi])
    assert got == pytest.approx(want, abs=1e-9)


def test_coherence_bounds(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c"]) for i in range(10)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(0, "a"), (0, "b")], "topic int, term string")
    assert coherence_cv(df, words).first()["coherence"] == pytest.approx(1.0)
    assert coherence_cv(df.limit(0), words).first()["coherence"] is None


# ---------------------------------------------------------------- vectors and topics


def test_nearest_topic_handles_missing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    cent = spark.createDataFrame([(0, 5, [0.0, 1.0]), (7, 5, [1.0, 0.0])], "topic int, size long, vector array<double>")
    rows = emb.assign_to_nearest_topic(df, cent).orderBy("vec_id").collect()
    assert [(r["topic"], round(r["score"], 9)) for r in rows] == [(7, 1.0), (-1, 0.0), (0, 1.0)]
    none = emb.assign_to_nearest_topic(df, cent.limit(0)).collect()
    assert {(r["topic"], r["score"]) for r in none} == {(-1, 0.0)}


def test_merge_smallest():
    vectors = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0, 0.1, 1.0]])
    assert describe.merge_smallest(vectors @ vectors.T, [10, 2, 30, 20], 3) == [[2], [3], [0, 1]]
    assert describe.merge_smallest(vectors @ vectors.T, [10, 2, 30, 20], 9) == [[2], [3], [0], [1]]


def test_topic_gram(spark):
    rows = [(0, "a", 1.0), (0, "b", 2.0), (1, "b", 3.0), (2, "c", 1.0)]
    df = spark.createDataFrame(rows, "topic int, term string, weight double")
    assert np.allclose(describe.topic_gram(df, [0, 1, 2]), [[5, 6, 0], [6, 9, 0], [0, 0, 1]])


def test_kmeans_elbow(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(3)[i % 3] * 10 + rng.normal(0, 0.1, 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    curve = emb.kmeans_elbow(df, max_k=5, restarts=3)
    assert emb.elbow_point(curve).first()["best_silhouette_k"] == 3
    sse = [r["sse"] for r in curve.orderBy("k").collect()]
    assert sse == sorted(sse, reverse=True)


def test_encoder_hook(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    out = emb.embed_with(df, lambda texts: np.array([[len(t), 1.0] for t in texts])).orderBy("text").collect()
    assert [r["embedding"] for r in out] == [[2.0, 1.0], [4.0, 1.0]]


def test_topic_jobs(spark, blocks):
    docs, words = emb.embed_word2vec(blocks.withColumn("label0", F.col("labels") - 1), size=16, max_iter=5)
    docs = docs.persist()
    job = topic_jobs.bertopic_job(docs)
    assert {r["split"] for r in job.assignments.select("split").distinct().collect()} == {"train", "test"}
    assert job.assignments.count() == 240
    assert job.topics.select("topic").distinct().count() <= 5
    second = topic_jobs.top2vec_job(docs, words)
    assert second.assignments.count() == 240
    assert second.metrics.count() == 2


# ---------------------------------------------------------------- evaluation


@pytest.mark.parametrize("shift", [0, 1])
def test_perfect_assignment(spark, shift):
    rows = [(i, i % 4, (i + shift) % 4) for i in range(12)]
    counts = evaluation.contingency(spark.createDataFrame(rows, "doc_id long, label0 int, topic int"))
    assert [round(x, 9) for x in evaluation.clustering_scores(counts).first()] == [1.0] * 5
    assert evaluation.aligned_accuracy(counts, evaluation.align_topics(counts)).first()["Aligned_Accuracy"] == 1.0


def test_degenerate_scores(spark):
    one = spark.createDataFrame([(i, 0, 0) for i in range(5)], "doc_id long, label0 int, topic int")
    assert list(evaluation.clustering_scores(evaluation.contingency(one)).first()) == [1.0] * 5
    assert evaluation.clustering_scores(evaluation.contingency(one.limit(0)), []).collect() is not None


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for rows, cols in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        for _ in range(20):
            gain = rng.integers(0, 20, size=(rows, cols)).astype(float)
            got = sum(gain[r, c] for r, c in evaluation.best_assignment(gain))
            wide = gain if rows <= cols else gain.T
            want = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
            assert got == want


def test_votes(spark):
    rows = [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1), (3, 2, 2), (3, 3, 2)]
    df = spark.createDataFrame(rows, "doc_id long, model_order int, topic int")
    got = {r["doc_id"]: r["topic"] for r in cmp.ensemble_vote(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert cmp.ensemble_vote(df.filter("model_order = 1")).count() == 0


def test_aligned_vote(spark):
    rows = [(i, i % 3, m, o, (i + o) % 3) for i in range(30) for o, m in enumerate(["a", "b"], 1)]
    df = spark.createDataFrame(rows, "doc_id long, label0 int, model string, model_order int, topic int")
    got = {r["doc_id"]: r["topic"] for r in cmp.ensemble_vote_aligned(df).collect()}
    assert got == {i: i % 3 for i in range(30)}


def test_diversity_and_bands(spark):
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "topic int, term string")
    assert evaluation.topic_diversity(words).first()["Diversity"] == 0.75
    assert evaluation.topic_diversity(words.limit(0)).first()["Diversity"] == 0.0
    scores = spark.createDataFrame([(0.81,), (0.8,), (0.7,), (0.6,), (None,)], "s double")
    bands = [r[0] for r in scores.select(evaluation.rating_band(F.col("s"))).collect()]
    assert bands == ["very good", "good", "ok", "not so good", None]


def test_gaussian_features_as_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "scores array<double>")
    out = factor.scores_as_vector(df, 2).select("features", array_to_vector("scores").alias("all")).first()
    assert list(out["features"]) == [1.0, 2.0] and len(out["all"]) == 3


def test_job_runs(spark):
    rows = cmp.job_runs(spark, {"a": lambda: spark.range(7), "b": lambda: spark.range(0)}).collect()
    assert [(r["job"], r["rows"]) for r in rows] == [("a", 7), ("b", 0)]


def test_lda_reads_every_document(spark):
    """No size decides how many rows a fit reads: a word only 20,500 later rows hold is learned as well."""
    rows = [(i, ["early", "plain"] if i < 20_500 else ["late", "other"]) for i in range(41_000)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    fitted = terms.fit_vectorizer(df, 10)
    model = lda.lda_fit(fitted.counts(df).persist(), fitted, 2, 3)
    weights = {r["term"]: r["w"] for r in fitted.with_terms(model.topic_terms(spark)).groupBy("term").agg(F.max("weight").alias("w")).collect()}
    assert set(weights) == {"early", "plain", "late", "other"} and min(weights.values()) > 0.2


def test_missing_shared_folder_is_an_error(spark, monkeypatch):
    class Bare:
        conf = type("c", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("s", (), {"getCheckpointDir": staticmethod(lambda: None)})

    from doctopics.runtime import shared_root

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Bare)


def test_summary_with_grid_has_distinct_columns(spark):
    row = spark.createDataFrame([(4, 2.0, 3.0, 0.5)], "n_topics int, sklearn_perplexity double, gensim_perplexity double, gensim_coherence double")
    grid = spark.createDataFrame([(4, 1.0, 1.0, 9.0)], "n_components int, doc_topic_prior double, topic_word_prior double, best_perplexity double")
    out = lda.comparison_summary(row, 0.5, grid).first().asDict()
    assert out["best_perplexity"] == 3.0 and out["grid_best_perplexity"] == 9.0 and out["grid_n_components"] == 4
