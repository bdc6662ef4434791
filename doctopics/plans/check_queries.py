"""What must hold of trained models and greedy reductions, with SQL that gives the same rows.

A trained model's own rows have no SQL; these queries fit it the same way and state facts that a wrong or half-read fit
would break. SQL computes the counts and sets from the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from doctopics.operators import density, describe, encoders, factor, lda, neighbours, supervised, terms, topic_jobs
from doctopics.operators import embeddings as emb
from doctopics.plans.base import SPLIT_CTE, articles, register, table, tokens
from doctopics.plans.model_queries import LABEL_ID, encoded, labelled, train_tfidf
from doctopics.plans.topic_queries import _by_source
from doctopics.runtime import materialise


def truths(*claims: str) -> str:
    """SQL: every claim holds."""
    return " UNION ALL ".join(f"SELECT '{c}' AS claim, true AS holds" for c in claims)


def claimed(spark, claims: dict[str, bool]):
    return spark.createDataFrame([(c, bool(x)) for c, x in claims.items()], "claim string, holds boolean")


def _train(vectors):
    return vectors.filter("split = 'train'")


@register("lda_grid_check", truths("a setting of the grid is chosen", "perplexity above one", "k is among those compared", "no fit failed"))
def lda_grid_check(spark, sf_dir):
    corpus = lda.prepare_corpus(labelled(spark, sf_dir), 500)
    grid = lda.lda_grid_search(corpus, (4,), (0.1, 1.0), (0.1,), folds=2, max_iter=5).first()
    rows = lda.lda_compare_k(corpus, (4, 6), max_iter=5).collect()
    corpus.unpersist()
    claims = {
        "a setting of the grid is chosen": grid["n_components"] == 4 and grid["doc_topic_prior"] in (0.1, 1.0),
        "perplexity above one": grid["best_perplexity"] > 1 and all(r["sklearn_perplexity"] > 1 for r in rows),
        "k is among those compared": {r["n_topics"] for r in rows} == {4, 6},
        "no fit failed": all(r["error"] is None for r in rows),
    }
    return claimed(spark, claims)


@register("lda_job_check", truths("one summary row", "accuracy within bounds", "eight words a topic", "distinct columns"))
def lda_job_check(spark, sf_dir):
    out = lda.lda_job(labelled(spark, sf_dir), (4,), False, 500, final_iter=5, final_passes=2)
    words = out["topics_tfidf"].groupBy("topic").count().collect()
    summary = out["summary"]
    claims = {
        "one summary row": summary.count() == 1,
        "accuracy within bounds": 0 <= summary.first()["accuracy"] <= 1,
        "eight words a topic": len(words) == 4 and all(r["count"] == 8 for r in words),
        "distinct columns": len(set(summary.columns)) == len(summary.columns),
    }
    return claimed(spark, claims)


@register("nmf_check", truths("topics are non-negative", "document weights are non-negative", "the objective never rises", "every test document has weights"))
def nmf_check(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir)
    model = factor.nmf_fit(_train(vectors), 8, fitted.size, max_iter=60)
    held = vectors.filter("split = 'test'")
    scores = model.transform(held).select("scores")
    fall = np.diff(model.objective)
    claims = {
        "topics are non-negative": (model.h >= 0).all(),
        "document weights are non-negative": scores.filter(F.exists("scores", lambda x: x < 0)).count() == 0,
        "the objective never rises": len(fall) > 0 and (fall <= 1e-9 * model.objective[0]).all(),
        "every test document has weights": scores.filter(F.size("scores") == 8).count() == held.count(),
    }
    vectors.unpersist()
    return claimed(spark, claims)


@register("projection_check", truths("directions are orthonormal", "squared singular values sum to the trace", "variances fall", "scores are centred"))
def projection_check(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir, 200)
    train = _train(vectors)
    full = factor.lsa_fit(train, fitted.size)
    trace = train.select(F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x * x).alias("s")).agg(F.sum("s")).first()[0]
    pca = factor.pca_fit(train, 4)
    means = pca.transform(train).select(F.posexplode("scores").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
    eye = [p.directions.T @ p.directions for p in (full, pca)]
    claims = {
        "directions are orthonormal": all(np.allclose(x, np.eye(len(x)), atol=1e-8) for x in eye),
        "squared singular values sum to the trace": np.isclose((full.strengths**2).sum(), trace, rtol=1e-8),
        "variances fall": (np.diff(pca.strengths) <= 1e-12).all(),
        "scores are centred": len(means) == 4 and all(abs(r["m"]) < 1e-8 for r in means),
    }
    vectors.unpersist()
    return claimed(spark, claims)


PREDICTED = f"""WITH {SPLIT_CTE}, t AS (SELECT {LABEL_ID} AS labels FROM splits WHERE split = 'test')
    SELECT m.model, t.labels, count(*) AS n, true AS most_are_right
    FROM t CROSS JOIN (VALUES ('forest'), ('logreg'), ('svc'), ('predict_new')) m(model) GROUP BY ALL"""


@register("classifier_check", PREDICTED)
def classifier_check(spark, sf_dir):
    """Test documents per true class as each trained classifier returns them, and whether most predictions are right.

    Each model is scored by a job of its own; a few counts a model are kept.
    """
    df, names = supervised.with_label_index(labelled(spark, sf_dir))
    train, held = df.filter("split = 'train'"), df.filter("split = 'test'")
    fitted = terms.fit_vectorizer(train, 300)
    vectors = materialise(fitted.tfidf(df).drop("tokens"), "vectors")
    n = _train(vectors).count()
    models = {
        "forest": supervised.clf_random_forest(trees=20),
        "logreg": supervised.clf_logreg(n, max_iter=100),
        "svc": supervised.clf_linear_svc(n, max_iter=100),
    }
    counts = (F.count("*").alias("n"), F.count_if("ok").alias("k"))
    right = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).cast("int") == F.col("labels")
    rows = []
    for name, model in models.items():
        scored = model.fit(_train(vectors)).transform(vectors.filter("split = 'test'"))
        rows += [(name, *r) for r in scored.withColumn("ok", right).groupBy("labels").agg(*counts).collect()]
    text = train.withColumn("labels", F.col("labels").cast("string"))
    predictor = supervised.fit_predictor(text.drop("label_idx"), k=8, max_features=300, max_iter=30)
    out = supervised.predict_new(predictor, held).withColumn("ok", F.col("Predicted Class Index") == F.col("labels").cast("string"))
    rows += [("predict_new", *r) for r in out.groupBy("labels").agg(*counts).collect()]
    good = {m: sum(r[3] for r in rows if r[0] == m) > 0.5 * sum(r[2] for r in rows if r[0] == m) for m in {r[0] for r in rows}}
    return spark.createDataFrame([(m, label, k, good[m]) for m, label, k, _ in rows], "model string, labels int, n long, most_are_right boolean")


@register(
    "experiment_check",
    """SELECT g.grid, r.n AS n_rows, true AS accuracies_within_bounds, true AS best_beats_chance
    FROM (VALUES ('nmf', 4), ('lsa', 8), ('bow_tfidf', 16), ('pca', 4)) r(grid, n) JOIN (VALUES ('nmf'), ('lsa'), ('bow_tfidf'), ('pca')) g(grid)
    ON r.grid = g.grid""",
)
def experiment_check(spark, sf_dir):
    """Each grid with a short parameter list: all its rows, accuracies in [0, 1], the best above an even guess."""
    df = labelled(spark, sf_dir)

    def pca():
        _, report = supervised.experiment_pca(df, max_features=200)
        return report.filter("class = 'accuracy'").withColumnRenamed("precision", "Accuracy")

    grids = {
        "nmf": lambda: supervised.experiment_nmf(df, (8,), 200, 30),
        "lsa": lambda: supervised.experiment_lsa(df, (100, 200), (8,)),
        "bow_tfidf": lambda: supervised.experiment_bow_tfidf(df, (100,), (200,)),
        "pca": pca,
    }
    rows = []
    for name, grid in grids.items():
        values = [r["Accuracy"] for r in grid().select("Accuracy").collect()]
        spark.catalog.clearCache()  # nothing of one grid is held during the next
        rows.append((name, len(values), all(0 <= v <= 1 for v in values), max(values) > 0.25))
    return spark.createDataFrame(rows, "grid string, n_rows int, accuracies_within_bounds boolean, best_beats_chance boolean")


ENCODED = """SELECT e.encoder, count(*) AS n_documents, 16 AS width, true AS document_is_mean_of_its_words, true AS every_word_has_a_vector
    FROM documents CROSS JOIN (VALUES ('pmi'), ('word2vec')) e(encoder) GROUP BY e.encoder"""


def _word_sums(df, words, columns, width=16, broadcast=100_000):
    """Per ``doc_id`` the sums of its words' vectors, as ``<column>_<i>``.

    The most frequent words are met where they stand, so that a document's words are added up before anything is shuffled; only
    the others, which are most of the words but few of the text, are joined by a shuffle.
    """
    held, least = 0, None
    for r in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # fewer counts than words
        held += r["k"]
        if held > broadcast:
            break
        least = r["n"]
    chosen = F.lit(False) if least is None else F.col("n") >= least
    often = F.broadcast(words.filter(chosen).withColumn("often", F.lit(True)))
    long = df.select("doc_id", F.explode("tokens").alias("term")).join(often.drop("n"), "term", "left")
    sums = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c in columns for i in range(width)]
    near = long.filter("often").groupBy("doc_id").agg(*sums)
    far = long.filter("often IS NULL").select("doc_id", "term").join(words, "term").groupBy("doc_id").agg(*sums)
    names = [f"{c}_{i}" for c in columns for i in range(width)]
    return near.unionByName(far).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in names])


@register("embedding_check", ENCODED)
def embedding_check(spark, sf_dir):
    """With both encoders every word has a vector, trained or not, and a document is the mean of its words."""
    df = materialise(tokens(spark, sf_dir).select("doc_id", "tokens"), "tokens")
    fits = {"word2vec": encoders.fit_word2vec(df, size=16, max_iter=1, max_vocabulary=300), "pmi": encoders.fit_pmi(df, size=16, max_vocabulary=300)}
    docs, words = df, df.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")).withColumn("tokens", F.array("term"))
    for name, vectors in fits.items():
        docs, words = vectors.embed(docs, out_col=name), vectors.embed(words, out_col=name)
    docs = materialise(docs.select("doc_id", F.size("tokens").alias("n"), *fits), "embedded")
    words = materialise(words.select("term", "n", *fits), "words")
    sums = _word_sums(df, words, list(fits))
    joined = docs.join(sums, "doc_id", "left")
    out = None
    for name in fits:
        zero = words.filter(~F.exists(name, lambda x: x != 0)).limit(1).count()
        off = [F.abs(F.col(name)[i] - F.coalesce(F.col(f"{name}_{i}") / F.col("n"), F.lit(0.0))) for i in range(16)]
        worst = joined.agg(F.max(F.greatest(*off))).first()[0]
        row = docs.agg(
            F.lit(name).alias("encoder"),
            F.count("*").alias("n_documents"),
            F.max(F.size(name)).alias("width"),
            F.lit(worst < 1e-6).alias("document_is_mean_of_its_words"),
            F.lit(not zero).alias("every_word_has_a_vector"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "vector_check",
    """SELECT count(*) AS n, 5 AS width, true AS directions_shorten, true AS sse_falls, true AS silhouettes_within_bounds FROM embeddings""",
)
def vector_check(spark, sf_dir):
    """Reduced vectors of all rows, no longer than one; the error of k-means falls with k."""
    reduced = emb.reduce_dims(table(spark, sf_dir, "embeddings"))
    squares = F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x)
    curve = emb.kmeans_elbow(table(spark, sf_dir, "embeddings"), max_k=6, restarts=3).orderBy("k").collect()
    falls = all(a["sse"] >= b["sse"] for a, b in zip(curve, curve[1:], strict=False))
    bounded = all(-1 <= r["silhouette"] <= 1 for r in curve)
    return reduced.agg(
        F.count("*").alias("n"),
        F.max(F.size("reduced")).alias("width"),
        (F.max(squares) <= 1 + 1e-9).alias("directions_shorten"),
        F.lit(falls).alias("sse_falls"),
        F.lit(bounded).alias("silhouettes_within_bounds"),
    )


@register(
    "neighbour_check",
    """SELECT count(DISTINCT embedding) AS n, least(15, count(DISTINCT embedding) - 1) AS shortest, 15 AS longest, true AS recall_held,
        true AS eigen_equation_holds, true AS orthogonal_to_constant FROM embeddings""",
)
def neighbour_check(spark, sf_dir):
    """Every different vector has all its neighbours, nine tenths of them the true ones; the coordinates solve the eigen equation."""
    graph = neighbours.neighbour_graph(table(spark, sf_dir, "embeddings"))
    edges = materialise(neighbours.weighted_edges(graph.lists), "edges")
    found = neighbours.spectral_coordinates(edges)
    degrees = edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("deg"))
    mass = degrees.agg(F.sum("deg")).first()[0]
    means = [F.sum(F.col("reduced")[i] * F.col("deg")) / mass for i in range(5)]
    balance = found.coordinates.join(degrees, "id").agg(F.greatest(*[F.abs(m) for m in means])).first()[0]
    return graph.lists.agg(
        F.count("*").alias("n"),
        F.min(F.size("near")).cast("long").alias("shortest"),
        F.max(F.size("near")).alias("longest"),
        F.lit(graph.recall >= 0.9).alias("recall_held"),
        F.lit(bool(found.residuals.max() <= 0.05)).alias("eigen_equation_holds"),
        F.lit(balance < 1e-6).alias("orthogonal_to_constant"),
    )


@register("density_check", "SELECT label % 4 AS blob, count(*) AS n, 1 AS topics, 1 AS blobs_in_topic FROM embeddings GROUP BY ALL")
def density_check(spark, sf_dir):
    """Vectors moved into four dense groups far apart: each group is a topic of its own."""
    blob = (F.col("label") % 4).alias("blob")
    near = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 2), lambda v: v / 10)
    moved = table(spark, sf_dir, "embeddings").select("vec_id", blob, F.concat(F.array((blob * 100).cast("double")), near).alias("reduced"))
    # the few points at a group's rim may be noise
    pairs = density.density_cluster(moved).groupBy("blob", "topic").agg(F.count("*").alias("n"))
    named = F.col("topic") != -1
    within = F.count_if(named).over(Window.partitionBy("blob")).cast("int")
    sharing = F.count("*").over(Window.partitionBy("topic")).cast("int")
    marked = pairs.select("blob", "n", within.alias("topics"), F.when(named, sharing).alias("blobs_in_topic"))
    return marked.groupBy("blob").agg(F.sum("n").alias("n"), F.max("topics").alias("topics"), F.max("blobs_in_topic").alias("blobs_in_topic"))


@register(
    "reduction_check",
    """SELECT 'vectors' AS what, count(DISTINCT label) AS topics, 4 AS reduced, true AS each_once FROM embeddings
    UNION ALL SELECT 'terms', count(DISTINCT source), 5, true FROM documents""",
)
def reduction_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "topic")
    by_vector = emb.hierarchical_reduction(emb.topic_centroids(vectors), 4)
    df = _by_source(spark, sf_dir)
    by_terms = describe.reduce_topics(describe.class_tfidf(df), describe.topic_info(df), 5)

    def row(what, pairs, old):
        return pairs.agg(
            F.lit(what).alias("what"),
            F.countDistinct(old).alias("topics"),
            F.countDistinct("reduced_topic").cast("int").alias("reduced"),
            (F.countDistinct(old) == F.count("*")).alias("each_once"),
        )

    return row("vectors", by_vector, "orig_topic").unionByName(row("terms", by_terms, "topic"))


@register(
    "topic_jobs_check",
    f"""WITH {SPLIT_CTE} SELECT m.job, count(*) AS n_documents, count(DISTINCT split) AS splits, true AS scores_within_bounds
    FROM splits CROSS JOIN (VALUES ('bertopic'), ('top2vec')) m(job) GROUP BY m.job""",
)
def topic_jobs_check(spark, sf_dir):
    """Both composed jobs place every document of both splits and score within bounds."""
    docs, words = encoded(spark, sf_dir)
    jobs = {"bertopic": topic_jobs.bertopic_job(docs), "top2vec": topic_jobs.top2vec_job(docs, words)}
    rows = []
    for name, job in jobs.items():
        split = {r["split"]: r["n"] for r in job.assignments.groupBy("split").agg(F.count("*").alias("n")).collect()}
        scores = [r["NMI"] for r in job.metrics.collect() if r["NMI"] is not None]
        rows.append((name, sum(split.values()), len(split), all(-1e-9 <= x <= 1 + 1e-9 for x in scores)))
    return spark.createDataFrame(rows, "job string, n_documents long, splits long, scores_within_bounds boolean")


@register(
    "prediction_samples_check",
    f"""WITH {SPLIT_CTE} SELECT doc_id, {LABEL_ID} AS labels, true AS topic_known, true AS confidence_within_bounds
    FROM splits WHERE split = 'test' ORDER BY doc_id LIMIT 3""",
)
def prediction_samples_check(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir, 500)
    model = lda.lda_fit(_train(vectors), fitted, max_iter=5)
    scored = lda.dominant_topic(lda.doc_topic_dist(model, vectors.filter("split = 'test'")), base=1)
    out = describe.prediction_samples(scored.join(articles(spark, sf_dir).select("doc_id", "title"), "doc_id"))
    return out.select(
        "doc_id",
        "labels",
        F.col("topic").between(1, lda.DEFAULT_K).alias("topic_known"),
        F.col("confidence").between(0, 1).alias("confidence_within_bounds"),
    )
