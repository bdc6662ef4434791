"""Trained models, accuracy grids and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import comparison as cmp
from doctopics.operators import describe, factor, lda, supervised, terms, topic_jobs
from doctopics.operators import embeddings as emb
from doctopics.plans.base import (
    SPLIT_CTE,
    WORDS_CTE,
    articles,
    r6,
    register,
    split_tokens,
    table,
    tokens,
    vocab_cte,
)
from doctopics.plans.term_queries import FULL
from doctopics.runtime import materialise

LABEL_ID = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"


def labelled(spark, sf_dir):
    """Tokens with class and split, written once because models read them many times."""
    df = split_tokens(spark, sf_dir).withColumn("labels", F.expr(LABEL_ID)).drop("lang")
    return materialise(df, "labelled")


def train_tfidf(spark, sf_dir, max_features=1000):
    df = labelled(spark, sf_dir)
    train = df.filter("split = 'train'")
    fitted = terms.fit_vectorizer(train, max_features)
    return fitted, fitted.tfidf(df).drop("tokens").persist()


def _train(vectors):
    return vectors.filter("split = 'train'")


def _ranked(df, key="topic"):
    return df.select(key, "rank", "term", r6("weight", "weight"))


# ---------------------------------------------------------------- LDA


@register("lda_fit")
def lda_fit(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir, 5000)
    return _ranked(lda.lda_fit(_train(vectors), fitted).top_terms(spark, 10))


@register("lda_fit_bow")
def lda_fit_bow(spark, sf_dir):
    df = labelled(spark, sf_dir).filter("split = 'train'")
    fitted = terms.fit_vectorizer(df)
    counts = fitted.counts(df).select("features").persist()
    return _ranked(lda.lda_fit(counts, fitted, max_iter=10).top_terms(spark, 10))


@register("lda_perplexity")
def lda_perplexity(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir, 5000)
    model = lda.lda_fit(_train(vectors), fitted)
    rows = [(s, lda.lda_perplexity(model, vectors.filter(F.col("split") == s))) for s in ("train", "test")]
    return spark.createDataFrame(rows, "split string, perplexity double")


@register(
    "topic_top_terms",
    f"""{FULL}, sums AS (SELECT lang, term_id, term, round(sum(weight), 9) AS weight
        FROM cells JOIN documents USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term_id DESC) AS rank FROM sums)
    SELECT lang AS topic, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10""",
)
def topic_top_terms(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    cells = terms.tfidf(df, fitted, keep=["lang"]).groupBy(F.col("lang").alias("topic"), "term_id")
    weights = cells.agg(F.round(F.sum("weight"), 9).alias("weight"))
    return _ranked(lda.topic_top_terms(weights, fitted, 10))


def _document_topics(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir, 5000)
    return lda.doc_topic_dist(lda.lda_fit(_train(vectors), fitted), vectors)


@register("doc_topic_dist")
def doc_topic_dist(spark, sf_dir):
    dist = _document_topics(spark, sf_dir)
    return dist.select("doc_id", F.posexplode_outer("distribution").alias("topic", "p"))


@register(
    "dominant_topic",
    """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings),
    p AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM d)
    SELECT vec_id, CAST(list_position(v, list_max(v)) AS INT) AS topic, round(list_max(v), 6) AS confidence FROM p""",
)
def dominant_topic(spark, sf_dir):
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    df = table(spark, sf_dir, "embeddings").select("vec_id", sizes.alias("v"))
    df = df.withColumn("t", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    df = df.select("vec_id", F.transform("v", lambda x: x / F.col("t")).alias("distribution"))
    return lda.dominant_topic(df, base=1).select("vec_id", "topic", r6("confidence", "confidence"))


@register("prediction_samples")
def prediction_samples(spark, sf_dir):
    scored = lda.dominant_topic(_document_topics(spark, sf_dir), base=1).filter("split = 'test'")
    titles = articles(spark, sf_dir).select("doc_id", "title")
    return describe.prediction_samples(scored.join(titles, "doc_id"))


@register("lda_compare_k")
def lda_compare_k(spark, sf_dir):
    return lda.lda_compare_k(lda.prepare_corpus(labelled(spark, sf_dir)))


@register(
    "lda_invariants",
    """SELECT 'topic weights sum to one' AS claim, true AS holds UNION ALL SELECT 'document shares sum to one', true
    UNION ALL SELECT 'every document has a distribution', true UNION ALL SELECT 'perplexity is finite and above one', true""",
)
def lda_invariants(spark, sf_dir):
    """What must hold of the model that the trained LDA queries use."""
    fitted, vectors = train_tfidf(spark, sf_dir, 5000)
    model = lda.lda_fit(_train(vectors), fitted)
    sums = model.topic_terms(spark).groupBy("topic").agg(F.sum("weight").alias("s"))
    dist = lda.doc_topic_dist(model, vectors).select(F.aggregate("distribution", F.lit(0.0), lambda a, x: a + x).alias("s"))
    whole = F.every(F.abs(F.col("s") - 1) < 1e-9)
    perplexity = lda.lda_perplexity(model, _train(vectors))
    rows = [
        ("topic weights sum to one", sums.agg(whole).first()[0]),
        ("document shares sum to one", dist.filter("s > 0").agg(whole).first()[0]),
        ("every document has a distribution", dist.count() == vectors.count()),
        ("perplexity is finite and above one", 1 < perplexity < float("inf")),
    ]
    vectors.unpersist()
    return spark.createDataFrame(rows, "claim string, holds boolean")


# A comparison table derived from the vectors: one row per label, one of them without coherence.
CURVE = """SELECT label + 2 AS n_topics, avg(abs(CAST(x AS DOUBLE))) AS sklearn_perplexity,
    avg(CAST(x AS DOUBLE) * x) AS gensim_perplexity,
    CASE WHEN label <> 3 THEN avg(CAST(x AS DOUBLE)) END AS gensim_coherence
    FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label"""
BEST_K = "coalesce((SELECT n_topics FROM c WHERE gensim_coherence IS NOT NULL ORDER BY gensim_coherence DESC, n_topics LIMIT 1), 4)"


def _comparison(spark, sf_dir):
    x = F.col("x").cast("double")
    return (
        table(spark, sf_dir, "embeddings")
        .select("label", F.explode("embedding").alias("x"))
        .groupBy("label")
        .agg(
            F.avg(F.abs(x)).alias("sklearn_perplexity"),
            F.avg(x * x).alias("gensim_perplexity"),
            F.avg(F.when(F.col("label") != 3, x)).alias("gensim_coherence"),
        )
        .withColumn("n_topics", F.col("label") + 2)
    )


@register("select_best_k", f"WITH c AS ({CURVE}) SELECT {BEST_K} AS best_k")
def select_best_k(spark, sf_dir):
    return lda.select_best_k(_comparison(spark, sf_dir))


@register(
    "comparison_summary",
    f"""WITH c AS ({CURVE}) SELECT round(max(gensim_coherence), 6) AS best_coherence,
        round(min(gensim_perplexity), 6) AS best_perplexity, {BEST_K} AS best_k, CAST(0.5 AS DOUBLE) AS accuracy FROM c""",
)
def comparison_summary(spark, sf_dir):
    out = lda.comparison_summary(_comparison(spark, sf_dir), 0.5)
    return out.select(r6("best_coherence", "best_coherence"), r6("best_perplexity", "best_perplexity"), "best_k", "accuracy")


@register("lda_grid_search")
def lda_grid_search(spark, sf_dir):
    return lda.lda_grid_search(lda.prepare_corpus(labelled(spark, sf_dir)))


@register("lda_job")
def lda_job(spark, sf_dir):
    out = lda.lda_job(labelled(spark, sf_dir))
    return out["summary"]


# ---------------------------------------------------------------- factorisations


@register("nmf_fit")
def nmf_fit(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir)
    model = factor.nmf_fit(_train(vectors), 8, fitted.size)
    return _ranked(lda.topic_top_terms(model.topic_terms(spark), fitted))


@register("nmf_transform")
def nmf_transform(spark, sf_dir):
    fitted, vectors = train_tfidf(spark, sf_dir)
    model = factor.nmf_fit(_train(vectors), 8, fitted.size)
    held = vectors.filter("split = 'test'")
    return model.transform(held).select("doc_id", F.posexplode_outer("scores").alias("topic", "weight"))


@register("lsa_fit")
def lsa_fit(spark, sf_dir):
    _, vectors = train_tfidf(spark, sf_dir)
    scores = factor.lsa_fit(_train(vectors), 50).transform(vectors)
    return scores.select("doc_id", F.posexplode_outer("scores").alias("component", "score"))


@register("pca_fit")
def pca_fit(spark, sf_dir):
    _, vectors = train_tfidf(spark, sf_dir)
    scores = factor.pca_fit(_train(vectors), 4).transform(vectors)
    return scores.select("doc_id", F.posexplode_outer("scores").alias("component", "score"))


@register(
    "pca_topic_terms",
    f"""{FULL}, sums AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS component,
        term_id, term, round(sum(weight * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END)), 9) AS weight
        FROM cells JOIN documents USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY weight DESC, term_id DESC) AS rank FROM sums)
    SELECT component, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10""",
)
def pca_topic_terms(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    component = F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END").alias("component")
    signed = F.col("weight") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)
    cells = terms.tfidf(df, fitted, keep=["lang"]).groupBy(component, "term_id")
    loadings = cells.agg(F.round(F.sum(signed), 9).alias("weight"))
    return _ranked(factor.pca_topic_terms(loadings, fitted), "component")


# ---------------------------------------------------------------- classifiers


def _classified(spark, sf_dir, make, counts=False):
    df, names = supervised.with_label_index(labelled(spark, sf_dir))
    train = df.filter("split = 'train'")
    fitted = terms.fit_vectorizer(train, 1000)
    vectors = (fitted.counts(df) if counts else fitted.tfidf(df)).drop("tokens").persist()
    model = make(_train(vectors).count()).fit(_train(vectors))
    scored = model.transform(vectors.filter("split = 'test'"))
    name = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).cast("int")
    return scored.select("doc_id", "labels", name.alias("pred"))


@register("clf_logreg")
def clf_logreg(spark, sf_dir):
    return _classified(spark, sf_dir, supervised.clf_logreg)


@register("clf_random_forest")
def clf_random_forest(spark, sf_dir):
    return _classified(spark, sf_dir, lambda n: supervised.clf_random_forest())


@register("clf_linear_svc")
def clf_linear_svc(spark, sf_dir):
    return _classified(spark, sf_dir, supervised.clf_linear_svc)


# Gaussian naive Bayes over the vectors, written out.
@register(
    "clf_gaussian_nb",
    """WITH pos AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
        FROM embeddings),
    eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM pos GROUP BY i)),
    cls AS (SELECT label, i, avg(x) AS m, var_pop(x) + (SELECT e FROM eps) AS v FROM pos GROUP BY label, i),
    prior AS (SELECT label, ln(count(*)) AS p FROM embeddings GROUP BY label),
    score AS (SELECT vec_id, c.label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) AS s
        FROM pos JOIN cls c USING (i) GROUP BY vec_id, c.label)
    SELECT vec_id, arg_max(label, s + p) AS pred FROM score JOIN prior USING (label) GROUP BY vec_id""",
)
def clf_gaussian_nb(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "scores")
    df = df.withColumn("scores", F.col("scores").cast("array<double>"))
    df = factor.scores_as_vector(df).withColumn("label_idx", F.col("label").cast("double")).persist()
    scored = supervised.clf_gaussian_nb().fit(df).transform(df)
    return scored.select("vec_id", F.col("prediction").cast("int").alias("pred"))


@register(
    "clf_multinomial_nb",
    f"""WITH {WORDS_CTE}, {SPLIT_CTE}, train_words AS (SELECT w.* FROM words w JOIN splits USING (doc_id) WHERE split = 'train'),
    {vocab_cte(1000, "train_words")},
    cls AS (SELECT {LABEL_ID} AS c, count(*) AS n FROM splits WHERE split = 'train' GROUP BY c),
    sums AS (SELECT {LABEL_ID} AS c, term, count(*) AS n FROM train_words JOIN vocab USING (term) GROUP BY ALL),
    tot AS (SELECT c, sum(n) AS t FROM sums GROUP BY c),
    theta AS (SELECT c, term, ln(coalesce(n, 0) + 1.0) - ln(t + 1.0 * (SELECT count(*) FROM vocab)) AS th
        FROM (SELECT c, term FROM cls CROSS JOIN vocab) LEFT JOIN sums USING (c, term) JOIN tot USING (c)),
    pri AS (SELECT c, ln(n + 1.0) - ln((SELECT sum(n) FROM cls) + (SELECT count(*) FROM cls)) AS p FROM cls),
    cnt AS (SELECT doc_id, term, count(*) AS k FROM words JOIN splits USING (doc_id) WHERE split = 'test' GROUP BY ALL),
    ev AS (SELECT doc_id, c, sum(k * th) AS s FROM cnt JOIN theta USING (term) GROUP BY doc_id, c),
    score AS (SELECT doc_id, c, p + coalesce(s, 0) AS s FROM splits CROSS JOIN pri LEFT JOIN ev USING (doc_id, c) WHERE split = 'test')
    SELECT doc_id, any_value({LABEL_ID}) AS labels, arg_max(c, s) AS pred FROM score JOIN splits USING (doc_id) GROUP BY doc_id""",
)
def clf_multinomial_nb(spark, sf_dir):
    return _classified(spark, sf_dir, lambda n: supervised.clf_multinomial_nb(), counts=True)


@register("experiment_nmf")
def experiment_nmf(spark, sf_dir):
    return supervised.experiment_nmf(labelled(spark, sf_dir))


@register("experiment_lsa")
def experiment_lsa(spark, sf_dir):
    return supervised.experiment_lsa(labelled(spark, sf_dir))


@register("experiment_bow_tfidf")
def experiment_bow_tfidf(spark, sf_dir):
    return supervised.experiment_bow_tfidf(labelled(spark, sf_dir))


@register("experiment_pca")
def experiment_pca(spark, sf_dir):
    _, report = supervised.experiment_pca(labelled(spark, sf_dir))
    return report


def predicted(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("labels", F.col("labels").cast("string"))
    model = supervised.fit_predictor(df.filter("split = 'train'"))
    return supervised.predict_new(model, df.filter("split = 'test'"))


@register("predict_new")
def predict_new(spark, sf_dir):
    return predicted(spark, sf_dir).select("doc_id", "labels", "Predicted Class Index")


# ---------------------------------------------------------------- accuracy reports over a fixed results table

# Accuracy rows derived from the labels table: share of quality documents per language and source group.
RESULTS = """SELECT lang AS "Classifier", CAST(substr(source, 4) AS INT) AS n_components,
    avg(CAST(quality AS DOUBLE)) AS "Accuracy" FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""
LANGS = ["de", "en", "es", "fr"]


def _results(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    number = F.substring("source", 4, 2).cast("int").alias("n_components")
    return joined.groupBy(F.col("lang").alias("Classifier"), number).agg(F.avg("quality").alias("Accuracy"))


@register(
    "accuracy_curves",
    f"""WITH r AS ({RESULTS}) SELECT n_components, {", ".join(f"round(max(\"Accuracy\") FILTER (\"Classifier\" = '{x}'), 6) AS {x}" for x in LANGS)}
    FROM r GROUP BY n_components""",
)
def accuracy_curves(spark, sf_dir):
    curves = cmp.accuracy_curves(_results(spark, sf_dir), "n_components", classifiers=LANGS)
    return curves.select("n_components", *[r6(x, x) for x in LANGS])


@register(
    "best_accuracy",
    f"""WITH r AS ({RESULTS}) SELECT "Classifier" AS experiment, round(max("Accuracy"), 6) AS accuracy FROM r GROUP BY 1""",
)
def best_accuracy(spark, sf_dir):
    out = cmp.best_accuracy(_results(spark, sf_dir).withColumnRenamed("Classifier", "experiment"))
    return out.select("experiment", r6("Accuracy", "accuracy"))


# ---------------------------------------------------------------- composed topic models


def encoded(spark, sf_dir, size=32, encoder=emb.embed_word2vec):
    """Documents with class, split and vectors of an encoder, as a table, and the word vectors."""
    df = labelled(spark, sf_dir).withColumn("label0", F.col("labels") - 1)
    docs, words = encoder(df, size=size)
    return materialise(docs, "encoded"), words


def _metrics(df, key):
    names = [n for n in df.columns if n not in (key, "split", "encoder_order")]
    return df.select(key, *(["split"] if key != "split" else []), *[F.col(f"`{n}`").alias(n.lower().replace("-", "_")) for n in names])


@register("bertopic_job")
def bertopic_job(spark, sf_dir):
    docs, _ = encoded(spark, sf_dir)
    return _metrics(topic_jobs.bertopic_job(docs).metrics, "split")


@register("top2vec_job")
def top2vec_job(spark, sf_dir):
    docs, words = encoded(spark, sf_dir)
    return _metrics(topic_jobs.top2vec_job(docs, words).metrics, "split")


@register("select_best_encoder")
def select_best_encoder(spark, sf_dir):
    kinds = {"word2vec": emb.embed_word2vec, "pmi": emb.embed_pmi}
    encoders = {name: (lambda kind=kind: encoded(spark, sf_dir, encoder=kind)[0]) for name, kind in kinds.items()}
    best, _, board = topic_jobs.select_best_encoder(encoders)
    return _metrics(board.filter(F.col("encoder") == best), "encoder")
