"""Latent Dirichlet allocation in two flavours: A on TF-IDF vectors, B on bags of words."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import exp

from pyspark.ml.clustering import LDA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctopics.operators.coherence import coherence_cv
from doctopics.operators.evaluation import align_topics, aligned_accuracy, contingency
from doctopics.operators.terms import Vectorizer, fit_vectorizer, top_rows
from doctopics.operators.variational import Setting, Topics, distributions, fit_topics, log_perplexities
from doctopics.runtime import materialise, one_row
from doctopics.sources.selection import kfold

DEFAULT_K = 4
FAILED_SCORE = -1000.0
NO_WORDS = "no document has a known word"


@dataclass(frozen=True)
class TopicModel:
    """Fitted model with its vocabulary; the state is topics x terms."""

    model: Topics
    vectorizer: Vectorizer
    features_col: str = "features"

    def topic_terms(self, spark) -> DataFrame:
        """``(topic, term_id, weight)``, weights of a topic summing to one."""
        matrix = self.model.weights / self.model.weights.sum(axis=1, keepdims=True)
        rows = [(t, i, float(w)) for t, row in enumerate(matrix) for i, w in enumerate(row)]
        return spark.createDataFrame(rows, "topic int, term_id int, weight double")

    def top_terms(self, spark, n: int = 10) -> DataFrame:
        return topic_top_terms(self.topic_terms(spark), self.vectorizer, n)


def lda_fit(
    df: DataFrame,
    vectorizer: Vectorizer,
    k: int = DEFAULT_K,
    max_iter: int = 20,
    optimizer: str = "online",
    doc_prior: float | None = None,
    word_prior: float | None = None,
    seed: int = 42,
    features_col: str = "features",
    sampling_rate: float = 1.0,
) -> TopicModel:
    """Variational LDA. ``df`` should be persisted: every iteration reads it.

    ``sampling_rate``: share of the documents the online optimizer draws per iteration, whatever their number; at rate 1 an
    iteration reads every row. ``optimizer="em"`` is Spark's, which keeps a graph of documents and terms.
    """
    setting = _setting(k, max_iter, doc_prior, word_prior, seed)
    if optimizer == "online":
        fitted = fit_topics(df, [setting], vectorizer.size, features_col, sampling_rate)[0]
        if fitted is None:
            raise ValueError(NO_WORDS)
        return TopicModel(fitted, vectorizer, features_col)
    lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer=optimizer, featuresCol=features_col)
    if doc_prior is not None:
        lda = lda.setDocConcentration([doc_prior])
    if word_prior is not None:
        lda = lda.setTopicConcentration(word_prior)
    model = lda.fit(df)
    prior = model.estimatedDocConcentration().toArray()
    eta = 1.1 if word_prior is None else word_prior  # Spark's default for this optimizer
    return TopicModel(Topics(model.topicsMatrix().toArray().T, prior, float(eta)), vectorizer, features_col)


def _setting(k: int, max_iter: int, doc_prior: float | None, word_prior: float | None, seed: int, without: int | None = None) -> Setting:
    if k < 2 or (doc_prior is not None and doc_prior <= 0) or (word_prior is not None and word_prior <= 0):
        raise ValueError(f"k must be at least 2 and priors positive: {k}, {doc_prior}, {word_prior}")
    return Setting(k, max_iter, doc_prior, word_prior, seed, without)


def lda_perplexity(fitted: TopicModel, df: DataFrame) -> float:
    """exp of the negative bound per word (natural base)."""
    found = log_perplexities(df, [fitted.model], fitted.features_col)[0]
    if found is None:
        raise ValueError(NO_WORDS)
    return exp(found)


def topic_top_terms(topic_terms: DataFrame, vectorizer: Vectorizer, n: int = 10) -> DataFrame:
    """Highest weighted terms per topic; ties go to the higher term id."""
    best = top_rows(topic_terms, n, [F.desc("weight"), F.desc("term_id")], ["topic"])
    return vectorizer.with_terms(best).select("topic", "rank", "term", "weight")


def doc_topic_dist(fitted: TopicModel, df: DataFrame, out_col: str = "distribution") -> DataFrame:
    """Topic distribution per document."""
    return distributions(df, fitted.model, fitted.features_col, out_col)


def dominant_topic(df: DataFrame, distribution_col: str = "distribution", base: int = 0) -> DataFrame:
    """Most probable topic (first on ties) counted from ``base``, and its probability."""
    best = F.array_max(distribution_col)
    topic = F.array_position(distribution_col, best).cast("int") - 1 + base
    return df.withColumns({"topic": topic, "confidence": best})


# ---------------------------------------------------------------- comparing and tuning


@dataclass(frozen=True)
class Corpus:
    """Train and test vectors of both flavours plus the tokens coherence is measured on."""

    vectorizer: Vectorizer
    tfidf_train: DataFrame
    tfidf_test: DataFrame
    bow_train: DataFrame
    bow_test: DataFrame
    texts: DataFrame

    def unpersist(self) -> None:
        for part in (self.tfidf_train, self.tfidf_test, self.bow_train, self.bow_test):
            part.unpersist()


def prepare_corpus(
    df: DataFrame, max_features: int = 5000, split_col: str = "split", tokens_col: str = "tokens", id_col: str = "doc_id"
) -> Corpus:
    """Vectors of both flavours, persisted because every fit rereads them. ``df`` should be a table."""
    train, test = (df.filter(F.col(split_col) == s) for s in ("train", "test"))
    fitted = fit_vectorizer(train, max_features, tokens_col)

    def keep(part: DataFrame) -> DataFrame:
        return part.drop(tokens_col).persist()

    return Corpus(
        fitted,
        keep(fitted.tfidf(train)),
        keep(fitted.tfidf(test)),
        keep(fitted.counts(train)),
        keep(fitted.counts(test)),
        train.select(id_col, tokens_col),
    )


def lda_compare_k(
    corpus: Corpus, ks: Sequence[int] = (4, 6, 8), max_iter: int = 20, passes: int = 3, seed: int = 42
) -> DataFrame:
    """One row per k: held-out perplexity of both flavours and coherence of flavour B; null, with ``error``, where a fit failed.

    All k of a flavour are fitted and judged in shared scans, and the topics of all k share one coherence count.
    """
    spark, size = corpus.texts.sparkSession, corpus.vectorizer.size
    errors: dict[int, str] = {}
    good = []
    for k in ks:
        try:
            good.append((k, _setting(k, max_iter, None, None, seed), _setting(k, passes, None, None, seed)))
        except ValueError as e:  # a fit the data do not allow gives no value instead of ending the comparison
            errors[k] = str(e)
    perplexity: dict[tuple, float | None] = {}
    words = []
    for flavour, train, test in (("a", corpus.tfidf_train, corpus.tfidf_test), ("b", corpus.bow_train, corpus.bow_test)):
        fits = fit_topics(train, [a if flavour == "a" else b for _, a, b in good], size) if size else [None] * len(good)
        known = [(k, m) for (k, _, _), m in zip(good, fits) if m is not None]
        for k, _, _ in good:
            if k not in dict(known):
                errors[k] = NO_WORDS
        if known:
            for (k, m), value in zip(known, log_perplexities(test, [m for _, m in known])):
                perplexity[k, flavour] = None if value is None else exp(value)
                if value is None:
                    errors[k] = NO_WORDS
                if flavour == "b":
                    top = TopicModel(m, corpus.vectorizer).top_terms(spark, 10)
                    words.append(top.select(F.concat_ws("/", F.lit(k), "topic").alias("topic"), "term"))
    coherence: dict[int, float] = {}
    if words:
        scored = coherence_cv(corpus.texts, reduce(DataFrame.unionByName, words))
        means = scored.groupBy(F.split_part("topic", F.lit("/"), F.lit(1)).cast("int").alias("k")).agg(F.avg("coherence").alias("c"))
        coherence = {r["k"]: r["c"] for r in means.collect()}
    rows = [(k, perplexity.get((k, "a")), perplexity.get((k, "b")), coherence.get(k), errors.get(k)) for k in ks]
    schema = "n_topics int, sklearn_perplexity double, gensim_perplexity double, gensim_coherence double, error string"
    return spark.createDataFrame(rows, schema)


def select_best_k(comparison: DataFrame, default: int = DEFAULT_K) -> DataFrame:
    """k with the highest known coherence (smallest k on ties), else the default."""
    known = F.when(F.col("gensim_coherence").isNotNull(), F.struct("gensim_coherence", -F.col("n_topics")))
    return comparison.agg(F.coalesce(F.max_by("n_topics", known), F.lit(default)).alias("best_k"))


def comparison_summary(
    comparison: DataFrame, accuracy: float | None = None, grid: DataFrame | None = None
) -> DataFrame:
    """Best coherence, best perplexity, best k, accuracy and the best grid setting (``grid_*``) as one row."""
    best = comparison.agg(
        F.max("gensim_coherence").alias("best_coherence"), F.min("gensim_perplexity").alias("best_perplexity")
    )
    out = one_row(best, select_best_k(comparison))
    out = out.withColumn("accuracy", F.lit(accuracy).cast("double"))
    return out if grid is None else one_row(out, grid.select([F.col(c).alias(f"grid_{c}") for c in grid.columns]))


def lda_grid_search(
    corpus: Corpus,
    ks: Sequence[int] = (4, 6),
    doc_priors: Sequence[float] = (0.1, 1.0),
    word_priors: Sequence[float] = (0.1, 1.0),
    folds: int = 3,
    max_iter: int = 20,
    seed: int = 42,
    id_col: str = "doc_id",
) -> DataFrame:
    """Best setting by mean negative held-out perplexity over contiguous folds, as one row.

    All settings and folds are fitted in the same scans. A failing fit scores -1000; if all fail the defaults come back with a
    null perplexity.
    """
    spark = corpus.tfidf_train.sparkSession
    folded = kfold(corpus.tfidf_train, folds, id_col).select("features", "fold").persist()
    grid = list(product(ks, doc_priors, word_priors))
    settings: list[Setting | None] = []
    for k, doc_prior, word_prior in grid:
        for fold in range(folds):
            try:
                settings.append(_setting(k, max_iter, doc_prior, word_prior, seed, fold))
            except ValueError:
                settings.append(None)
    known = [i for i, s in enumerate(settings) if s is not None and corpus.vectorizer.size]
    scores = [FAILED_SCORE] * len(settings)
    if known:
        models = fit_topics(folded, [settings[i] for i in known], corpus.vectorizer.size, fold_col="fold")
        fitted = [(i, m) for i, m in zip(known, models) if m is not None]
        if fitted:
            held = log_perplexities(folded, [m for _, m in fitted], fold_col="fold", folds=[settings[i].without for i, _ in fitted])
            for (i, _), value in zip(fitted, held):
                scores[i] = FAILED_SCORE if value is None else -exp(value)
    folded.unpersist()
    means = [sum(scores[i * folds : (i + 1) * folds]) / folds for i in range(len(grid))]
    schema = "n_components int, doc_topic_prior double, topic_word_prior double, best_perplexity double"
    if all(s == FAILED_SCORE for s in scores):
        return spark.createDataFrame([(DEFAULT_K, 1.0, 1.0, None)], schema)
    best = max(range(len(grid)), key=lambda i: means[i])
    return spark.createDataFrame([(*grid[best], -means[best])], schema)


def evaluate_against_labels(fitted: TopicModel, df: DataFrame, values: Sequence[int], label_col: str = "labels"):
    """Counts, alignment and accuracy of the dominant topics, labels and topics restricted to ``values``."""
    topics = dominant_topic(doc_topic_dist(fitted, df), base=1).select(label_col, "topic")
    counts = contingency(topics, label_col, "topic", values=values)
    alignment = align_topics(counts)
    return counts, alignment, aligned_accuracy(counts, alignment)


def lda_job(
    df: DataFrame,
    ks: Sequence[int] = (4, 6, 8),
    tune: bool = True,
    max_features: int = 5000,
    n_words: int = 8,
    final_iter: int = 50,
    final_passes: int = 10,
    label_col: str = "labels",
    values: Sequence[int] = (1, 2, 3, 4),
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Compare k, tune, fit both flavours for the best k, list their words and align them with the labels.

    ``df``: ``doc_id``, tokens, numeric labels and a train/test split.
    """
    spark = df.sparkSession
    corpus = prepare_corpus(df, max_features)
    comparison = lda_compare_k(corpus, ks, seed=seed)
    best_k = select_best_k(comparison).first()["best_k"]
    out = {"comparison": comparison}
    if tune:
        out["grid"] = lda_grid_search(corpus, seed=seed)
    model_a = lda_fit(corpus.tfidf_train, corpus.vectorizer, best_k, final_iter, seed=seed)
    model_b = lda_fit(corpus.bow_train, corpus.vectorizer, best_k, final_passes, seed=seed)
    out["topics_tfidf"] = model_a.top_terms(spark, n_words)
    out["topics_bow"] = model_b.top_terms(spark, n_words)
    counts, alignment, accuracy = evaluate_against_labels(model_a, corpus.tfidf_test, values, label_col)
    out.update(contingency=counts, alignment=alignment, accuracy=accuracy)
    out["summary"] = comparison_summary(comparison, accuracy.first()["Aligned_Accuracy"], out.get("grid"))
    # results that still read the test vectors are computed before those are released
    out = {name: materialise(df, f"lda-{name}") for name, df in out.items()}
    corpus.unpersist()
    return out
