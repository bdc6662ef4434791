"""Classifiers that check a document representation, and the accuracy grids built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctopics.functions.tokens import ngrams_1_2
from doctopics.operators.evaluation import classification_report
from doctopics.operators.factor import NmfModel, lsa_fit, nmf_fit, pca_fit, pca_topic_terms, scores_as_vector
from doctopics.operators.linear_svm import LinearSvm
from doctopics.operators.terms import Vectorizer, nested_vectorizers, term_stats
from doctopics.runtime import run_parallel, sized

SEED = 42
# Relative improvement at which a fit stops.
TOLERANCE = 1e-4
# Spark's limit on the depth of a tree.
MAX_DEPTH = 30
# Small data are fitted in this many partitions: up to five, Spark adds up a gradient without a shuffle.
FIT_PARTITIONS = 4


def clf_logreg(n_rows: int, max_iter: int = 1000) -> LogisticRegression:
    """Multinomial logistic regression; penalty 1/n equals C = 1 of a summed loss."""
    return LogisticRegression(
        family="multinomial", maxIter=max_iter, tol=TOLERANCE, regParam=1.0 / n_rows, standardization=False,
        labelCol="label_idx",
    )


def clf_random_forest(trees: int = 100, max_depth: int = MAX_DEPTH) -> RandomForestClassifier:
    """100 trees, as deep as Spark allows. Each row's nodes are kept, so that a level does not walk the trees from their roots."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, seed=SEED, labelCol="label_idx", maxMemoryInMB=1024, cacheNodeIds=True
    )


def clf_linear_svc(n_rows: int, max_iter: int = 1000) -> LinearSvm:
    """Linear SVM, one class against the rest; squared hinge loss, summed, and C = 1 whatever the number of rows."""
    return LinearSvm(max_iter=max_iter, tolerance=TOLERANCE)


def clf_gaussian_nb() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", labelCol="label_idx")


def clf_multinomial_nb() -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", smoothing=1.0, labelCol="label_idx")


def classifiers(n_rows: int, bayes: str = "gaussian") -> dict:
    """The four classifiers of a grid, by report name."""
    nb = ("Naive Bayes", clf_gaussian_nb()) if bayes == "gaussian" else ("Multinomial NB", clf_multinomial_nb())
    return {
        "Logistic Regression": clf_logreg(n_rows),
        "Random Forest": clf_random_forest(),
        "Linear SVC": clf_linear_svc(n_rows),
        nb[0]: nb[1],
    }


def with_label_index(df: DataFrame, label_col: str = "labels") -> tuple[DataFrame, list[str]]:
    """Labels to 0..k-1 in sorted order as ``label_idx``, and the label names."""
    model = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def _score(model, train: DataFrame, test: DataFrame) -> float:
    hit = F.when(F.col("prediction") == F.col("label_idx"), 1.0).otherwise(0.0)
    return float(model.fit(train).transform(test).agg(F.avg(hit)).first()[0] or 0.0)


def _split(df: DataFrame, split_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Persisted train and test features and the number of training rows.

    Partitions follow the bytes the vectors take: a fit has a job or more an iteration, and many fits run side by side.
    """
    parts = [df.filter(F.col(split_col) == s).select("features", "label_idx").persist() for s in ("train", "test")]
    v = F.unwrap_udt("features")
    width = F.size(v["values"]) * F.when(v["indices"].isNull(), 8).otherwise(12)
    sizes = [p.agg(F.count("*"), F.coalesce(F.avg(width), F.lit(0.0))).first() for p in parts]
    counts = [n for n, _ in sizes]
    train, test = (sized(p, n, ceil(each), FIT_PARTITIONS).persist() for p, (n, each) in zip(parts, sizes))
    # fill the caches before fits run side by side on them
    for kept, first in zip((train, test), parts):
        kept.count()
        if kept is not first:
            first.unpersist()
    return train, test, counts[0]


def accuracy_rows(
    settings: Sequence[tuple[tuple, DataFrame]], split_col: str, bayes: str, parallelism: int
) -> list[tuple]:
    """Test accuracy of four classifiers per setting ``(key, features)``.

    As many settings are held at once as fill the pool with their four fits, so that the copies of the corpus do not grow
    with the grid.
    """
    rows: list[tuple] = []
    at_once = max(1, parallelism // 4)
    for start in range(0, len(settings), at_once):
        some = settings[start : start + at_once]
        parts = [_split(df, split_col) for _, df in some]
        tasks, keys = [], []
        for (key, _), (train, test, n) in zip(some, parts):
            for name, model in classifiers(n, bayes).items():
                keys.append((*key, name))
                tasks.append(lambda m=model, a=train, b=test: _score(m, a, b))
        scores = run_parallel(tasks, parallelism)
        for train, test, _ in parts:
            train.unpersist()
            test.unpersist()
        rows += [(*key, score) for key, score in zip(keys, scores)]
    return rows


def _fit_rows(df: DataFrame, fit_scope: str, split_col: str) -> DataFrame:
    return df if fit_scope == "all" else df.filter(F.col(split_col) == "train")


def experiment_nmf(
    df: DataFrame,
    components: Sequence[int] = (8, 16, 32, 64, 128),
    max_features: int = 1000,
    max_iter: int = 500,
    split_col: str = "split",
    parallelism: int = 8,
    fit_scope: str = "train",
) -> DataFrame:
    """Accuracy of four classifiers on NMF weights, per number of topics.

    ``df``: doc_id, tokens, labels, split; materialise it first, each grid row reads it.
    """
    df, _ = with_label_index(df)
    fitted_on = _fit_rows(df, fit_scope, split_col)
    vectorizer = nested_vectorizers(term_stats(fitted_on), [max_features], fitted_on.count())[max_features]
    vectors = vectorizer.tfidf(df).drop("tokens").persist()
    train = vectors.filter(F.col(split_col) == "train")
    svd = lsa_fit(train, min(max(components), vectorizer.size - 1))
    settings = []
    for k in components:
        model = nmf_fit(train, k, vectorizer.size, max_iter, svd=svd)
        settings.append(((k,), scores_as_vector(model.transform(vectors).drop("features"))))
    rows = accuracy_rows(settings, split_col, "gaussian", parallelism)
    vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "n_components int, Classifier string, Accuracy double")


def experiment_lsa(
    df: DataFrame,
    max_features: Sequence[int] = (500, 1000, 2000),
    components: Sequence[int] = (50, 100, 200),
    split_col: str = "split",
    parallelism: int = 8,
    fit_scope: str = "train",
) -> DataFrame:
    """Accuracy on LSA scores per vocabulary size and k; one SVD per size, smaller k are its first columns."""
    df, _ = with_label_index(df)
    fitted_on = _fit_rows(df, fit_scope, split_col)
    sizes = nested_vectorizers(term_stats(fitted_on), list(max_features), fitted_on.count())
    rows = []
    for m in max_features:
        vectors = sizes[m].tfidf(df).drop("tokens").persist()
        vectors.count()
        svd = lsa_fit(_fit_rows(vectors, fit_scope, split_col), min(max(components), sizes[m].size - 1))
        scored = svd.transform(vectors).drop("features").persist()
        scored.count()
        settings = [((m, k), scores_as_vector(scored, k)) for k in components]
        rows += accuracy_rows(settings, split_col, "gaussian", parallelism)
        scored.unpersist()
        vectors.unpersist()
    schema = "max_features int, n_components int, Classifier string, Accuracy double"
    return df.sparkSession.createDataFrame(rows, schema)


def experiment_bow_tfidf(
    df: DataFrame,
    bow_features: Sequence[int] = (500, 1000, 2000),
    tfidf_features: Sequence[int] = (1000, 2000, 3000),
    split_col: str = "split",
    parallelism: int = 8,
    fit_scope: str = "train",
) -> DataFrame:
    """Accuracy on counts and on TF-IDF, with and without bigrams.

    Terms are counted once over unigrams and bigrams; unigram vocabularies are the terms without a blank.
    """
    df, _ = with_label_index(df)
    df = df.withColumn("grams", ngrams_1_2(F.col("tokens")))
    fitted_on = _fit_rows(df, fit_scope, split_col)
    n = fitted_on.count()
    stats = term_stats(fitted_on, "grams").persist()
    sizes = sorted({*bow_features, *tfidf_features})
    nested = {
        "(1, 1)": nested_vectorizers(stats.filter(~F.col("term").contains(" ")), sizes, n, "tokens"),
        "(1, 2)": nested_vectorizers(stats, sizes, n, "grams"),
    }
    stats.unpersist()
    rows = []
    for method, features in (("BoW", bow_features), ("TF-IDF", tfidf_features)):
        settings = []
        for m in features:
            for ngram in nested:
                vectorizer: Vectorizer = nested[ngram][m]
                vectors = vectorizer.counts(df) if method == "BoW" else vectorizer.tfidf(df)
                settings.append(((method, m, ngram), vectors))
        rows += accuracy_rows(settings, split_col, "multinomial", parallelism)
    schema = "Method string, max_features int, ngram_range string, Classifier string, Accuracy double"
    return df.sparkSession.createDataFrame(rows, schema)


def experiment_pca(
    df: DataFrame,
    k: int = 4,
    max_features: int = 1000,
    split_col: str = "split",
    parallelism: int = 8,
    fit_scope: str = "train",
) -> tuple[DataFrame, DataFrame]:
    """Terms of each component, and a classification report per classifier on the component scores."""
    df, names = with_label_index(df)
    fitted_on = _fit_rows(df, fit_scope, split_col)
    vectorizer = nested_vectorizers(term_stats(fitted_on), [max_features], fitted_on.count())[max_features]
    vectors = vectorizer.tfidf(df).drop("tokens").persist()
    pca = pca_fit(_fit_rows(vectors, fit_scope, split_col), k)
    topics = pca_topic_terms(pca.loadings(df.sparkSession), vectorizer)
    train, test, n = _split(scores_as_vector(pca.transform(vectors).drop("features")), split_col)
    models = classifiers(n)

    def predict(name: str) -> DataFrame:
        scored = models[name].fit(train).transform(test)
        return scored.select(F.lit(name).alias("Classifier"), "label_idx", F.col("prediction").alias("pred"))

    predictions = run_parallel([lambda n=n: predict(n) for n in models], parallelism)
    union = predictions[0]
    for part in predictions[1:]:
        union = union.unionByName(part)
    lookup = F.array(*map(F.lit, names))
    named = union.select("Classifier", *[F.get(lookup, F.col(c).cast("int")).alias(a) for c, a in (("label_idx", "label"), ("pred", "pred"))])
    return topics, classification_report(named, by=["Classifier"])


@dataclass(frozen=True)
class TopicPredictor:
    """TF-IDF, NMF weights and a classifier, fitted together; scores rows that only have tokens."""

    vectorizer: Vectorizer
    topics: NmfModel
    classifier: Model
    names: list[str]

    def transform(self, df: DataFrame, out_col: str = "Predicted Class Index") -> DataFrame:
        """``df`` (``tokens`` and more) with the name of the predicted class."""
        weights = scores_as_vector(self.topics.transform(self.vectorizer.tfidf(df)).drop("features"))
        scored = self.classifier.transform(weights)
        name = F.get(F.array(*map(F.lit, self.names)), F.col("prediction").cast("int"))
        return scored.withColumn(out_col, name).select(*df.columns, out_col)


def fit_predictor(
    train: DataFrame, k: int = 32, max_features: int = 1000, max_iter: int = 200, label_col: str = "labels"
) -> TopicPredictor:
    """Fit on training rows (``tokens`` and a label) only; vocabulary, idf, topics and penalty all come from them."""
    indexed, names = with_label_index(train, label_col)
    n = train.count()
    vectorizer = nested_vectorizers(term_stats(train), [max_features], n)[max_features]
    vectors = vectorizer.tfidf(indexed).drop("tokens").persist()
    topics = nmf_fit(vectors, k, vectorizer.size, max_iter)
    weights = scores_as_vector(topics.transform(vectors).drop("features")).select("features", "label_idx").persist()
    classifier = clf_logreg(n).fit(weights)
    weights.unpersist()
    vectors.unpersist()
    return TopicPredictor(vectorizer, topics, classifier, names)


def predict_new(model: TopicPredictor, df: DataFrame) -> DataFrame:
    """Score unseen rows; the label name is in ``Predicted Class Index``."""
    return model.transform(df)
