"""Term statistics and document vectors.

Input is one row per document with a token array. Statistics explode tokens into a map-side combined
count; vectors are made row by row from a bounded vocabulary, so building bags or TF-IDF needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doctopics.runtime import broadcast_within, one_row


def top_rows(df: DataFrame, n: int, order: list, by: list[str] | None = None, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank; the limit is also applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))
    return df.withColumn(rank_col, rank).filter(F.col(rank_col) <= n)


# ---------------------------------------------------------------- counts per term


def explode_tokens(df: DataFrame, tokens_col: str = "tokens", keep: list[str] = ()) -> DataFrame:
    """One row per token.

    A plain explode makes the optimizer add a filter on the array's size below the projection, which
    would tokenise every text a second time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(tokens_col).alias("term")).filter(F.col("term").isNotNull())


def term_frequency(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Occurrences per term."""
    return explode_tokens(df, tokens_col).groupBy("term").agg(F.count("*").alias("tf"))


def document_frequency(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Documents per term; duplicates are removed inside the row, not by a shuffle."""
    terms = df.select(F.explode(F.array_distinct(tokens_col)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def term_stats(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Both counts in one pass: tokens sorted within the row, first of each run marked."""
    ordered = df.select(F.array_sort(tokens_col).alias("t"))
    marked = F.transform(
        F.col("t"),
        lambda x, i: F.struct(
            x.alias("term"), F.when((i > 0) & (x == F.get(F.col("t"), i - 1)), 0).otherwise(1).alias("first")
        ),
    )
    return (
        ordered.select(F.inline(marked))
        .groupBy("term")
        .agg(F.count("*").alias("tf"), F.sum("first").alias("df"))
    )


def vocab_top_n(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent terms (ties: term order); ids follow term order."""
    return _with_ids(stats.orderBy(F.desc("tf"), "term").limit(n))


def dictionary_filter(
    stats: DataFrame, n_docs: int, no_below: int = 5, no_above: float = 0.8, keep_n: int = 5000
) -> DataFrame:
    """Terms in at least ``no_below`` and at most ``no_above`` of the documents, the ``keep_n`` most spread."""
    kept = stats.filter((F.col("df") >= no_below) & (F.col("df") <= no_above * n_docs))
    return _with_ids(kept.orderBy(F.desc("df"), "term").limit(keep_n))


def _with_ids(bounded: DataFrame) -> DataFrame:
    # Global rank over the bounded vocabulary only.
    term_id = F.row_number().over(Window.orderBy("term")) - 1
    return bounded.withColumn("term_id", term_id.cast("int")).select("term_id", "term", "tf", "df")


# ---------------------------------------------------------------- vectors


@dataclass(frozen=True)
class Vectorizer:
    """Vocabulary of bounded size with document counts: fitted on one table, applied to any."""

    terms: list[str]
    df: list[int]
    n_docs: int
    tokens_col: str = "tokens"

    @property
    def size(self) -> int:
        return len(self.terms)

    @property
    def idf(self) -> list[float]:
        """ln((1 + n) / (1 + df)) + 1."""
        return [log((1 + self.n_docs) / (1 + d)) + 1 for d in self.df]

    def counts(self, df: DataFrame, out_col: str = "features") -> DataFrame:
        """Sparse count vectors; unknown terms are dropped."""
        model = CountVectorizerModel.from_vocabulary(self.terms, inputCol=self.tokens_col, outputCol=out_col)
        return model.transform(df)

    def tfidf(self, df: DataFrame, out_col: str = "features") -> DataFrame:
        """Counts weighted by idf, each row scaled to length one."""
        counted = self.counts(df, "_counts")
        scaler = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted")
        normal = Normalizer(p=2.0, inputCol="_weighted", outputCol=out_col)
        return normal.transform(scaler.transform(counted)).drop("_counts", "_weighted")

    def vocabulary(self, spark) -> DataFrame:
        """``(term_id, term)``, at most ``size`` rows."""
        return spark.createDataFrame(list(enumerate(self.terms)), "term_id int, term string")

    def with_terms(self, long: DataFrame) -> DataFrame:
        """Add the term to rows holding a ``term_id``."""
        return long.join(broadcast_within(self.vocabulary(long.sparkSession), self.size), "term_id")


def fit_vectorizer(
    df: DataFrame, max_features: int = 5000, tokens_col: str = "tokens", n_docs: int | None = None
) -> Vectorizer:
    """Vocabulary of the most frequent terms. Only ``max_features`` rows reach the driver."""
    n_docs = df.count() if n_docs is None else n_docs
    return vectorizer_from(vocab_top_n(term_stats(df, tokens_col), max_features), n_docs, tokens_col)


def vectorizer_from(vocabulary: DataFrame, n_docs: int, tokens_col: str = "tokens") -> Vectorizer:
    rows = vocabulary.orderBy("term_id").collect()
    return Vectorizer([r["term"] for r in rows], [r["df"] for r in rows], n_docs, tokens_col)


def long_form(df: DataFrame, id_col: str = "doc_id", vector_col: str = "features", keep: list[str] = ()) -> DataFrame:
    """Sparse vectors as rows ``(doc_id, term_id, weight)``, unpacked within the row."""
    parts = df.select(id_col, *keep, F.unwrap_udt(vector_col).alias("v"))
    cells = F.arrays_zip(F.col("v.indices").alias("term_id"), F.col("v.values").alias("weight"))
    return parts.select(id_col, *keep, F.inline(cells))


def nested_vectorizers(
    stats: DataFrame, sizes: list[int], n_docs: int, tokens_col: str = "tokens"
) -> dict[int, Vectorizer]:
    """Vectorizers of several vocabulary sizes from one ranking: the smaller ones are prefixes of it."""
    ranked = stats.orderBy(F.desc("tf"), "term").limit(max(sizes)).collect()
    ranked.sort(key=lambda r: (-r["tf"], r["term"]))
    out = {}
    for n in sizes:
        rows = sorted(ranked[:n], key=lambda r: r["term"])
        out[n] = Vectorizer([r["term"] for r in rows], [r["df"] for r in rows], n_docs, tokens_col)
    return out


def bag_of_words(df: DataFrame, vectorizer: Vectorizer, id_col: str = "doc_id") -> DataFrame:
    bag = long_form(vectorizer.counts(df), id_col)
    return bag.select(id_col, "term_id", F.col("weight").cast("long").alias("cnt"))


def tfidf(df: DataFrame, vectorizer: Vectorizer, id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    return long_form(vectorizer.tfidf(df), id_col, keep=keep)


def vectorize_many(
    df: DataFrame, max_features: int = 5000, weighting: str = "tfidf", split_col: str = "split", tokens_col: str = "tokens"
) -> tuple[Vectorizer, DataFrame]:
    """Fit on rows whose split name contains ``train``, transform all splits in one pass."""
    fitted = fit_vectorizer(df.filter(F.col(split_col).contains("train")), max_features, tokens_col)
    return fitted, getattr(fitted, "tfidf" if weighting == "tfidf" else "counts")(df)


# ---------------------------------------------------------------- reports


def top_terms_per_doc(weights: DataFrame, vectorizer: Vectorizer, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Highest weighted terms of each document, picked within the row from ``weights``' vector column."""
    v = F.unwrap_udt("features")
    parts = weights.select(id_col, v.alias("v")).select(id_col, "v.indices", "v.values")
    # Vocabulary ids follow term order, so (-weight, id) is also the tie order by term.
    cells = F.zip_with("indices", "values", lambda i, w: F.struct((-w).alias("neg"), i.alias("term_id")))
    best = F.slice(F.array_sort(cells), 1, n)
    picked = parts.select(id_col, F.posexplode(best).alias("pos", "cell")).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("cell.term_id").alias("term_id"), (-F.col("cell.neg")).alias("weight")
    )
    return vectorizer.with_terms(picked).select(id_col, "rank", "term", "weight")


def matrix_stats(df: DataFrame, n_cols: int, vector_col: str = "features") -> DataFrame:
    """Shape, filled cells, sparsity in percent and filled cells per row."""
    filled = df.select(F.size(F.unwrap_udt(vector_col)["indices"]).cast("long").alias("nnz"))
    sums = filled.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"))
    cells = F.col("n_rows") * F.lit(n_cols)
    return sums.select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_cols"),
        "nnz",
        ((1 - F.try_divide(F.col("nnz"), cells)) * 100).alias("sparsity_pct"),
        F.try_divide("nnz", "n_rows").alias("mean_nnz"),
    )


def term_weight_extremes(weights: DataFrame, vectorizer: Vectorizer, n: int = 10) -> DataFrame:
    """Terms with the largest and the smallest summed weight."""
    sums = weights.groupBy("term_id").agg(F.sum("weight").alias("total"))
    totals = vectorizer.with_terms(sums).select("term", F.round("total", 9).alias("total"))
    high = top_rows(totals, n, [F.desc("total"), "term"]).withColumn("kind", F.lit("largest"))
    low = top_rows(totals.filter("total > 0"), n, ["total", "term"]).withColumn("kind", F.lit("smallest"))
    return high.unionByName(low).select("kind", "rank", "term", "total")


def corpus_stats(df: DataFrame, tokens_col: str = "tokens", split_col: str = "split", **limits) -> DataFrame:
    """Documents per split, vocabulary before and after filtering, known distinct terms per training document."""
    train = df.filter(F.col(split_col) == "train")
    sizes = df.groupBy().agg(
        F.count_if(F.col(split_col) == "train").alias("n_train"), F.count_if(F.col(split_col) == "test").alias("n_test")
    )
    stats = term_stats(train, tokens_col)
    n_train = train.count()
    fitted = vectorizer_from(dictionary_filter(stats, n_train, **limits), n_train, tokens_col)
    mean = matrix_stats(fitted.counts(train), max(fitted.size, 1)).select(F.col("mean_nnz").alias("mean_distinct_terms"))
    before = stats.agg(F.count("*").alias("vocab_before"))
    after = F.lit(fitted.size).cast("long").alias("vocab_after")
    return one_row(sizes, before, mean).select("n_train", "n_test", "vocab_before", after, "mean_distinct_terms")


def top_terms_by_df(stats: DataFrame, n: int = 10) -> DataFrame:
    """Terms contained in most documents."""
    return stats.select("term", "df").orderBy(F.desc("df"), "term").limit(n)


def vocab_sample(vocabulary: DataFrame, size: int, slices: list[tuple[int, int]] | None = None) -> DataFrame:
    """Slices of the sorted vocabulary: the start, positions 1000-1019 and the end."""
    slices = slices or [(0, 20), (1000, 1020), (max(size - 20, 0), size)]
    hit = F.lit(False)
    for start, end in slices:
        hit = hit | F.col("term_id").between(start, end - 1)
    return vocabulary.filter(hit).select("term_id", "term")


def class_word_frequencies(
    df: DataFrame, n: int = 2500, by: list[str] = ("split", "labels"), tokens_col: str = "tokens"
) -> DataFrame:
    """Most frequent words per class (and split)."""
    by = list(by)
    counts = explode_tokens(df, tokens_col, by).groupBy(*by, "term").agg(F.count("*").alias("n"))
    order = [F.desc("n"), "term"]
    # Rank inside 64 slices of each class first: the words of a large class never meet in one task.
    sliced = counts.withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(64)))
    best = top_rows(sliced, n, order, [*by, "_slice"]).drop("rank", "_slice")
    return top_rows(best, n, order, by)


def top_terms_per_class(df: DataFrame, vectorizer: Vectorizer, label_col: str = "labels", n: int = 10) -> DataFrame:
    """Terms with the largest summed TF-IDF weight per class."""
    cells = tfidf(df, vectorizer, keep=[label_col])
    sums = cells.groupBy(label_col, "term_id").agg(F.sum("weight").alias("weight"))
    named = vectorizer.with_terms(sums).withColumn("weight", F.round("weight", 9))
    return top_rows(named, n, [F.desc("weight"), "term"], [label_col]).select(label_col, "rank", "term", "weight")

