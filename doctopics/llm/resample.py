"""Importance resampling towards a target: hashed n-gram gains, and a seeded Gumbel draw of the best documents.

Texts become n-grams by Arrow kernels: lower-cased, split at what is no word character, flattened and dictionary encoded;
pairs of shifted indices are the bigrams, and each distinct word or pair is hashed (CRC-32) once in a slice of about a
megabyte of text. A first pass counts the buckets of all documents and of all target texts, a second takes every
n-gram's gain and reduces by document. What leaves a task is a row per bucket, then a row per document.

The draw is exact: scores are whole numbers, so a count per score says how many documents stand before each, and rows are
numbered only within a score. Gumbel noise of a scale of 1000 spreads equal weights over thousands of scores, so no score
is a large share of all rows, whatever the documents are.

Null texts have no words: no features, weight 0, never drawn. A null id is hashed as an empty text and comes last among
equal scores. Repeated ids are rows of their own; rows equal in id and text are interchangeable. An empty target or corpus
counts nothing. Other columns are not looked at, but for ``draw_documents``, which returns them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctopics.llm.base import materialise
from doctopics.llm.text import pieces
from doctopics.runtime import broadcast_within

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text whose A-Z are lower-cased
BUCKETS = 10_000
SCALE = 1000
SEED = "7"
PERCENT = 25
MIN_WORDS = 20
_MADE = ("n_words", "n_features", "weight", "score", "rank")


def grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the bucket of each word and that of each pair of neighbours, both in order of texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NOT_WORD)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    whole = pc.not_equal(pc.binary_length(words), 0)  # a text that starts or ends with a separator has empty parts
    words, owner = words.filter(whole), owner.filter(whole).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    follows = owner[1:] == owner[:-1]
    pairs = pa.array((at[:-1] * len(distinct) + at[1:])[follows]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(zero_copy_only=False), max(1, len(distinct)))
    tails = [b" " + w for w in distinct]
    # a pair's CRC goes on from that of its first word
    pair_crc = map(zlib.crc32, map(tails.__getitem__, right.tolist()), crc[left].tolist())
    two = np.fromiter(pair_crc, np.int64, len(left))[pairs.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(owner, minlength=len(lists)), crc[at] % buckets, two % buckets


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``."""
    upto, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in pieces(batches):
            for found in grams(part.column(0), buckets)[1:]:
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> dict[int, int]:
    """N-grams of all texts by bucket; at most ``buckets`` numbers."""
    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(buckets), "bucket int, n long")
    return dict(counted.groupBy("bucket").agg(F.sum("n")).collect())


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths of a nat."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratios = (((target.get(k, 0) + 1) * s_all) / ((corpus.get(k, 0) + 1) * t_all) for k in range(buckets))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratios], np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_weighed`` of ``n_words``, ``n_features`` and ``weight`` (floored mean gain)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, weight: bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = shared.value
        for batch in batches:
            rows = []
            for part in pieces(iter([pa.record_batch([batch], ["text"])])):
                words, one, two = grams(part.column(0), len(gain))
                joined = np.maximum(words - 1, 0)
                n = words + joined
                total = segment_sums(gain[one], words) + segment_sums(gain[two], joined)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                fields = [pa.array(x.astype(np.int64)) for x in (words, n, weight)]
                rows.append(pa.StructArray.from_arrays(fields, ["n_words", "n_features", "weight"]))
            kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
            yield pa.concat_arrays(rows) if rows else pa.array([], kind)

    return docs.withColumn("_weighed", weigh.asNondeterministic()(F.col(text).cast("string")))


def gumbel_score(weight: Column, doc_id: Column, seed: str = SEED) -> Column:
    """Weight plus seeded Gumbel noise of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return weight + F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _cut(scored: DataFrame, percent: int, min_words: int) -> tuple[int, DataFrame, int | None]:
    """How many are drawn, rows per score with those before each (highest first), and the lowest score drawn."""
    sizes = scored.filter(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("_in"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row a score: thousands
    sizes = materialise(sizes.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))), "scores")
    found = sizes.agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("n"), F.count("*").alias("scores")).first()
    drawn = percent * found["n"] // 100
    lowest = sizes.filter(F.col("_before") < drawn).agg(F.min("score")).first()[0]
    return drawn, broadcast_within(sizes.drop("_in"), found["scores"]), lowest


def fit_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket for documents of ``docs`` that should look like ``target``."""
    return bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    buckets: int = BUCKETS,
    seed: str = SEED,
    min_words: int = MIN_WORDS,
    gains: np.ndarray | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (null if not drawn), a row per document.

    ``percent`` of the documents with ``min_words`` are drawn, highest scores first, ties by id. ``target`` has ``text``; known
    ``gains`` save the counting.
    """
    gains = fit_gains(docs, target, buckets) if gains is None else gains
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_weights(light, gains).select("doc_id", "_weighed.*").withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed))
    scored = materialise(scored, "scored")  # texts are read once for it
    drawn, before, lowest = _cut(scored, percent, min_words)
    chosen = F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= F.lit(lowest)), F.lit(False))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    ranked = scored.filter(chosen).withColumn("_at", F.row_number().over(order)).join(before, "score")
    place = F.col("_before") + F.col("_at")
    ranked = ranked.withColumn("rank", F.when(place <= drawn, place).cast("long"))
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", *_MADE]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def draw_documents(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    buckets: int = BUCKETS,
    seed: str = SEED,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns.

    The last drawn score and id decide each row by itself, so nothing is joined; rows that repeat that id with the same
    score all come along.
    """
    gains = fit_gains(docs, target, buckets)
    ranked = materialise(importance_resample(docs, target, percent, buckets, seed, min_words, gains), "ranked")
    last = ranked.filter("rank IS NOT NULL").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("x")).first()["x"]
    if last is None:
        return docs.limit(0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = gumbel_score(F.col("_weighed.weight"), F.col("doc_id"), seed)
    tied = (score == last["score"]) & (F.coalesce(F.col("doc_id") <= F.lit(last["doc_id"]), F.lit(last["doc_id"] is None)))
    inside = (F.col("_weighed.n_words") >= min_words) & ((score > last["score"]) | tied)
    return with_weights(packed, gains).filter(inside).select("_row.*")
