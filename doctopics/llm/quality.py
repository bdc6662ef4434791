"""Quality rules: word and line counts, and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits and runs of other signs. Unigrams and bigrams of tokens are hashed into a fixed
number of buckets. The raw multinomial counts the buckets of all documents, the target multinomial those of trusted ones,
up to ``max_trusted`` of them, chosen by a hash of their id. A document's score is the mean over its n-grams of
log(target / raw); every document with at least ``threshold`` passes. Only the bucket table is broadcast whole, and its
size is the parameter ``buckets``.

A mean hides a few insults in a long text, so toxic documents are found by markers beside it: n-grams (by their 64-bit
hashes, so that frequent ones do not share a marker's bucket) that documents labelled toxic contain far more often than those
labelled not toxic, good or poor. What more labels would only repeat is kept out of the evidence:

- At most ``max_labelled`` documents of each kind are compared, those with the smallest id hashes.
- Near copies count once: of the documents of a kind that share the smallest hash of their five-word windows, one speaks.
- An n-gram is a marker if it is ``exp(EFFECT)`` times as frequent among toxic documents and its log-likelihood ratio
  statistic is too large for chance among all n-grams tested (Bonferroni, ``FALSE_MARKERS``).
- Two thirds of the classes of copies choose the markers. The clean documents of the last third set the threshold: at most
  ``CLEAN_LOSS`` of them are above it.

A document's markers add up, with the logarithm of the ratio of the two document frequencies each, whatever the length of
the text; it fails if they exceed the threshold. With too few labels no n-gram is significant and nothing is dropped.

All of it is DataFrame functions. A text is read twice, once to count and once to score, and labelled ones once more; what
is shuffled is a row for each document, bucket or n-gram of a labelled document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctopics.llm.base import let, materialise
from doctopics.runtime import counted_broadcast

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOL = r"[#*$%&|<>]"
BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
SMOOTHING = 1.0
# Mean log ratio below which a document fails: clearly less likely as a target text than as any text of the corpus.
THRESHOLD = -0.25
MAX_LABELLED = 5_000
# Least log ratio of a marker's document frequencies: 20 to 1.
EFFECT = 3.0
# Chance that any n-gram is a marker although it says nothing.
FALSE_MARKERS = 0.05
# Share of clean documents, not seen when the markers were chosen, that may be above the threshold.
CLEAN_LOSS = 0.005
HELD_OUT = 3
COPY_WORDS = 5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur more than once among ``words``."""

    def repeated(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 1)
        pairs = F.sort_array(F.zip_with(hashes, at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                before = F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]).otherwise(False)
                return before | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(pairs, starts),
            none,
            lambda acc, i: F.struct(
                (i + window).alias("end"), (acc["n"] + window - F.greatest(F.lit(0), acc["end"] - i)).alias("n")
            ),
            lambda acc: acc["n"],
        )

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(0))
        return F.when(F.size(w) > window, some).otherwise(0)

    # a word is hashed once, not once a window
    return let(F.transform(words, lambda x: F.xxhash64(x)), count)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return F.when(text.contains("\n"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)


def base_counts(text: Column, words: Column | None = None) -> dict[str, Column]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of one text (null: zeros).

    ``words`` are those of the text, where a column holds them already.
    """
    words = words_of(text) if words is None else words
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": dup_lines(text).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def gram_hashes(text: Column) -> Column:
    """Hash of each unigram and bigram."""

    def grams(t: Column) -> Column:
        pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        return F.concat(F.transform(t, lambda x: F.xxhash64(x)), F.filter(pairs, lambda x: x.isNotNull()))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), grams)


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def _chosen(ids: DataFrame, most: int) -> DataFrame:
    """``most`` of the different ids, those with the smallest hashes."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """``(bucket, w)``: log ratio of the target's and the raw corpus's smoothed multinomials, at most ``buckets`` rows.

    ``trusted`` has ``doc_id``; ``max_trusted`` of its ids are used, those with the smallest hashes.
    """
    chosen = _chosen(trusted, max_trusted).withColumn("_t", F.lit(1))
    # at most max_trusted ids
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left")
    grams = marked.select("_t", F.explode(gram_hashes(F.coalesce("text", F.lit("")))).alias("gram"))
    grams = grams.select("_t", bucket_of(F.col("gram"), buckets).alias("bucket"))
    # written once, or the texts would be read again for the totals
    counts = materialise(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_t").alias("target")), "buckets")
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()
    room = SMOOTHING * buckets
    target = F.log((F.col("target") + SMOOTHING) / F.lit(totals["t"] + room))
    # an occurrence is no evidence of its own, or n-grams of one document alone would speak against it
    raw = F.log((F.col("raw") - 1 + SMOOTHING) / F.lit(totals["r"] + room))
    return counts.select("bucket", (target - raw).alias("w"))


def copy_key(text: Column, window: int = COPY_WORDS) -> Column:
    """Smallest hash of the windows of ``window`` words: nearly equal texts nearly always share it."""

    def least(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) >= window, F.array_min(hashes)).otherwise(F.xxhash64(w))

    return let(words_of(text), least)


def toxic_markers(docs: DataFrame, toxic: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """``(gram, x)``, n-grams that mark toxic documents with the log ratio of their document frequencies, and a threshold.

    ``toxic`` has ``doc_id`` and ``toxic`` (1 or 0); an id with both is toxic, null ids are left out. The markers are at
    most the n-grams of ``max_labelled`` documents.
    """
    marked, clean = (_chosen(toxic.filter(F.col("toxic") == x), max_labelled).withColumn("x", F.lit(x)) for x in (1, 0))
    labelled = marked.unionByName(clean).groupBy("doc_id").agg(F.max("x").alias("x"))
    # at most 2 * max_labelled ids
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.join(F.broadcast(labelled), "doc_id")
    found = materialise(found.select("doc_id", "x", copy_key(F.col("text")).alias("key"), gram_hashes(F.col("text")).alias("grams")), "labelled")
    # one document speaks for its copies
    speaking = found.groupBy("key", "x").agg(F.min("doc_id").alias("doc_id"))
    found = found.join(F.broadcast(speaking), ["key", "x", "doc_id"]).dropDuplicates(["key", "x"])  # repeated rows
    apart = F.pmod("key", F.lit(HELD_OUT)) == 0

    # a last entry without n-gram counts the documents
    own = F.array_append(F.array_distinct("grams"), F.lit(None).cast("long"))
    counts = found.filter(~apart).select("x", F.explode(own).alias("gram")).groupBy("gram")
    counts = counts.agg(F.sum("x").alias("a"), F.sum(1 - F.col("x")).alias("b"))
    counts = materialise(counts.filter("a > 1 OR gram IS NULL"), "toxic_counts")
    of = counts.filter("gram IS NULL").first()
    all_a, all_b = (of["a"], of["b"]) if of else (0, 0)
    tested = max(1, counts.count() - 1)
    a, b, n = F.col("a"), F.col("b"), max(1, all_a + all_b)

    def part(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    rest = all_a - a + all_b - b
    g = 2 * (part(a, a + b, all_a) + part(b, a + b, all_b) + part(all_a - a, rest, all_a) + part(all_b - b, rest, all_b))
    x = F.log((a + 0.5) / F.lit(all_a + 1.0)) - F.log((b + 0.5) / F.lit(all_b + 1.0))
    # the tail of the statistic is below exp(-g / 2)
    significant = g >= 2 * math.log(tested / FALSE_MARKERS)
    markers = counts.filter("gram IS NOT NULL").withColumn("x", x).filter((F.col("x") >= EFFECT) & significant).select("gram", "x")
    markers = materialise(markers, "markers")

    held = found.filter(apart & (F.col("x") == 0))
    allowed = int(CLEAN_LOSS * held.count())
    scores = held.select("doc_id", "key", F.explode("grams").alias("gram")).join(markers, "gram")
    highest = scores.groupBy("doc_id", "key").agg(F.sum("x").alias("s")).orderBy(F.desc("s")).limit(allowed + 1).collect()
    return markers, float(highest[allowed]["s"]) if len(highest) > allowed else 0.0


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    max_trusted: int = MAX_TRUSTED,
    toxic: DataFrame | None = None,
) -> DataFrame:
    """``doc_id``, the base counts, ``n_grams``, ``toxic_score``, ``llr`` (mean log ratio, 0 without n-grams),
    ``toxic`` (whether it exceeds the threshold), ``base_failed``, ``kept``.

    One row for each row of ``docs``. Null texts have no words and fail. Rows with null or repeated ids are scored like
    others. Without trusted documents all ratios come from the raw counts alone. ``toxic`` has the ``doc_id`` of
    labelled documents and their label ``toxic`` (1 or 0), repeated ids included; without it ``toxic_score`` is 0.
    """
    return _judged(_scored(docs, trusted, buckets, max_trusted, toxic), threshold).drop("_row")


def _scored(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int,
    max_trusted: int,
    toxic: DataFrame | None = None,
    learn_from: DataFrame | None = None,
) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    learn_from = docs if learn_from is None else learn_from
    ratios = log_ratios(learn_from, trusted, buckets, max_trusted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text.alias("text"))
    rows = rows.withColumn("_words", words_of(F.col("text")))  # a column of its own, or each count would split the text again
    base = base_counts(F.col("text"), F.col("_words"))
    counted = rows.select("doc_id", "_row", *[c.alias(n) for n, c in base.items()], gram_hashes(F.col("text")).alias("_g"))
    # a first entry that is no n-gram carries the counts, so that one pass gives both
    none = F.lit(None).cast("long")
    each = counted.select("doc_id", "_row", *base, F.posexplode(F.array_prepend("_g", none)).alias("_at", "gram"))
    head = F.col("_at") == 0
    # the table has at most `buckets` rows
    joined = each.withColumn("bucket", bucket_of(F.col("gram"), buckets)).join(F.broadcast(ratios), "bucket", "left")
    limit = 0.0
    if toxic is None:
        joined = joined.withColumn("x", F.lit(0.0))
    else:
        markers, limit = toxic_markers(learn_from, toxic)
        joined = joined.join(counted_broadcast(markers), "gram", "left")
    scored = joined.groupBy("_row").agg(
        F.max(F.when(head, F.col("doc_id"))).alias("doc_id"),
        *[F.sum(F.when(head, F.col(n))).alias(n) for n in base],
        (F.count("*") - 1).alias("n_grams"),
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("toxic_score"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("_sum"),
    )
    return scored.withColumn("toxic", F.col("toxic_score") > limit)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n_grams") > 0, F.col("_sum") / F.col("n_grams")).otherwise(0.0)
    return (
        scored.withColumn("base_failed", failed)
        .withColumn("llr", llr)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & ~F.col("toxic"))
        .drop("_sum")
    )


def keep_good(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, toxic: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Rows are joined back by a hash of id and text, so that copies of one text are not one key.
    """
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), F.length("text"))
    texts = docs.select(F.col("doc_id"), "text", key.alias("_quality_key"))
    ratios_of = texts.select("doc_id", "text")
    scored = _scored(texts.select(F.col("_quality_key").alias("doc_id"), "text"), trusted, BUCKETS, MAX_TRUSTED, toxic, ratios_of)
    good = _judged(scored, threshold).filter("kept").select(F.col("doc_id").alias("_quality_good")).distinct()
    return docs.join(good, key == F.col("_quality_good"), "left_semi")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")
