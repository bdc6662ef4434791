"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A document holds a window only
if it holds all of its words, so with words ordered by rarity a prefix of one word, the rarest, is necessary: rarity is
counted over all documents. Documents' words are joined with these anchors; a match says where the window would start,
which the document's length and the position bound, and the words there are then compared with the window exactly.

The windows are broadcast in blocks of at most ``BLOCK_WINDOWS``; a larger benchmark takes several passes over the
documents, never a join that moves their words. All of it is DataFrame functions. What is shuffled is a row per document
and per match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctopics.llm.base import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK_WINDOWS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and takes runs of digits, a-z and characters beyond ASCII; null and empty texts have none."""
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, gram, len)``: the different windows of each item."""

    def grams(w: Column) -> Column:
        size = F.least(F.size(w), F.lit(window))
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size))

    words = items.select("item_id", words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    return words.select("item_id", F.explode(let(F.col("_w"), grams)).alias("gram")).distinct().withColumn("len", F.size("gram"))


def anchored(windows: DataFrame, docs: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Each window with its rarest word (``anchor``) and that word's first position (``shift``); impossible ones dropped."""
    vocabulary = windows.select(F.explode("gram").alias("word")).distinct()
    small = vocabulary.limit(block_windows + 1).count() <= block_windows
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    counts = words.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    each = windows.select("item_id", "gram", "len", F.posexplode("gram").alias("shift", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "shift")).alias("r")
    best = each.groupBy("gram", "len").agg(rarest, F.collect_set("item_id").alias("items"))
    return best.filter("r.n > 0").select("items", "gram", "len", F.col("r.word").alias("anchor"), F.col("r.shift").alias("shift"))


def _matches(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows ``(_row, doc_id, n_words, start, len, items)``: every match, and a row without one for each document."""
    split = docs.select("_row", "doc_id", words_of(F.col("text")).alias("_w"))
    each = split.select("_row", "doc_id", "_w", F.size("_w").alias("n_words"), F.posexplode_outer("_w").alias("_at", "_word"))
    start = F.col("_at") - F.col("shift")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.when(fits, F.slice("_w", start + 1, F.col("len")) == F.col("gram")).otherwise(False)
    found = each.join(F.broadcast(anchors), (F.col("_word") == F.col("anchor")) & same, "left")
    found = found.filter(F.col("anchor").isNotNull() | F.col("_at").isNull() | (F.col("_at") == 0))
    return found.select("_row", "doc_id", "n_words", start.alias("start"), "len", "items")


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``(_row, doc_id, n_words, spans, items)`` per row of ``docs``: spans ``(start, len)`` of occurring windows, item ids.

    Null ids stay null; items without an id hit words but are not listed. Repeated items count once, repeated document
    rows give a row each. Other columns of either table are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    anchors = anchored(item_windows(items.select("item_id", "text"), window), docs, block_windows).persist()
    blocks = max(1, -(-anchors.count() // block_windows))
    # each block has about block_windows rows, whatever the size of the benchmark
    parts = [anchors.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_matches(docs, part) for part in parts])
    span = F.when(F.col("len").isNotNull(), F.struct("start", "len"))
    return found.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(span).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """How many words the spans cover."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(spans), none, add, lambda acc: acc["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` for each row of ``docs``."""
    found = find_items(docs, items, window, block_windows)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with their columns."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"), F.length("text")]
    keyed = docs.select(*docs.columns, F.concat_ws("-", *key).alias("_decontaminate_key"))
    texts = keyed.select(F.col("_decontaminate_key"), F.col("doc_id"), "text")
    marked = texts.withColumn("doc_id", F.xxhash64("_decontaminate_key"))
    bad = contamination(marked, items, window).filter("contaminated").select(F.col("doc_id").alias("_decontaminate_bad")).distinct()
    return keyed.join(bad, F.xxhash64("_decontaminate_key") == F.col("_decontaminate_bad"), "left_anti").drop("_decontaminate_key")
