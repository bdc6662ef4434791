"""Phrase collocations by dynamic itemset counting: phrases of two and three words are counted as soon as their parts are.

The corpus is dealt to ``shards`` that are scanned cyclically. Words are counted from the first scan on. After each scan,
pairs whose words have both reached ``min_count`` become active, and so do triples both of whose pairs have; an active
phrase is counted from the next scan on, until it has seen every shard once. Lengths thus interleave: a scan counts words,
pairs and triples that started at different shards. A phrase that reaches ``min_count`` has parts that do, so every one
becomes active and gets its whole count.

Which words and pairs have been reached is told to the tasks by bitmaps of ``bits`` bits, one for each scan, indexed by hash.
Their size does not depend on the data. A bit may stand for a wrong phrase too; that activates more phrases than needed,
which are counted whole as well and then fall below ``min_count``, so results are exact at every size.

Phrases are keyed by the 64-bit hashes of their words, which include the language; a phrase's count is exact if no frequent
word shares its hash with another one. That is checked, and the counting starts again with another seed if it happens.
Counts meet in map-side combined aggregations by phrase, so no language, word or passage is one task. What is written
between scans is only phrases that have not seen all shards, and frequent ones.

Null languages are ``und``, null texts are empty. Repeated rows and ids count each time; ids and other columns are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctopics.llm.base import materialise
from doctopics.llm.text import ASCII_LOWER, flat, mix, owners, pieces, signed, word_spans
from doctopics.operators.terms import top_rows

SHARDS = 2
MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
ABSORB_PERCENT = 50
SCORE_UNIT = 1_000_000
BITS = 1 << 23
SLICES = 64
SLICE_BYTES = 1 << 20
NO_LANGUAGE = "und"
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False
NEVER = np.int64(1 << 40)
PAIR = "a long, b long"


# ---------------------------------------------------------------- a slice of texts


class Words:
    """Words of a slice of texts: hash of each with its language, whether the next one goes on in its piece, and counts."""

    def __init__(self, part: pa.RecordBatch, seed: int, hash_word: Callable[[bytes, int], int]):
        data, offs = flat(part.column("text"))
        data = ASCII_LOWER[data]
        starts, ends, word_offs = word_spans(data, offs, INSIDE)
        text_of = owners(word_offs)
        piece = np.concatenate([[0], np.cumsum(BREAK[data])])[starts]
        self.goes_on = (piece[1:] == piece[:-1]) & (text_of[1:] == text_of[:-1])
        self.terms, term_of = _terms(data, starts, ends)
        languages = part.column("lang").dictionary_encode()
        self.languages = languages.dictionary.to_pylist()
        language_of = languages.indices.to_numpy(zero_copy_only=False)[text_of]
        own = np.array([hash_word(t, seed) for t in self.terms], np.uint64)
        salt = np.array([xxhash.xxh64_intdigest(x.encode(), seed + 1) for x in self.languages], np.uint64)
        hashes = signed(mix(own[term_of] ^ salt[language_of])) if len(starts) else np.zeros(0, np.int64)
        self.hashes = np.where(hashes == 0, 1, hashes)  # 0 stands for no word
        self.codes = language_of.astype(np.int64) * max(1, len(self.terms)) + term_of


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Different words and which of them each word is."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    # every other entry of this array is a word, the others are what stands between two words
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(data)
    spans = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = spans.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], seed: int, hash_word: Callable[[bytes, int], int]) -> Iterator[Words]:
    for part in pieces(batches, most=SLICE_BYTES):
        yield Words(part, seed, hash_word)


def _count_words(seed: int, hash_word: Callable[[bytes, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches, seed, hash_word):
            codes, first, n = np.unique(words.codes, return_index=True, return_counts=True)
            language, term = np.divmod(codes, max(1, len(words.terms)))
            yield pa.record_batch(
                [
                    pa.array(words.hashes[first]),
                    pa.array(words.languages, pa.string()).take(pa.array(language)),
                    pa.array([words.terms[k].decode(errors="replace") for k in term.tolist()], pa.string()),
                    pa.array(n.astype(np.int64)),
                ],
                names=["a", "lang", "word", "n"],
            )

    return run


# ---------------------------------------------------------------- activation


def bit_of(a, b=None):
    """Bit of a word (``a``) or pair, before it is cut to the bitmap's size; the same for columns and arrays of hashes."""
    if b is None:
        return a
    if isinstance(a, Column):
        return a.bitwiseXOR(F.shiftleft(b, 1)).bitwiseXOR(F.shiftrightunsigned(b, 9))
    b = b.view(np.uint64)
    return (a.view(np.uint64) ^ (b << np.uint64(1)) ^ (b >> np.uint64(9))).view(np.int64)


def bitmap(bit: Column, found: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the rows of ``found``: at most ``bits / 64`` numbers reach the driver."""
    placed = found.select(bit.bitwiseAND(F.lit(bits - 1)).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    rows = placed.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out


def _has(marks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    at = bit & np.int64(64 * len(marks) - 1)
    return (marks[at >> 6] >> (at & 63)) & 1 == 1


def _first(levels: list[tuple[int, np.ndarray]], bit: np.ndarray) -> np.ndarray:
    """Scan from which on each word or pair counts as reached."""
    out = np.full(len(bit), NEVER)
    for scan, marks in reversed(levels):
        out[_has(marks, bit)] = scan
    return out


def _count_phrases(seed: int, hash_word: Callable[[bytes, int], int], scan: int, shards: int, word_levels, pair_levels, max_words: int):
    """Phrases active in this scan, with the scan at which they became so (``since``)."""

    def counted(keys: list[np.ndarray], since: np.ndarray, active: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "c", "since"]
        keys = [*keys, *[np.zeros(len(since), np.int64)] * (3 - len(keys)), since]
        table = pa.table([k[active] for k in keys], names=names).group_by(names, use_threads=False).aggregate([([], "count_all")])
        yield from table.rename_columns([*names, "n"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_at, pairs_at = word_levels.value, pair_levels.value
        for words in _slices(batches, seed, hash_word):
            h = words.hashes
            word_since = _first(words_at, bit_of(h))
            since = np.where(words.goes_on, np.maximum(word_since[1:], word_since[:-1]), NEVER)
            yield from counted([h[:-1], h[1:]], since, (since <= scan) & (scan < since + shards))
            if max_words > 2 and pairs_at and len(h) > 2:
                pair_since = np.where(since < NEVER, _first(pairs_at, bit_of(h[:-1], h[1:])), NEVER)
                since = np.maximum(pair_since[1:], pair_since[:-1])
                yield from counted([h[:-2], h[1:-1], h[2:]], since, (since <= scan) & (scan < since + shards))

    return run


# ---------------------------------------------------------------- scans


def count_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    shards: int = SHARDS,
    bits: int = BITS,
    seed: int = 0,
    hash_word: Callable[[bytes, int], int] = xxhash.xxh64_intdigest,
) -> tuple[DataFrame, DataFrame]:
    """Words ``(a, lang, word, n)``, all of them, and phrases ``(a, b, c, n)`` of ``min_count`` or more (``c`` 0: a pair)."""
    if max_words not in (2, 3):
        raise ValueError("phrases have two or three words")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    rows = docs.select(text, lang)
    # dealt by content and written, so that every scan and every repeated task sees the same shards
    dealt = materialise(rows.withColumn("shard", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int")), "shards", "shard")
    words, waiting = None, None
    word_levels: list[tuple[int, np.ndarray]] = []
    pair_levels: list[tuple[int, np.ndarray]] = []
    done: list[DataFrame] = []
    kind = "a long, b long, c long, since long, n long"
    for scan in range(shards * max_words):
        shard = dealt.filter(F.col("shard") == scan % shards).select("text", "lang")
        if scan:
            shared = [spark.sparkContext.broadcast(x) for x in (word_levels, pair_levels)]
            found = shard.mapInArrow(_count_phrases(seed, hash_word, scan, shards, *shared, max_words), kind)
            found = found if waiting is None else found.unionByName(waiting)
            counts = found.groupBy("a", "b", "c", "since").agg(F.sum("n").alias("n"))
            seen_all = F.col("since") + shards - 1 <= scan
            # those that have seen every shard stay only if they are frequent
            counts = materialise(counts.filter(~seen_all | (F.col("n") >= min_count)), f"phrases-{scan}")
            done.append(counts.filter(seen_all).select("a", "b", "c", "n"))
            waiting = counts.filter(~seen_all)
            reached = counts.filter((F.col("c") == 0) & (F.col("n") >= min_count))
            pair_levels = _next_level(pair_levels, scan + 1, bitmap(bit_of(F.col("a"), F.col("b")), reached, bits))
            for x in shared:
                x.unpersist()
        if scan < shards:
            found = shard.mapInArrow(_count_words(seed, hash_word), "a long, lang string, word string, n long")
            found = found if words is None else found.unionByName(words)
            words = materialise(found.groupBy("a", "lang", "word").agg(F.sum("n").alias("n")), f"words-{scan}")
            word_levels = _next_level(word_levels, scan + 1, bitmap(bit_of(F.col("a")), words.filter(F.col("n") >= min_count), bits))
    shared_hash = words.groupBy("a").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    if shared_hash.filter((F.col("k") > 1) & (F.col("n") >= min_count)).limit(1).count():
        return count_phrases(docs, min_count, max_words, shards, bits, seed + 2, hash_word)
    return words, reduce(DataFrame.unionByName, done)


def _next_level(levels: list[tuple[int, np.ndarray]], scan: int, marks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The bitmaps so far and one for ``scan``: what has been reached stays reached."""
    return [*levels, (scan, marks | levels[-1][1] if levels else marks)]


# ---------------------------------------------------------------- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits."""
    a, left, right = (x.cast("decimal(38, 0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(SCORE_UNIT).cast("decimal(38, 0)"), left * right)


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    absorb_percent: int = ABSORB_PERCENT,
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases.

    A phrase's score is that of its weakest cut. Pairs that ``absorb_percent`` of the time, or more, are part of one
    longer candidate are dropped.
    """
    words, phrases = count_phrases(docs, min_count, max_words, shards, bits)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.filter(F.col("n") >= min_count)
    phrases = materialise(phrases, "candidates")
    pairs = phrases.filter("c = 0").select("a", "b", F.col("n").alias("f"))
    triples = phrases.filter("c <> 0").select("a", "b", "c", F.col("n").alias("f"))

    def with_word(df: DataFrame, key: str, language: bool = False) -> DataFrame:
        side = known.select(F.col("a").alias(key), F.col("word").alias(f"word_{key}"), F.col("n").alias(f"f_{key}"), *(["lang"] if language else []))
        return df.join(side, key)

    named = with_word(with_word(pairs, "a", True), "b")
    inside = triples.select(F.inline(F.array(F.struct("a", "b", "f"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "f"))))
    longest = inside.groupBy("a", "b").agg(F.max("f").alias("_longer"))
    absorbed = F.coalesce(100 * F.col("_longer") >= absorb_percent * F.col("f"), F.lit(False))
    two = named.join(longest, ["a", "b"], "left").filter(~absorbed)
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), "f", F.col("f_a").alias("l"), F.col("f_b").alias("r"))
    two = two.withColumn("score", _score(F.col("f"), F.col("l"), F.col("r")))

    three = with_word(with_word(with_word(triples, "a", True), "b"), "c")
    first = pairs.select("a", "b", F.col("f").alias("f_ab"))
    second = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc"))
    three = three.join(first, ["a", "b"]).join(second, ["b", "c"])
    after_one = _score(F.col("f"), F.col("f_a"), F.col("f_bc"))
    after_two = _score(F.col("f"), F.col("f_ab"), F.col("f_c"))
    cuts = F.least(
        F.struct(after_one.alias("score"), F.lit(1).alias("k"), F.col("f_a").alias("l"), F.col("f_bc").alias("r")),
        F.struct(after_two.alias("score"), F.lit(2).alias("k"), F.col("f_ab").alias("l"), F.col("f_c").alias("r")),
    )
    three = three.withColumn("cut", cuts)
    three = three.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), "f", "cut.l", "cut.r", "cut.score")

    found = two.unionByName(three).withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    found = top_rows(found, top, order, ["lang", "_slice"]).drop("rank")
    found = top_rows(found, top, order, ["lang"])
    # one row a language
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
