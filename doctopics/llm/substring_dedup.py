"""Substring deduplication by level-wise doubling.

A passage of ``min_words`` words repeats only if every window inside it does. Level 1 looks at short windows (``FIRST`` words,
or half of ``min_words``, rounded up, if that is less), and of those only at the ones a document must agree on: of the short
windows inside each full window the one with the smallest hash. Equal full windows choose equal short ones, so no repeat is
lost, and a part of the short windows stands for all of them. Those that occur in one document alone die here. Each next
level extends the survivors to twice the length: only full windows that hold a survivor choose again among their windows of
that length. It goes on until ``min_words`` is reached or no candidate survives; 13 words take one doubling, 50 take three.

All levels find repeats by a map-side combined count per hash and hand the answer back through a join that adaptive
execution can split, so a passage in a third of all documents makes no hot task. A document's own windows are the only
thing that is ever gathered in one place.

Null and empty texts have no words. A null id is neither smaller nor larger than another: such rows keep all words
and take none from others. Rows that repeat an id are judged alike. A repeat within one document is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from doctopics.llm.base import materialise, pack_rest, unpack_rest
from doctopics.llm.text import covered, flat, owners, pieces, signed, span_hashes, window_hashes, word_spans

MIN_WORDS = 13
FIRST = 7
# Bits of a candidate's hash that travel. Two candidates that share them only make a window look alive that the last level,
# which compares whole hashes, drops; so no result depends on them, and a row of the widest shuffles is shorter.
SEED_BITS = 40


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = flat(array)
    starts, ends, word_offs = word_spans(data, offs)
    return span_hashes(data, starts, ends), word_offs


def level_lengths(min_words: int) -> list[int]:
    """Window lengths of the levels before the last one."""
    out = [min(FIRST, (min_words + 1) // 2)]
    while 2 * out[-1] < min_words:
        out.append(2 * out[-1])
    return out


def _choose(words: np.ndarray, offs: np.ndarray, min_words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window the smallest hash among its windows of ``length``; which full windows lie within their text."""
    hashes, inside = window_hashes(words, offs, length)
    hashes = np.where(inside, hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    n, run = len(hashes), 1
    best = hashes
    spans = min_words - length + 1
    while run * 2 <= spans:  # sliding minimum by doubling
        best = np.minimum(best, np.concatenate([best[run:], best[-1:].repeat(min(run, n))])[:n])
        run *= 2
    if run < spans:
        step = spans - run
        best = np.minimum(best, np.concatenate([best[step:], best[-1:].repeat(min(step, n))])[:n])
    at = np.arange(n)
    return best, at + min_words <= np.repeat(offs[1:], np.diff(offs))


def _seed(hashes: np.ndarray) -> np.ndarray:
    """What stands for a hash on the levels before the last."""
    return hashes & np.uint64((1 << SEED_BITS) - 1)


def _per_document(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _first(min_words: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, offs = _words(part.column("text"))
            if not len(words):
                continue
            best, whole = _choose(words, offs, min_words, length)
            owner = owners(offs)[whole]
            best = best[whole]
            new = np.ones(len(best), bool)  # neighbours mostly choose the same one
            new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
            owner, best = _per_document(owner[new], _seed(best[new]))
            yield pa.record_batch([pa.array(signed(best)), part.column("doc_id").take(pa.array(owner))], names=["h", "doc_id"])

    return run


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for part in pieces(batches):
        packed = [None if t is None else press.compress(t.encode()) for t in part.column("text").to_pylist()]
        yield pa.record_batch(
            [part.column("doc_id"), pa.array(packed, pa.binary()), part.column("_rest")], names=["doc_id", "ztext", "_rest"]
        )


def _texts(part: pa.RecordBatch) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [b"" if z is None else open_.decompress(z) for z in part.column("ztext").to_pylist()]


def _next(min_words: int, length: int, longer: int):
    """Windows of the next length, chosen by the full windows that hold a survivor of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "ztext", 1 << 19):
            words, offs = _words(pa.array(_texts(part), pa.binary()))
            if not len(words):
                continue
            best, whole = _choose(words, offs, min_words, length)
            hashes, _ = _choose(words, offs, min_words, longer)
            best, hashes = _seed(best), hashes if longer == min_words else _seed(hashes)
            owner = owners(offs)
            alive = np.zeros(len(words), bool)
            for i, seeds in enumerate(part.column("seeds")):
                a, b = offs[i], offs[i + 1]
                alive[a:b] = np.isin(best[a:b], seeds.values.to_numpy().view(np.uint64))
            keep = np.flatnonzero(alive & whole)
            owner, value = _per_document(owner[keep], hashes[keep])
            yield pa.record_batch([pa.array(signed(value)), part.column("doc_id").take(pa.array(owner))], names=["w", "doc_id"])

    return run


def _removal(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "ztext", 1 << 19):
            texts = _texts(part)
            words, offs = _words(pa.array(texts, pa.binary()))
            hashes, whole = window_hashes(words, offs, min_words)
            count, gone, kept, digest = [], [], [], []
            for i, repeats in enumerate(part.column("repeats")):
                a, b = int(offs[i]), int(offs[i + 1])
                count.append(b - a)
                own = texts[i].split()
                if repeats.is_valid:
                    hit = np.isin(hashes[a:b], repeats.values.to_numpy().view(np.uint64)) & whole[a:b]
                    out = covered(np.flatnonzero(hit), min_words, b - a)
                    own = [w for w, x in zip(own, out.tolist(), strict=True) if not x]
                left = b" ".join(own)
                gone.append(b - a - len(own))
                digest.append(hashlib.sha256(left).hexdigest())
                changed = gone[-1] > 0
                kept.append(left.decode() if changed else texts[i].decode() if part.column("ztext")[i].is_valid else None)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(kept, pa.string()),
                    pa.array(count, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(digest, pa.string()),
                    part.column("_rest"),
                ],
                names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "_rest"],
            )

    return run


def _repeated(occurrences: DataFrame, key: str, later_only: bool) -> DataFrame:
    """Occurrences of keys that more than one document has; with ``later_only`` not those in the first document."""
    groups = occurrences.groupBy(key)
    if later_only:
        found = groups.agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
        return occurrences.join(found.select(key, "_first"), key).filter("doc_id > _first")
    return occurrences.join(groups.agg(F.count("*").alias("_n")).filter("_n > 1").select(key), key)


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, plus ``n_words``, ``n_removed`` (long) and ``kept_sha256``.

    Removes each word covered by a window of ``min_words`` words that also starts in a document with a smaller id. A text
    that loses nothing is unchanged; else the kept words are joined by one space. ``kept_sha256`` is of the joined words.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    length, *longer = level_lengths(min_words)
    found = (
        docs.select("doc_id", "text")
        .filter("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_first(min_words, length), "h long, doc_id long")
    )
    packed = pack_rest(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    carried = [StructField("doc_id", LongType()), StructField("ztext", BinaryType()), packed.schema["_rest"]]
    alive = packed.mapInArrow(_pack_text, StructType(carried))
    passed = []  # documents without a survivor go straight through; only the others are joined again
    for level, following in enumerate([*longer, min_words]):
        seeds = _repeated(found, "h", False).groupBy("doc_id").agg(F.collect_list("h").alias("seeds"))
        marked = materialise(alive.select("doc_id", "ztext", "_rest").join(seeds, "doc_id", "left"), f"substring-level{level + 1}")
        passed.append(marked.filter("seeds IS NULL").select("doc_id", "ztext", "_rest"))
        alive = marked.filter("seeds IS NOT NULL")
        found = alive.select("doc_id", "ztext", "seeds").mapInArrow(_next(min_words, length, following), "h long, doc_id long")
        length = following
        if following < min_words and not alive.limit(1).count():
            break
    repeats = _repeated(found, "h", True).groupBy("doc_id").agg(F.collect_list("h").alias("repeats"))
    judged = alive.select("doc_id", "ztext", "_rest").join(repeats, "doc_id", "left")
    nothing = F.lit(None).cast(ArrayType(LongType())).alias("repeats")
    rest = reduce(DataFrame.unionByName, passed).select("doc_id", "ztext", "_rest", nothing)
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept_sha256", StringType()),
            packed.schema["_rest"],
        ]
    )
    out = judged.unionByName(rest).mapInArrow(_removal(min_words), schema)
    return unpack_rest(out, "n_words", "n_removed", "kept_sha256")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` with repeats cut out of ``text`` (and ``n_chars``, if there, set to its new length).

    Documents that lose all their words are dropped; unchanged ones, empty ones included, stay as they are.
    """
    out = dedup_substrings(docs, min_words).filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
