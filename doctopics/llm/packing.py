"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids are the tokenizer's, then an end id; only longer ones are cut, into full pieces and a last one. Packing
is bounded-space online best-fit: a task keeps a fixed number of open bins, and a bitset holds a bit for every amount of
free space that some open bin has, so the tightest bin that fits is two bit operations away. When a bin more than the
bound would be open, the fullest closes. Pieces are dealt to tasks by a hash and arrive longest first; a task gets enough
of them to fill many sequences, so its last, partly filled bins do not count.

The id arrays never leave the task that makes them: what moves is a short row for each piece. Null texts are empty and
hold the end id alone. Rows that repeat an id are packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from doctopics.llm.base import materialise
from doctopics.llm.text import flat, pieces, span_hashes, word_spans

MAX_TOKENS = 4096
END_ID = 1
OPEN_BINS = 1024
TASK_SEQUENCES = 512
CACHED_WORDS = 500_000
# Letters that lower-casing and composing leave single letters, then signs: such a word is two pre-tokens at most.
PLAIN_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\[-`{-~]*)")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of words, remembered up to a bound.

    The tokenizer must treat white space as a hard boundary that leaves no token, so that a text's ids are those of its
    words in turn; ``word_bpe`` vocabularies do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain_pipeline(self.tokenizer)
        self.model = self.tokenizer.model
        self.signs: dict[str, list[int]] = {"": []}
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted word hashes
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each word."""
        hashes, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        have = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == hashes if len(self.known) else False)
        new = first[~have]
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            size, flat_ids = self._ids(words)
            known = np.concatenate([self.known, hashes[~have]])
            order = np.argsort(known)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, flat_ids])
            self.known = known[order]
            at = np.searchsorted(self.known, hashes)
        begin, size = self.begin[at][which], self.size[at][which]
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        return self.ids[np.arange(len(shift)) + shift], size


    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids; plain words go to the merge model directly."""
        sizes, ids, tokenize, signs = [], [], self.model.tokenize, self.signs
        if len(signs) > 10_000:
            signs = self.signs = {"": []}
        for word in words:
            found = PLAIN_WORD.fullmatch(word) if self.plain else None
            if found is None:
                own = self.tokenizer.encode(word, add_special_tokens=False).ids
            else:
                letters, tail = found.groups()
                letters = letters.lower()
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
                own = [t.id for t in tokenize(letters)]
                if tail:
                    if tail not in signs:
                        signs[tail] = [t.id for t in tokenize(tail)]
                    own += signs[tail]
            sizes.append(len(own))
            ids += own
        return np.array(sizes, np.int64), np.array(ids, np.uint32)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def plain_pipeline(tokenizer) -> bool:
    """Whether the tokenizer splits letters from signs after composing and lower-casing, as PLAIN_WORD takes for granted."""
    spec = json.loads(tokenizer.to_str())
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return False
    split, level = steps
    letters_signs = split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and split["invert"]
    return letters_signs and not level["add_prefix_space"] and not level["use_regex"]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(path: str, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for part in pieces(batches, most=1 << 20):
            data, offs = flat(part.column("text"))
            starts, ends, word_offs = word_spans(data, offs)
            ids, sizes = words.encode(data, starts, ends)
            upto = np.concatenate([[0], np.cumsum(sizes)])[word_offs]
            doc, piece, start, length, crc = [], [], [], [], []
            for i in range(part.num_rows):
                own = np.append(ids[upto[i] : upto[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(own), most)):
                    x = own[a : a + most]
                    doc.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(x))
                    crc.append(zlib.crc32(x.tobytes()))
            yield pa.record_batch(
                [
                    part.column("doc_id").take(pa.array(doc, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class OpenBins:
    """At most ``bound`` open bins of ``capacity``; ``put`` gives the bin and the offset in it."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return out

    def put(self, size: int) -> tuple[int, int]:
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            which = self._take(free)
        else:
            free, which = self.capacity, self.made
            self.made += 1
            if self.open == self.bound:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        left = free - size
        if left:  # a full bin is closed
            self.by_free.setdefault(left, []).append(which)
            self.free_bits |= 1 << left
            self.open += 1
        return which, self.capacity - free


def _pack(capacity: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, OpenBins] = {}
        for batch in batches:
            sequence, offset = [], []
            for task, size in zip(batch.column("_task").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if task not in bins:
                    bins = {task: OpenBins(capacity, bound)}  # rows come task by task
                which, at = bins[task].put(size)
                sequence.append((task << 32) + which)
                offset.append(at)
            kept = batch.drop_columns(["_task"])
            columns = [*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.record_batch(columns, names=[*kept.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    task_sequences: int = TASK_SEQUENCES,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer_path`` must be readable on every worker, as installed tokenizer files are. ``task_sequences``: about how many
    sequences one task fills; it sets the number of tasks from the number of tokens.
    """
    made = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = docs.select(F.col("doc_id").cast(LongType()), "text").mapInArrow(_cut(tokenizer_path, max_tokens, end_id), made)
    cut = materialise(cut, "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // (max_tokens * task_sequences)))
    dealt = cut.withColumn("_task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)))
    ordered = dealt.repartition(tasks, "_task").sortWithinPartitions("_task", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(_pack(max_tokens, open_bins), made + ", sequence_id long, offset long")
