"""Byte-level BPE encoding and decoding by forced boundaries.

A merge only ever makes a token of the vocabulary, so two neighbouring bytes that stand side by side inside no token of it
can never be merged: there the ids of a text are certain to part. Cuts at those byte pairs, and at the bounds of the
tokenizer's own pre-tokens, give short fragments that are encoded independently of each other, each different one once, and
whose ids are concatenated. Decoding is a take from the table of token bytes.

``BytePairs`` does both for Arrow arrays; ``encode_documents`` and ``decode_documents`` apply it slice by slice: no row is
shuffled, nothing of a text is cut off, and what a task holds is a slice of about a megabyte of text (or one longer text)
beside a bounded table of fragments.

Null texts are empty and have no ids. A special token's string in a text becomes its one id, as the library has it. Bytes
that are no UTF-8 count as U+FFFD. Ids outside the vocabulary decode to nothing; null ids to an empty text. Other columns
stay; one that is named like the new column gives way. Repeated rows and ids are rows like others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from doctopics.llm.text import flat, pieces

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
BLANK, APOSTROPHE = 0x20, 0x27
# What a pre-token that starts with an apostrophe may consist of.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")
KNOWN_FRAGMENTS = 200_000
DECODE_IDS = 1 << 20

_coders: dict[str, "BytePairs"] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary, given as the JSON text of its tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        rules = json.loads(spec)
        before, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if not plain or rules["normalizer"] or odd or rules["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer, prefix space or stripping special tokens is needed")
        tokenizer = Tokenizer.from_str(spec)
        self.split_text = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = tokenizer.model.tokenize
        letters = byte_letters()
        self.letter_of = {b: letters[b] for b in range(256)}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inside = np.zeros(1 << 16, bool)  # byte pairs that stand side by side in some token
        self.specials = {t["content"].encode(): t["id"] for t in added}
        entries = {i: bytes(byte_of[c] for c in token) for token, i in rules["model"]["vocab"].items() if set(token) <= byte_of.keys()}
        for token in entries.values():
            codes = np.frombuffer(token, np.uint8).astype(np.int64)
            self.inside[codes[:-1] * 256 + codes[1:]] = True
        entries |= {i: s for s, i in self.specials.items()}
        table = [entries.get(i, b"") for i in range(max(entries, default=-1) + 1)]
        self.table = pa.array([*table, b""], pa.large_binary())  # the last one for ids outside the vocabulary
        self.numbers = pa.array([str(i) for i in range(len(table))], pa.string())
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or b"(?!)")
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, list[int]] = {s: [i] for s, i in self.specials.items()}

    # ------------------------------------------------------------ encoding

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text, as a list array."""
        parts = [self._encode(p.column(0)) for p in pieces(iter([pa.record_batch([texts], ["text"])]))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _encode(self, texts: pa.Array) -> pa.Array:
        data, offs = flat(texts)
        try:
            chars = data.tobytes().decode()
        except UnicodeDecodeError:
            fixed = [t.decode(errors="replace") for t in (data[a:b].tobytes() for a, b in zip(offs, offs[1:]))]
            return self._encode(pa.array(fixed, pa.large_string()))
        starts = self._fragment_starts(data, offs, np.frombuffer(chars.encode("utf-32-le"), np.uint32))
        bounds = np.append(starts, len(data))
        fragments = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = fragments.dictionary_encode()
        ids, sizes = self._ids(coded.dictionary)
        begin = np.cumsum(sizes) - sizes
        picked = coded.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[picked])])
        at = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[picked], sizes[picked])
        ends = upto[np.searchsorted(starts, offs)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[at]))

    def _ids(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known, merge, letter_of = self.known, self.merge, self.letter_of
        ids: list[int] = []
        sizes = np.zeros(len(fragments), np.int64)
        for k, fragment in enumerate(fragments.to_pylist()):
            own = known.get(fragment)
            if own is None:
                own = [t.id for t in merge(fragment.decode("latin-1").translate(letter_of))]
                if len(known) < KNOWN_FRAGMENTS and len(fragment) <= 64:
                    known[fragment] = own
            ids += own
            sizes[k] = len(own)
        if len(known) >= KNOWN_FRAGMENTS:
            self.forget()
        return np.array(ids, np.int32), sizes

    def _fragment_starts(self, data: np.ndarray, offs: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Bytes at which a fragment starts: forced cuts, and the starts of pre-tokens, texts and special tokens."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        spans = [m.span() for m in self.special.finditer(data.tobytes())]
        spans = [(a, b) for a, b in spans if np.searchsorted(offs, a, "right") == np.searchsorted(offs, b - 1, "right")]
        edges = np.unique(np.concatenate([offs[offs < n], np.array(spans, np.int64).ravel()]))
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of every character
        first = np.zeros(len(at) + 1, bool)
        first[np.searchsorted(at, edges)] = True
        out = np.zeros(n + 1, bool)
        out[at[self._pretoken_starts(chars, first[:-1])]] = True
        codes = data.astype(np.int64)
        out[1:n] |= ~self.inside[codes[:-1] * 256 + codes[1:]]
        for a, b in spans:
            out[a + 1 : b] = False
        out[edges] = True
        return np.flatnonzero(out[:n])

    def _pretoken_starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters the tokenizer's split starts a pre-token at; ``first`` marks the starts of texts."""
        n = len(chars)
        kind = self._kinds_of(chars)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        inner = ~np.append(first[1:], True)  # characters whose next one is of the same text
        # the last blank before something else goes with it, any other white space there stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inner[:-1])
        start[last] = True
        start[last[chars[last] == BLANK] + 1] = False
        for p in np.flatnonzero(start & (chars == APOSTROPHE) & inner).tolist():
            for ending in (*SHORT_ENDINGS, *LONG_ENDINGS):
                stop = p + 1 + len(ending)
                if stop <= n and inner[p : stop - 1].all() and all(chars[p + 1 + k] == ord(c) for k, c in enumerate(ending)):
                    start[p + 1 : stop] = False
                    if stop < n:
                        start[stop] = True
                    break
        return start

    def _kinds_of(self, chars: np.ndarray) -> np.ndarray:
        """Kind of each character. The tokenizer's own split says it for every new one: its tables are those that count."""
        kinds = self.kinds[chars]
        if (kinds == UNKNOWN).any():
            for c in np.unique(chars[kinds == UNKNOWN]).tolist():
                tries = (("a", LETTER), ("1", NUMBER), ("!", OTHER))
                self.kinds[c] = next((k for x, k in tries if len(self.split_text(x + chr(c))) == 1), SPACE)
            kinds = self.kinds[chars]
        return kinds

    def listed(self, ids: pa.Array) -> pa.Array:
        """Every list of the encoder's ids as decimal numbers joined by commas."""
        names = pa.ListArray.from_arrays(ids.offsets, self.numbers.take(ids.values))
        return pc.binary_join(names, ",")

    # ------------------------------------------------------------ decoding

    def decode(self, ids: pa.Array) -> pa.Array:
        """Text of every list of ids."""
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        values = np.where((values >= 0) & (values < len(self.table) - 1), values, np.int32(len(self.table) - 1))
        data, offs = flat(self.table.take(pa.array(values)))
        bounds = offs[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(bounds, bounds[1:])], pa.string())


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` in all; a larger row stands alone."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def coder(key: str, spec) -> BytePairs:
    """The worker's coder of a broadcast tokenizer file."""
    if key not in _coders:
        _coders[key] = BytePairs(spec.value)
    return _coders[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the data


def _mapped(df: DataFrame, apply, made: dict[str, T.DataType], drop: str | None) -> DataFrame:
    """``df`` with new columns from ``apply``, which gets and gives slices of record batches."""
    gone = {n.lower() for n in made} | ({drop.lower()} if drop else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in apply(batches):
            yield pa.record_batch([*[part.column(f.name) for f in kept], *columns], names=[*[f.name for f in kept], *made])

    return df.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in made.items()]]))


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    out: str | None = "ids",
    decoded: str | None = None,
    drop_text: bool = False,
    listed: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out``, if it is named, and likewise the text of those ids in ``decoded`` and the
    ids as decimal numbers joined by commas in ``listed``.

    The file is read by the driver; workers need no copy. Where only the joined ids are wanted, ``listed`` without ``out``
    keeps the executors' JVM from making a string of every id.
    """
    spec = _shared(docs, tokenizer_path)
    kinds = {out: T.ArrayType(T.IntegerType()), decoded: T.StringType(), listed: T.StringType()}
    made = {name: kind for name, kind in kinds.items() if name}

    def apply(batches):
        own = coder(tokenizer_path, spec)
        for part in pieces(batches, text):
            ids = own.encode(part.column(text))
            yield part, [own.decode(ids) if n == decoded else own.listed(ids) if n == listed else ids for n in made]

    return _mapped(docs, apply, made, text if drop_text else None)


def decode_documents(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``, special tokens included."""
    spec = _shared(df, tokenizer_path)

    def apply(batches):
        own = coder(tokenizer_path, spec)
        for batch in batches:
            sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for start, stop in runs(sizes, DECODE_IDS):
                part = batch.slice(start, stop - start)
                yield part, [own.decode(part.column(ids))]

    return _mapped(df, apply, {out: T.StringType()}, None)
