"""Language identification by error-correcting output codes.

Every language has a codeword of bits, rows of a code with large pairwise distance. For each bit a binary classifier over
hashed byte n-grams (1 to 3 bytes of the letters) tells the languages with a 1 from those with a 0: a multinomial
log-ratio, learned from the counts of all labelled training texts, which are summed on the executors. Decoding weighs each
bit's logistic loss by how well its classifier did on the training texts and chooses the codeword of least total loss; a
text whose two best codewords are close is flagged as ambiguous. Of languages with equal loss the first in string order is
taken.

What reaches the driver is a table of languages x n-gram buckets; the number of languages is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctopics.llm.ppm import id_remainder
from doctopics.llm.text import ASCII_LOWER, flat, mix, pieces

BUCKETS = 1 << 14
MAX_LANGUAGES = 512
AMBIGUOUS = 0.75
UNKNOWN = "und"
SMOOTHING = 0.5
STEEPNESS = 6.0


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """Languages x bits in {-1, 1}; each pair differs in about half of the bits and no bit is the same for all.

    Rows of a Sylvester-Hadamard matrix without its constant column: any two differ in exactly half of all columns.
    """
    size = 2
    while size < max(languages, 8):
        size *= 2
    matrix = np.array([[1]])
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = np.random.default_rng(seed).permutation(size)[:languages]
    code = matrix[rows][:, 1:]
    return code[:, np.abs(code.sum(axis=0)) < languages] if languages > 1 else code


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of 1 to 3 bytes within runs of letters and the n + 1 offsets, three entries per byte.

    Bytes are lower-cased (A-Z); ASCII bytes that are no letters end a run and give no entry (-1).
    """
    data, offs = flat(part.column("text"))
    data = ASCII_LOWER[data].astype(np.uint64)
    letter = (data >= 0x80) | ((data >= 97) & (data <= 122))
    out = np.full((len(data), 3), -1, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    code, whole = data + np.uint64(1), letter.copy()
    for n in range(3):
        if n:
            before = np.roll(letter, n)
            before[:n] = False
            for k in range(n):  # the gram must not reach into the text before
                start = np.roll(first[:-1], k)
                start[:k] = False
                before &= ~start
            whole = whole & before
            code = code + ((np.roll(data, n) + np.uint64(1)) << np.uint64(9 * n))
        out[whole, n] = (mix(code[whole]) % np.uint64(BUCKETS)).astype(np.int64)
    return out, offs


def has_letter(texts: list) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


@dataclass(frozen=True)
class Codec:
    """Languages, their codewords, a weight per n-gram bucket and bit, a bias and a trust per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts x bits: mean log-ratio of a text's n-grams."""
        n = len(offs) - 1
        doc = np.repeat(np.arange(n), np.diff(offs) * 3)
        flat_grams = grams.reshape(-1)
        used = flat_grams >= 0
        doc, flat_grams = doc[used], flat_grams[used]
        key, times = np.unique(doc * BUCKETS + flat_grams, return_counts=True)
        out = np.zeros((n, self.weights.shape[1]))
        rows, buckets = key // BUCKETS, key % BUCKETS
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        for b in range(out.shape[1]):
            out[:, b] = np.bincount(rows, weights=self.weights[buckets, b] * times, minlength=n) / size
        return (out + self.bias) * (np.bincount(doc, minlength=n) > 0)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each text and the share of it against all others, from losses weighted by trust."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        # a bit costs a language with 1 softplus(-margin) and one with -1 softplus(margin): two texts x languages products
        steep = margins * STEEPNESS
        wrong_one, wrong_zero = np.logaddexp(0, -steep) * self.trust, np.logaddexp(0, steep) * self.trust
        loss = wrong_one @ (self.code == 1).T.astype(float) + wrong_zero @ (self.code == -1).T.astype(float)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), near.max(axis=1) / near.sum(axis=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for part in pieces(batches, most=1 << 20):
        grams, offs = features(part)
        langs = part.column("lang").to_pylist()
        for lang in set(langs):
            own = np.concatenate([grams[offs[i] : offs[i + 1]].reshape(-1) for i, x in enumerate(langs) if x == lang])
            add = np.bincount(own[own >= 0], minlength=BUCKETS)
            found[lang] = found[lang] + add if lang in found else add
    for lang, counts in found.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])


def _trials(model):
    """Per language and bit: how many training texts fall on the right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model.value
        at = {x: i for i, x in enumerate(codec.languages)}
        right, seen = np.zeros(codec.code.shape, int), np.zeros(len(at), int)
        for part in pieces(batches, most=1 << 20):
            own = np.array([at[x] for x in part.column("lang").to_pylist()])
            good = codec.margins(*features(part)) * codec.code[own] > 0
            np.add.at(right, own, good)
            np.add.at(seen, own, 1)
        cells = [(i, b, int(right[i, b]), int(seen[i])) for i in np.flatnonzero(seen).tolist() for b in range(right.shape[1])]
        columns = [pa.array(c, pa.int64()) for c in zip(*cells, strict=True)] if cells else [pa.array([], pa.int64())] * 4
        yield pa.record_batch(columns, names=["lang", "bit", "ok", "n"])

    return run


def fit(docs: DataFrame) -> Codec:
    """Learn from all rows of ``text`` and ``lang`` in which neither is null."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    code = codewords(len(languages))
    table = np.zeros((len(languages), BUCKETS))
    rows = counts.toArrow()
    place = pd.Series(range(len(languages)), index=languages, dtype="int64")
    if rows.num_rows:
        table[place[rows.column("lang").to_pylist()].to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    # a language counts by its profile, not by how much text it has
    profile = (table + SMOOTHING / BUCKETS) / (table.sum(axis=1, keepdims=True) + SMOOTHING)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = profile[code[:, b] > 0], profile[code[:, b] < 0]
        if len(yes) and len(no):
            weights[:, b] = np.log((yes.mean(axis=0) + 1e-7) / (no.mean(axis=0) + 1e-7))
    # between the mean margins of the two sides
    margin = profile @ weights
    bias = np.array(
        [-(margin[code[:, b] > 0, b].min() + margin[code[:, b] < 0, b].max()) / 2 if len(set(code[:, b])) == 2 else 0.0 for b in range(code.shape[1])]
    )
    codec = Codec(languages, code, weights.astype(np.float32), bias, np.ones(code.shape[1]))
    if len(languages) < 2:
        return codec
    shipped = docs.sparkSession.sparkContext.broadcast(codec)
    trials = known.mapInArrow(_trials(shipped), "lang long, bit long, ok long, n long")
    trust = np.zeros(code.shape[1])
    for r in trials.groupBy("bit", "lang").agg((F.sum("ok") / F.sum("n")).alias("rate")).groupBy("bit").agg(F.avg("rate").alias("r")).collect():
        trust[r["bit"]] = max(2 * r["r"] - 1, 0.01)
    return Codec(languages, code, codec.weights, bias, trust)


def _predict(model, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model.value
        for part in pieces(batches, most=1 << 20):
            some = has_letter(part.column("text").to_pylist())
            names, share = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
            if codec.languages:
                best, near = codec.decode(codec.margins(*features(part)))
                names[some] = np.array(codec.languages, object)[best[some]]
                share[some] = near[some]
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(names.tolist(), pa.string()),
                    pa.array(share),
                    pa.array(~some | (share < ambiguous)),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, codec: Codec, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` for each row; only ``text`` is looked at.

    Null texts and texts without a letter are ``und`` with score 0. So is every text if nothing could be learned.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(codec)
    made = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(shipped, ambiguous), made)


def identify_languages(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from documents whose id's crc32 modulo ``modulus`` is not ``held``; predict all."""
    marked = docs.select(F.col("doc_id").cast("long"), "text", "lang", (id_remainder("doc_id", modulus) == held).alias("held_out"))
    return predict(marked, fit(marked.filter(~F.col("held_out"))))
