"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``order`` bytes. A byte is predicted in its longest context; with a byte the
context has not seen, the coder escapes (method C: as many escapes as different bytes seen) to the next shorter context,
where all bytes that the longer one has seen are excluded. Below order 0 all bytes not seen there are equally likely. Texts
start after ``order`` bytes 0xFF and end with one, which UTF-8 does not use. A text is its words in lower case (A-Z), joined by one space.

Training counts all n-grams of ``order + 1`` bytes of all training texts on the executors; shorter ones are sums over
their endings. All of them predict. The longest ones that make up at least ``SHARE`` of the training bytes (at most
``1 / SHARE``) are broadcast with their probabilities; the other codes of a document are joined by hash with the table of
all longest n-grams, and codes that it does not hold walk down the orders by joins with the counts of their endings and the
sums of their contexts. No key of those joins is hot: a context has at most 256 bytes after it and an ending 256 before it.

With a ``share`` above 0 the model is cut instead: only n-grams of at least that share predict, from a broadcast trie. An
n-gram is at most as frequent as its ending, so every kept node's shorter contexts are kept and exclusion needs two sums
per context.

The word base beside it uses exact counts of all words. Counts of words with at least ``SHARE`` of all tokens (at most
``1 / SHARE``) are broadcast; the others are joined by hash, none of which can be a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doctopics.llm.base import materialise
from doctopics.llm.text import ASCII_LOWER, flat, mix, owners, pieces, signed, span_hashes, word_spans

ORDER = 5
SHARE = 2.0**-21
END = 0xFF
SYMBOLS = 256
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
END_WORD = mix(np.zeros(1, np.uint64))[0]
MERGE_ROWS = 1_500_000
NGRAM, WORD = 0, 1


# ---------------------------------------------------------------- trie


class Slots:
    """Open-addressing table from 64-bit codes to their places in the array it is made of."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(2 * len(codes) - 1).bit_length()) if len(codes) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, EMPTY, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = codes[left[free]]  # of several for one slot the last stays
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        keys = self.keys[slot]
        out = np.where(keys == codes, self.at[slot], np.int32(-1))
        left = np.flatnonzero((keys != codes) & (keys != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            keys = self.keys[slot]
            hit = keys == codes[left]
            out[left[hit]] = self.at[slot[hit]]
            more = ~hit & (keys != EMPTY)
            left, slot = left[more], slot[more]
        return out


@dataclass
class Trie:
    """n-gram codes (order o has o + 1 bytes) and counts, and how often each of their contexts occurs in all.

    A context also occurs before bytes whose n-grams are not kept; those occurrences count as escapes. Lookup tables are
    made where they are used.
    """

    codes: list[np.ndarray]
    counts: list[np.ndarray]
    totals: list[tuple[np.ndarray, np.ndarray]]
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"codes": self.codes, "counts": self.counts, "totals": self.totals, "_ready": {}}

    def _tables(self):
        if not self._ready:
            nodes, contexts = [], []
            for o, (codes, counts) in enumerate(zip(self.codes, self.counts, strict=True)):
                table = Slots(codes)
                context, place = np.unique(codes >> np.uint64(8), return_inverse=True)
                total = np.bincount(place, weights=counts, minlength=len(context))
                kinds = np.bincount(place, minlength=len(context)).astype(float)
                shorter = np.zeros(len(codes))
                if o:
                    below = nodes[-1][0].find(codes & np.uint64((1 << 8 * o) - 1))
                    shorter = np.where(below >= 0, self.counts[o - 1][below], 0)
                seen = np.bincount(place, weights=shorter, minlength=len(context))
                all_codes, all_counts = self.totals[o]
                of = Slots(all_codes).find(context)
                other = np.where(of >= 0, all_counts[of], total) - total if len(context) else total
                nodes.append((table, counts.astype(float)))
                contexts.append((Slots(context), *(np.append(x, 0) for x in (total, kinds, seen, other))))
            top = len(nodes) - 1
            slots, total, kinds, _, other = contexts[top]
            at = slots.find(self.codes[top] >> np.uint64(8))
            first = np.log10(nodes[top][1] / (total[at] + other[at] + kinds[at])) if len(at) else np.zeros(0)
            self._ready = {"nodes": nodes, "contexts": contexts, "first": first}
        return self._ready["nodes"], self._ready["contexts"], self._ready["first"]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each code given the bytes before."""
        nodes, contexts, first = self._tables()
        top = len(nodes) - 1
        out = np.zeros(len(codes))
        place = nodes[top][0].find(codes)
        hit = place >= 0
        out[hit] = first[place[hit]]
        left = np.flatnonzero(~hit)
        seen, kinds_seen = np.zeros(len(left)), np.zeros(len(left))
        for o in range(top, -1, -1):
            if not len(left):
                return out
            own = codes[left] & np.uint64((1 << 8 * (o + 1)) - 1)
            slots, total, kinds, excluded, other = contexts[o]
            at = slots.find(own >> np.uint64(8))  # -1 is an unseen context: all sums are zero there
            new = kinds[at] - kinds_seen + other[at]
            room = total[at] - seen + new
            place = np.full(len(own), -1, np.int32) if o == top else nodes[o][0].find(own)
            hit = place >= 0
            out[left[hit]] += np.log10(nodes[o][1][place[hit]] / room[hit])
            escape = ~hit & (new > 0)
            out[left[escape]] += np.log10(new[escape] / room[escape])
            left, at = left[~hit], at[~hit]
            seen, kinds_seen = excluded[at], kinds[at]
        out[left] -= np.log10(SYMBOLS - kinds_seen)
        return out


@dataclass(frozen=True)
class Frequent:
    """Codes of the longest n-grams that are broadcast, and their log probabilities."""

    codes: np.ndarray
    logs: np.ndarray


def _lookup(of: Trie | Frequent):
    """Log probabilities of codes and which of them are known here; the others are 0."""
    if isinstance(of, Trie):
        return lambda codes: (of.log10(codes), np.ones(len(codes), bool))
    slots, logs = Slots(of.codes), np.append(of.logs, 0.0)

    def find(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = slots.find(codes)
        return logs[place], place >= 0

    return find


def stream(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each predicted byte (all bytes and one end per text) with its context, and the n + 1 offsets."""
    n = len(offs) - 1
    padded = np.full(len(data) + order * (n + 1), END, np.uint8)
    own = owners(offs)
    padded[np.arange(len(data)) + order * (own + 1)] = data
    wide = padded.astype(np.uint64)
    code = wide.copy()
    for k in range(1, order + 1):
        code[k:] |= wide[:-k] << np.uint64(8 * k)
    first = offs[:-1] + order * (np.arange(n) + 1)
    size = np.diff(offs) + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)
    return code[at], upto


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """Code length, as log10 probability, by a model that learns from this text alone while it is coded."""
    seen: dict[bytes, dict[int, int]] = {}
    total, padded = 0.0, bytes([END]) * order + text + bytes([END])
    for p in range(order, len(padded)):
        symbol, excluded = padded[p], set()
        for o in range(order, -1, -1):
            own = {s: c for s, c in seen.get(padded[p - o : p], {}).items() if s not in excluded}
            room = sum(own.values()) + len(own)
            if symbol in own:
                total += np.log10(own[symbol] / room)
                break
            if own:
                total += np.log10(len(own) / room)
                excluded |= own.keys()
        else:
            total -= np.log10(SYMBOLS - len(excluded))
        for o in range(order + 1):
            counts = seen.setdefault(padded[p - o : p], {})
            counts[symbol] = counts.get(symbol, 0) + 1
    return float(total)


# ---------------------------------------------------------------- counting


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    at = np.flatnonzero(new)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


class Counter:
    """Counts of codes, merged whenever many have gathered; emptied when too many are different."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.rows = kind, [], 0

    def add(self, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(codes, return_counts=True)
        self.parts.append((found, counts))
        self.rows += len(found)
        if self.rows > MERGE_ROWS:
            self.parts = [_merge(self.parts)]
            self.rows = len(self.parts[0][0])
            if self.rows > MERGE_ROWS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            codes, counts = _merge(self.parts)
            self.parts, self.rows = [], 0
            for a in range(0, len(codes), 1 << 16):
                n = len(codes[a : a + (1 << 16)])
                kind = pa.array(np.full(n, self.kind, np.int32))
                yield pa.record_batch(
                    [kind, pa.array(signed(codes[a : a + n])), pa.array(counts[a : a + n])], names=["kind", "code", "n"]
                )


def _lowered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words in lower case, joined by one space: what both the model and the base see of a text."""
    data, offs = flat(part.column("text"))
    data = ASCII_LOWER[data]
    starts, ends, word_offs = word_spans(data, offs)
    return _joined(data, starts, ends, word_offs)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return data[:0], np.zeros(len(word_offs), np.int64)
    last = np.zeros(len(starts), bool)
    last[word_offs[1:][np.diff(word_offs) > 0] - 1] = True
    size = ends - starts + ~last
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)
    out = data[np.minimum(at, len(data) - 1)]
    out[(upto[1:] - 1)[~last]] = 0x20
    return out, upto[word_offs]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counter(NGRAM), Counter(WORD)
        for part in pieces(batches, most=1 << 20):
            data, offs = _lowered(part)
            yield from grams.add(stream(data, offs, order)[0])
            starts, ends, _ = word_spans(data, offs)
            yield from words.add(np.concatenate([span_hashes(data, starts, ends), END_WORD.repeat(part.num_rows)]))
        yield from grams.flush()
        yield from words.flush()

    return run


@dataclass(frozen=True)
class Model:
    """What predicts bytes, exact word counts and how much they were learned from.

    ``grams`` (``o``, ``code``, ``n``) are the counts of all n-grams, ``longest`` (``code``, ``n``, ``p``) the longest with
    their log probabilities; both are None if ``near`` is a trie, which needs no others.
    """

    near: Trie | Frequent
    grams: DataFrame | None
    longest: DataFrame | None
    order: int
    counts: DataFrame
    tokens: int
    types: int
    common: tuple[np.ndarray, np.ndarray]


def _by_order(counts: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = counts.select("o", "code", "n").toArrow()
    o, code, n = (rows.column(i).to_numpy() for i in range(3))
    return [(code[o == k].astype(np.uint64), n[o == k]) for k in range(order + 1)]


def _masks(order: int) -> Column:
    return F.array(*[F.struct(F.lit(o).alias("o"), F.lit((1 << 8 * (o + 1)) - 1).alias("mask")) for o in range(order + 1)])


def fit(texts: DataFrame, order: int = ORDER, share: float = 0.0) -> Model:
    """Learn from the column ``text`` of all rows; a ``share`` above 0 leaves rarer n-grams out of the model."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    raw = texts.select("text").mapInArrow(_count(order), "kind int, code long, n long")
    counts = materialise(raw.groupBy("kind", "code").agg(F.sum("n").alias("n")), "counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    symbols = sums[NGRAM]["n"] if NGRAM in sums else 0
    tokens, types = (sums[WORD]["n"], sums[WORD]["types"]) if WORD in sums else (0, 0)
    grams = counts.filter(F.col("kind") == NGRAM).select("code", "n", F.explode(_masks(order)).alias("m"))
    grams = grams.groupBy("m.o", F.col("code").bitwiseAND(F.col("m.mask")).alias("code")).agg(F.sum("n").alias("n"))
    grams = materialise(grams, "grams")
    longest = None
    if share > 0:
        # at most 1 / share of each length reach that count, so what is collected is bounded
        least = max(1.0, symbols * share)
        contexts = grams.groupBy("o", F.shiftright("code", 8).alias("code")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        nodes = _by_order(grams.filter(F.col("n") >= least), order)
        near = Trie([c for c, _ in nodes], [n for _, n in nodes], _by_order(contexts.filter(F.col("most") >= least), order))
        grams = None
    else:
        context = Window.partitionBy(F.shiftright("code", 8))  # at most 256 rows
        p = F.log10(F.col("n") / (F.sum("n").over(context) + F.count("*").over(context)))
        longest = counts.filter(F.col("kind") == NGRAM).select("code", "n").withColumn("p", p)
        longest = materialise(longest, "longest")
        # at most 1 / SHARE n-grams
        often = longest.filter(F.col("n") >= max(1.0, symbols * SHARE)).select("code", "p").toArrow()
        near = Frequent(often.column(0).to_numpy().astype(np.uint64), often.column(1).to_numpy())
    words = counts.filter(F.col("kind") == WORD).select("code", "n")
    most = words.filter(F.col("n") >= max(1.0, tokens * SHARE)).toArrow()
    codes, n = most.column(0).to_numpy().astype(np.int64).view(np.uint64), most.column(1).to_numpy()
    sort = np.argsort(codes)
    return Model(near, grams, longest, order, words, tokens, types, (codes[sort], n[sort]))


# ---------------------------------------------------------------- scoring


def _tallied(doc: np.ndarray, codes: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """The different codes of each of ``n`` documents and how often they occur there."""
    order = np.lexsort((codes, doc))
    doc, codes = doc[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
    times = np.diff(np.append(at, len(codes))).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(signed(codes[at]))), pa.ListArray.from_arrays(cuts, pa.array(times))


def _score(model, order: int, tokens: int, types: int):
    """Per document: tokens, base and score of what is broadcast, the other words and n-grams as codes with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, known, counts = model.value
        find = _lookup(near)
        slots = Slots(known)
        common_log = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        for part in pieces(batches, most=1 << 20):
            data, offs = _lowered(part)
            n = part.num_rows
            codes, upto = stream(data, offs, order)
            logs, found = find(codes)
            score = np.add.reduceat(logs, upto[:-1])
            odd, odd_times = _tallied(owners(upto)[~found], codes[~found], n)
            starts, ends, word_offs = word_spans(data, offs)
            hashes = np.concatenate([span_hashes(data, starts, ends), END_WORD.repeat(n)])
            doc = np.concatenate([owners(word_offs), np.arange(n)])
            place = slots.find(hashes)
            hit = place >= 0
            base = np.bincount(doc[hit], weights=common_log[place[hit]], minlength=n) if len(known) else np.zeros(n)
            rare, times = _tallied(doc[~hit], hashes[~hit], n)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(np.diff(word_offs) + 1),
                    pa.array(np.bincount(doc[hit], minlength=n)),
                    pa.array(base),
                    pa.array(score),
                    rare,
                    times,
                    odd,
                    odd_times,
                ],
                names=["doc_id", "held_out", "n_tokens", "n_common", "common_base", "score", "rare", "times", "odd", "odd_times"],
            )

    return run


def _unseen(codes: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """``(code, v)``: log probability of each of the different ``code``, none of which is among the longest n-grams."""
    own = codes.select("code", F.explode(_masks(order)).alias("m"))
    own = own.select("code", "m.o", F.col("code").bitwiseAND(F.col("m.mask")).alias("end"))
    ends = own.select("o", "end").distinct().withColumn("context", F.shiftright("end", 8))
    nodes = grams.select("o", F.col("code").alias("end"), "n")
    after = nodes.withColumn("context", F.shiftright("end", 8))
    after = after.join(ends.select("o", "context").distinct(), ["o", "context"], "left_semi")
    # the same byte after the next shorter context; there is none below order 0
    shorter = F.expr("CASE WHEN o > 0 THEN end & (shiftleft(1L, 8 * o) - 1) END")
    lower = nodes.select((F.col("o") + 1).alias("o"), F.col("end").alias("_shorter"), F.col("n").alias("_below"))
    after = after.withColumn("_shorter", shorter).join(lower, ["o", "_shorter"], "left")
    sums = after.groupBy("o", "context").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.coalesce("_below", F.lit(0))).alias("excluded")
    )
    facts = materialise(ends.join(nodes, ["o", "end"], "left").join(sums, ["o", "context"], "left").drop("context"), "facts")
    # at most 256 + 256^2 rows below order 2
    low = own.filter("o < 2").join(F.broadcast(facts.filter("o < 2")), ["o", "end"])
    walks = low.unionByName(own.filter("o >= 2").join(facts.filter("o >= 2"), ["o", "end"]))
    names = ["n", "total", "kinds", "excluded"]
    walks = walks.groupBy("code").agg(*[F.max(F.when(F.col("o") == o, F.col(k))).alias(f"{k}{o}") for o in range(order + 1) for k in names])

    def of(name: str, o: int) -> Column:
        return F.coalesce(f"{name}{o}", F.lit(0)) if o <= order else F.lit(0)

    v = -F.log10(SYMBOLS - of("kinds", 0))
    for o in range(order + 1):
        new = of("kinds", o) - of("kinds", o + 1)
        room = of("total", o) - of("excluded", o + 1) + new
        escape = F.when(new > 0, F.log10(new / room)).otherwise(0.0)
        v = F.when(F.col(f"n{o}").isNotNull(), F.log10(F.col(f"n{o}") / room)).otherwise(escape + v)
    return walks.select("code", v.alias("v"))


def _odd_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``(_row, odd_score)``: what the n-grams that were not broadcast add to the score."""
    odd = rows.select("_row", F.explode(F.arrays_zip("odd", "odd_times")).alias("c"))
    odd = odd.select("_row", F.col("c.odd").alias("code"), F.col("c.odd_times").alias("times"))
    odd = odd.join(model.longest.select("code", "p"), "code", "left")
    # one row for all known codes of a document and one for each unseen code
    odd = odd.groupBy("_row", F.when(F.col("p").isNull(), F.col("code")).alias("code"))
    odd = materialise(odd.agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.col("p")).alias("s")), "odd")
    known, unseen = odd.filter("code IS NULL"), odd.filter("code IS NOT NULL")
    walks = _unseen(materialise(unseen.select("code").distinct(), "unseen"), model.grams, model.order)
    unseen = unseen.join(walks, "code").select("_row", (F.col("times") * F.col("v")).alias("s"))
    return known.select("_row", "s").unionByName(unseen).groupBy("_row").agg(F.sum("s").alias("odd_score"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row.

    ``docs`` has ``doc_id``, ``text`` and ``held_out``, which is only passed on. Null texts are empty: one end token.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.near, *model.common))
    made = "doc_id long, held_out boolean, n_tokens long, n_common long, common_base double, score double, rare array<long>, times array<int>, "
    made += "odd array<long>, odd_times array<int>"
    rows = docs.select("doc_id", "text", "held_out").mapInArrow(_score(shipped, model.order, model.tokens, model.types), made)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_row", "r.rare", "r.times")
    joined = rare.join(model.counts.withColumnRenamed("code", "rare"), "rare", "left")
    room = model.tokens + 0.5 * (model.types + 1)
    each = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(room))
    sums = joined.groupBy("_row").agg(F.sum(each).alias("b"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("k"))
    out = rows.drop("rare", "times", "odd", "odd_times").join(sums, "_row", "left")
    out = out.withColumn("odd_score", F.lit(0.0)) if model.longest is None else out.join(_odd_scores(rows, model), "_row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("common_base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("odd_score", F.lit(0.0))).alias("score"),
    )


def _adapt(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [adaptive_log10(b" ".join((t or "").encode().lower().split()), order) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def adaptive_score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(doc_id, score)`` where each document is coded by a model learned from its own earlier bytes only."""
    return docs.select("doc_id", "text").mapInArrow(_adapt(order), "doc_id long, score double")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def score_held_out(docs: DataFrame, modulus: int = 5, held: int = 1, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """Learn from the documents whose id's crc32 modulo ``modulus`` is not ``held``; score all of them."""
    marked = docs.select(F.col("doc_id").cast("long"), "text", (id_remainder("doc_id", modulus) == held).alias("held_out"))
    return score(marked, fit(marked.filter(~F.col("held_out")), order, share))


__all__ = ["Model", "Trie", "adaptive_score", "fit", "score", "score_held_out"]
