"""Near-duplicate groups: DartMinHash signatures, banded joining, exact verification, connected components.

Darts fall on each (shingle, weight) region as a Poisson process in rank, thrown by hashing the shingle and the dart's
number; each lands in one of ``k`` coordinates, and a coordinate keeps its earliest dart. Two documents agree in a
coordinate with probability equal to their (weighted) Jaccard similarity. About ``k ln k`` darts fill all coordinates,
however long the document is; documents with an empty coordinate are thrown again over a longer range of ranks.

Texts with the same shingle set are one node. A band is five coordinates of 16 bits; 32 bands miss a pair at 0.8 with
probability 3e-6. Nodes that share a band are linked in two steps, both on all of them:

1. linear: within each bucket, sorted by further coordinates, every node is verified against its neighbour and the first
   node of its run. Range partitioning splits large buckets. Components of the verified links follow.
2. exact for the rest: buckets that still hold several components. Every node outside a bucket's main component is
   verified against all nodes of the bucket, block by block, with set intersections as matrix products; only true links
   leave a block, one for each node and component.

Similarity is the Jaccard coefficient of the sets of ``size`` consecutive words (fewer words make one shingle), words
being unchanged runs of non-white-space. Null and empty texts have no shingle and are a class of their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from doctopics.llm.base import materialise, pack_rest, unpack_rest
from doctopics.llm.text import flat, mix, owners, pieces, signed, span_hashes, window_hashes, word_spans

BANDS = 32
ROWS = 5
SIZE = 5
SIMILARITY = 0.8
BLOCK = 256
BLOCK_BYTES = 4 << 20
FLOAT_CELLS = 1 << 22


# ---------------------------------------------------------------- shingles and signatures


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, how often each occurs in its text, and the n + 1 offsets."""
    data, offs = flat(texts)
    starts, ends, word_offs = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    hashes, whole = window_hashes(words, word_offs, size)
    owner = owners(word_offs)
    short = np.flatnonzero((np.diff(word_offs) > 0) & (np.diff(word_offs) < size))
    own, value = owner[whole], hashes[whole]
    if len(short):  # the windows of these run into the next text, so hash them apart
        extra = [window_hashes(words[word_offs[i] : word_offs[i + 1]], np.array([0, word_offs[i + 1] - word_offs[i]]), int(word_offs[i + 1] - word_offs[i]))[0][0] for i in short]
        own, value = np.concatenate([own, short]), np.concatenate([value, np.array(extra, np.uint64)])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(own)))
    return value[at], counts, np.searchsorted(own[at], np.arange(len(offs)))


def dart_minhash(elements: np.ndarray, weights: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Signatures (documents x k, 64-bit dart names) of sparse weighted sets; rows without elements are zero.

    ``weights`` may be any positive numbers: region v of an element holds the darts of weights v to v + 1, and a dart
    counts if its own weight lies below the element's.
    """
    n = len(offs) - 1
    names = np.zeros(n * k, np.uint64)
    owner = owners(offs)
    total = np.bincount(owner, weights=weights, minlength=n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = 2.0 ** np.ceil(np.log2(k * (np.log(k) + 4) / total[todo]))
    whole = np.ceil(weights).astype(np.int64)
    region = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    element = np.repeat(np.arange(len(elements)), whole)
    seed = mix(elements[element] ^ mix(region.astype(np.uint64) + np.uint64(0x51ED270B)))
    room = weights[element] - region
    doc = owner[element]
    while len(todo):
        best = np.full(n * k, np.inf)
        mine = np.isin(doc, todo) if len(todo) < n else np.ones(len(doc), bool)
        live_seed, live_doc, live_room, rank, throw = seed[mine], doc[mine], room[mine], np.zeros(mine.sum()), 0
        fallen = []
        while len(live_seed):
            throw += 1
            h = mix(live_seed + np.uint64(throw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < reach[live_doc]
            live_seed, live_doc, live_room, rank, h = live_seed[on], live_doc[on], live_room[on], rank[on], h[on]
            name = mix(h ^ np.uint64(0xA0761D6478BD642F))
            cell = live_doc * k + (name % np.uint64(k)).astype(np.int64)
            hit = (mix(name) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < live_room
            np.minimum.at(best, cell[hit], rank[hit])
            fallen.append((cell[hit], rank[hit], name[hit]))
        for cell, at, name in fallen:
            first = best[cell] == at
            names[cell[first]] = name[first]
        filled = np.isfinite(best.reshape(n, k)[todo]).all(axis=1)
        todo = todo[~filled]
        reach[todo] *= 2
    return names.reshape(n, k)


def _sign(size: int, bands: int, rows: int, by_count: bool):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in pieces(batches, most=1 << 20):
            values, counts, offs = shingles(part.column("text"), size)
            weights = counts.astype(float) if by_count else np.ones(len(values))
            names = dart_minhash(values, weights, offs, k)
            short = (names >> np.uint64(48)).astype("<u2")
            some = np.diff(offs) > 0
            owner = owners(offs)
            one, two = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
            np.add.at(one, owner, mix(values * np.uint64(3) + counts.astype(np.uint64) * np.uint64(by_count)))
            np.add.at(two, owner, mix(values ^ np.uint64(0xE7037ED1A0B428DB)))
            node = np.stack([one, two], axis=1).astype("<u8")
            packed = [None if t is None else press.compress(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(packed, pa.binary()),
                    pa.array([x.tobytes() if s else None for x, s in zip(node, some, strict=True)], pa.binary()),
                    pa.array([x.tobytes() if s else None for x, s in zip(short, some, strict=True)], pa.binary()),
                    part.column("_rest"),
                ],
                names=["doc_id", "ztext", "node", "sig", "_rest"],
            )

    return run


def _bands(bands: int, rows: int):
    """Band keys of each node and, to sort a bucket by, the four coordinates that follow the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(n, bands * rows).astype(np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                keys = mix(keys + sig[:, r::rows] + np.uint64(r + 1))
            keys = mix(keys ^ mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)))
            nxt = np.zeros((n, bands), np.uint64)
            for r in range(4):
                nxt = (nxt << np.uint64(16)) | np.roll(sig, -rows - r, axis=1)[:, ::rows]
            ids = batch.column("id").to_numpy()
            yield pa.record_batch(
                [
                    pa.array(signed(keys.reshape(-1))),
                    pa.array(signed(nxt.reshape(-1))),
                    pa.array(np.repeat(ids, bands)),
                ],
                names=["key", "nxt", "id"],
            )

    return run


# ---------------------------------------------------------------- links


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each row of a sorted partition with the row before and the first row of the same key."""
    last_key = last_id = first_id = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        before = np.concatenate([[ids[0] if last_id is None else last_id], ids[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(start >= 0, ids[np.maximum(start, 0)], ids[0] if first_id is None else first_id)
        a, b = np.concatenate([before[~new], first[~new]]), np.concatenate([ids[~new], ids[~new]])
        last_key, last_id, first_id = key[-1], ids[-1], first[-1]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _open(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(z) for z in column.to_pylist()], pa.binary())


def _verify(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "za", 1 << 18):
            left, _, loffs = shingles(_open(part.column("za")), size)
            right, _, roffs = shingles(_open(part.column("zb")), size)
            # both sides of a pair carry its number; an element on both sides occurs twice
            tag = np.concatenate([owners(loffs), owners(roffs)])
            value = np.concatenate([left, right])
            order = np.lexsort((value, tag))
            tag, value = tag[order], value[order]
            twice = (tag[1:] == tag[:-1]) & (value[1:] == value[:-1])
            both = np.bincount(tag[1:][twice], minlength=part.num_rows)
            union = np.diff(loffs) + np.diff(roffs) - both
            keep = both >= similarity * union
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(size: int, similarity: float):
    """True links between the nodes of two blocks, one for each left node and component on the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one pair of blocks at a time
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                ls, _, lo = shingles(_open(pa.array([x["ztext"] for x in left], pa.binary())), size)
                rs, _, ro = shingles(_open(pa.array([x["ztext"] for x in right], pa.binary())), size)
                known, column = np.unique(ls, return_inverse=True)
                at = np.searchsorted(known, rs)
                found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == rs)
                both = np.zeros((len(left), len(right)), np.float32)
                step = max(1, FLOAT_CELLS // (len(left) + len(right)))
                lown, rown = owners(lo), owners(ro)
                for c in range(0, len(known), step):
                    width = min(step, len(known) - c)
                    x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
                    own = (column >= c) & (column < c + width)
                    x[lown[own], column[own] - c] = 1
                    own = found & (at >= c) & (at < c + width)
                    y[rown[own], at[own] - c] = 1
                    both += x @ y.T
                union = np.diff(lo)[:, None] + np.diff(ro)[None, :] - both
                lcomp, rcomp = np.array([x["comp"] for x in left]), np.array([x["comp"] for x in right])
                true = (both >= similarity * union) & (lcomp[:, None] != rcomp[None, :])
                links = {(int(i), int(rcomp[j])): (left[i]["id"], right[j]["id"]) for i, j in np.argwhere(true)}
                pairs = sorted({(min(p), max(p)) for p in links.values()})
                if pairs:
                    yield pa.record_batch([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``(id, comp)``: smallest id of the connected component, for all ids in ``edges(a, b)``.

    Alternates stars over larger and over smaller neighbours (Kiveris et al. 2014) until nothing changes; each round is
    written to the shared folder, so lineage stays short.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        large = materialise(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialise(small.select("e.*").filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.selectExpr("u AS id", "v AS comp").unionByName(now.selectExpr("v AS id", "v AS comp").distinct())


def similar_links(nodes: DataFrame, texts: DataFrame, size: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """Enough true links ``(a, b)`` to connect all nodes ``(id, sig)`` that a chain of similar pairs connects."""
    keyed = nodes.select("id", "sig").mapInArrow(_bands(bands, rows), "key long, nxt long, id long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    pairs = (
        buckets.select("key", "nxt", "id")
        .repartitionByRange("key", "nxt", "id")
        .sortWithinPartitions("key", "nxt", "id")
        .mapInArrow(_neighbours, "a long, b long")
        .distinct()
    )
    involved = texts.join(buckets.select("id").distinct(), "id").select("id", "ztext")
    involved = materialise(involved, "bucket-texts")
    with_a = pairs.join(involved.selectExpr("id AS a", "ztext AS za"), "a")
    with_b = with_a.join(involved.selectExpr("id AS b", "ztext AS zb"), "b")
    links = materialise(with_b.select("a", "b", "za", "zb").mapInArrow(_verify(size, similarity), "a long, b long"), "links")

    comps = components(links)
    placed = buckets.select("key", "m", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    mixed = mixed.filter("kinds > 1").select("key", "main")
    # buckets of different bands with the same members are compared once
    members = placed.join(mixed, "key").join(involved.select("id", F.octet_length("ztext").alias("bytes")), "id")
    alike = members.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    single = alike.groupBy("m", "bytes", "x", "y").agg(F.min("key").alias("key"))
    single = single.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).select("key", "blocks")
    members = members.select("id", "key", "comp", "main").join(single, "key")
    members = materialise(members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks"), "members")
    # pairs of blocks are numbers only; texts come by bucket and block, so a large bucket is many keys
    held = members.select("key", "block", (F.col("comp") != F.col("main")).alias("apart")).distinct()
    which = held.filter("apart").select("key", F.col("block").alias("block_a")).join(held.select("key", F.col("block").alias("block_b")).distinct(), "key")
    filled = members.join(involved, "id")
    member = F.struct("id", "comp", "ztext")
    right = filled.groupBy("key", F.col("block").alias("block_b")).agg(F.collect_list(member).alias("right"))
    left = filled.filter("comp <> main").groupBy("key", F.col("block").alias("block_a")).agg(F.collect_list(member).alias("left"))
    joined = which.join(left, ["key", "block_a"]).join(right, ["key", "block_b"]).select("left", "right")
    rest = joined.mapInArrow(_block_links(size, similarity), "a long, b long")
    return links.unionByName(rest.distinct())


def near_duplicates(
    docs: DataFrame,
    size: int = SIZE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    weight: str = "set",
) -> DataFrame:
    """All columns of ``docs`` plus ``class_id``, ``class_size`` (long) and ``kept``.

    A class is a connected component of the links of ``similarity`` or more; its id is its smallest document id and one of
    its rows is kept, that with the smallest id. ``weight="count"`` signs multisets (weighted darts) instead of sets; links
    are verified on sets either way. Rows that repeat an id and differ in text may fall in different classes. Null ids
    take part; they name a class only if it has no other id.
    """
    packed = pack_rest(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("ztext", BinaryType()),
            StructField("node", BinaryType()),
            StructField("sig", BinaryType()),
            packed.schema["_rest"],
        ]
    )
    signed_docs = packed.mapInArrow(_sign(size, bands, rows, weight == "count"), schema)
    signed_docs = materialise(signed_docs.withColumn("_row", F.monotonically_increasing_id()), "signed")
    found = signed_docs.filter("node IS NOT NULL").groupBy("node")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "_row")).alias("first")
    nodes = found.agg(first, F.first("sig").alias("sig"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    texts = nodes.select("id", F.col("first._row").alias("_row")).join(signed_docs.select("_row", "ztext"), "_row")
    comps = materialise(components(similar_links(nodes, texts, size, similarity, bands, rows)), "components")
    member = nodes.join(comps, "id", "left").select("node", "first", F.coalesce("comp", "id").alias("comp"))
    counts = signed_docs.groupBy("node").agg(F.count("*").alias("n"))
    member = materialise(member.join(counts, "node"), "members")
    classes = member.groupBy("comp").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    of_node = member.join(classes, "comp").select("node", "head", "class_size")
    out = signed_docs.select("doc_id", "ztext", "node", "_row", "_rest").join(of_node, "node", "left")
    real = F.when(F.col("head.d") < 2**63 - 1, F.col("head.d"))
    out = out.select(
        "doc_id",
        "ztext",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(real).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("head._row") == F.col("_row"), F.lit(True)).alias("kept"),
        "_rest",
    )
    return out


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, class_id, class_size, kept)``, one row for each row of ``docs``."""
    return near_duplicates(docs.select("doc_id", "text"), **options).select("doc_id", "class_id", "class_size", "kept")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for part in pieces(batches, "ztext", 1 << 19):
        texts = [None if z is None else unpack.decompress(z).decode() for z in part.column("ztext").to_pylist()]
        columns = [pa.array(texts, pa.string()) if c == "ztext" else part.column(c) for c in part.schema.names]
        yield pa.record_batch(columns, names=["text" if c == "ztext" else c for c in part.schema.names])


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    kept = near_duplicates(docs, **options).filter("kept").select("doc_id", "ztext", "_rest")
    kind = ", ".join(["doc_id long", "text string", "_rest " + kept.schema["_rest"].dataType.simpleString()])
    return unpack_rest(kept.mapInArrow(_unpack, kind)).select(*docs.columns)
