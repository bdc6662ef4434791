"""Quoted CSV read in parallel: one large file in many tasks, although quotes may hold line breaks.

Spark splits a file into byte ranges of whole lines. Whether a range starts inside quotes depends on the number of quotes
before it, so a first pass adds up the quotes of each range, and a prefix sum over the ranges of a file (a row a range, as
many as the driver plans anyway) says where each one stands. The second pass then knows of each line whether a record starts
there. Records on one line, nearly all, are parsed where they are; only lines of records that hold a line break are shuffled,
by their record.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "file string, block long, seq long, value string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """File, range, lines and their quotes, for each stretch of lines of one range."""
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        if not len(block):
            continue
        files = batch.column("file").dictionary_encode()
        which = files.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((block[1:] != block[:-1]) | (which[1:] != which[:-1])) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(block))):
            lines = batch.column("value").slice(a, b - a)
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            yield files.dictionary[which[a]].as_py(), int(block[a]), lines, quotes


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: lines, quotes, and the last line that starts a record if the range starts outside or inside quotes."""
    found: dict[tuple[str, int], list[int]] = {}
    for file, block, lines, quotes in _runs(batches):
        own = found.setdefault((file, block), [0, 0, -1, -1])
        before = own[1] + np.cumsum(quotes) - quotes
        for inside in (0, 1):
            starts = np.flatnonzero((before + inside) % 2 == 0)
            if len(starts):
                own[2 + inside] = own[0] + int(starts[-1])
        own[0] += len(lines)
        own[1] += int(quotes.sum())
    rows = [(*key, *own) for key, own in found.items()]
    kinds = [pa.string(), *[pa.int64()] * 5]
    columns = zip(*rows) if rows else [()] * 6
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "n", "quotes", "outside", "inside"])


def _standing(rows: list) -> dict[tuple[str, int], tuple[int, int, int]]:
    """Per range: whether it starts inside quotes, and the range and line at which that record starts."""
    out = {}
    for file, blocks in groupby(sorted(rows, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        inside, owner = 0, (-1, -1)
        for r in blocks:
            out[file, r["block"]] = (inside, *owner)
            last = r["inside"] if inside else r["outside"]
            inside = (inside + r["quotes"]) % 2
            if last >= 0:
                owner = (r["block"], last)
    return out


def _marked(standing):
    """Lines with the record they belong to; ``whole`` if the record is on this line alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = standing.value
        state: dict[tuple[str, int], list[int]] = {}
        for file, block, lines, quotes in _runs(batches):
            inside, owner_block, owner_seq = known[file, block]
            own = state.setdefault((file, block), [0, inside, owner_block, owner_seq])
            before = own[1] + np.cumsum(quotes) - quotes
            starts = before % 2 == 0
            seq = own[0] + np.arange(len(lines))
            last = np.maximum.accumulate(np.where(starts, np.arange(len(lines)), -1))
            of_seq = np.where(last >= 0, seq[np.maximum(last, 0)], own[3])
            of_block = np.where(last >= 0, block, own[2])
            n = len(lines)
            yield pa.record_batch(
                [
                    pa.array([file] * n, pa.string()), pa.array(np.full(n, block)), pa.array(seq), lines,
                    pa.array(of_block.astype(np.int64)), pa.array(of_seq.astype(np.int64)), pa.array(starts & (quotes % 2 == 0)),
                ],
                names=["file", "block", "seq", "value", "of_block", "of_seq", "whole"],
            )
            own[0], own[1] = own[0] + n, int(own[1] + quotes.sum())
            own[2], own[3] = int(of_block[-1]), int(of_seq[-1])

    return run


def quoted_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """``(file, block, seq, record)``: the raw text of each record and the place at which it starts."""
    lines = spark.read.option("lineSep", "\n").text(path)
    utf8 = encoding.lower().replace("-", "") == "utf8"
    # the reader passes bytes through
    value = F.make_valid_utf8("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))
    found = lines.mapInArrow(_summaries, "file string, block long, n long, quotes long, outside long, inside long").collect()
    standing = spark.sparkContext.broadcast(_standing(found))
    marked = lines.mapInArrow(_marked(standing), f"{LINE}, of_block long, of_seq long, whole boolean")
    alone = marked.filter("whole").select("file", "block", "seq", F.col("value").alias("record"))
    part = F.struct("block", "seq", "value")
    parts = marked.filter("NOT whole").groupBy("file", "of_block", "of_seq").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = parts.select("file", F.col("of_block").alias("block"), F.col("of_seq").alias("seq"), F.array_join(F.col("p.value"), "\n").alias("record"))
    return alone.unionByName(joined)


def read_quoted_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, encoding: str = "UTF-8", options: dict | None = None, place_col: str | None = None
) -> DataFrame:
    """Rows of CSV files with a header line; fields may hold line breaks inside quotes, doubled quotes are quotes.

    The encoding must write a line break and a quote as one byte of its own, as UTF-8 and the ISO-8859 family do.
    ``place_col`` adds where a row starts (file, range, line), which sorts into file order.
    """
    rows = quoted_records(spark, path, encoding)
    header = (F.col("block") == 0) & (F.col("seq") == 0)
    text = F.regexp_replace("record", "\r$", "")
    kind = schema if isinstance(schema, str) else schema.toDDL()
    parsed = F.from_csv(text, kind, {"escape": '"', "maxCharsPerColumn": "-1", **(options or {})})
    out = rows.filter(~header & (text != "")).select(F.struct("file", "block", "seq").alias("_place"), parsed.alias("_row"))
    return out.select("_row.*", *([F.col("_place").alias(place_col)] if place_col else []))
