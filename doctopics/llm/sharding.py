"""Proportional stratified interleaving: shards of equal row counts that all have the mixture of the sources.

Rows get a seeded shuffle key, their rank by it within their source, and from that a fractional rank in (0, 1). Sorted by
fractional rank the sources interleave in proportion, so any run of rows has the mixture, and cutting the order into
equal runs gives the shards.

Both rankings count buckets first: ``ceil(sqrt(rows))`` ranges of the key, whose sizes are summed up in one small window,
then row numbers within a bucket. A source with a third of all rows is spread over all its buckets, no sort is global, and
nothing is sampled, so a repeated task gives the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctopics.llm.base import materialise

SHARDS = 24
SEED = "42"
KEY_BITS = 52


def shuffle_key(seed: str, *columns: Column) -> Column:
    """Seeded 52-bit key: the leading 13 hexadecimal digits of an md5."""
    text = F.concat_ws("-", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """Add ``rank`` (from 1) within ``group`` and the group's ``total``; ``bucket`` must not decrease along ``order``."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_in"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(*group)).alias(total)
    )
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    return numbered.join(sizes, [*group, "_bucket"]).withColumn(rank, F.col("_before") + F.col("_n")).drop("_bucket", "_n", "_before")


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` ("rows"), ``shard``, ``slot`` and ``grown_shard`` (null) per row.

    Shard sizes differ by one row at most. ``size`` is the text's UTF-8 bytes plus 8. Null texts count as empty; rows
    without a source are a stratum of their own; null ids and repeated rows are placed like any row.
    """
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("none")).alias("_source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    light = light.withColumn("_key", shuffle_key(seed, F.col("doc_id"), F.col("text_crc32")))
    light = materialise(light, "shard-rows")  # texts are read once
    rows = light.count()
    buckets = max(1, int(rows**0.5) + 1)
    order = ["_key", "doc_id", "text_crc32", "size"]
    by_key = F.floor(F.col("_key") * F.lit(buckets / 2.0**KEY_BITS))
    ranked = _ranked(light, ["_source"], by_key, order, "_rank", "_total")
    ranked = ranked.withColumn("_fraction", (2 * F.col("_rank") - 1) / (2 * F.col("_total")))
    by_fraction = F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1))
    ranked = ranked.drop("_rank", "_total").withColumn("_all", F.lit(0))
    placed = _ranked(ranked, ["_all"], by_fraction, ["_fraction", "_source", *order], "_place", "_rows")
    shard = F.expr(f"(_place - 1) * {shards} DIV _rows").cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * _rows + {shards - 1}) DIV {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_place") - 1 - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
