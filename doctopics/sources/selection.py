"""Row selection, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doctopics.constants import LABEL_NAMES
from doctopics.runtime import counted_broadcast

# Buckets of one histogram pass when searching exact cut points.
HISTOGRAM_BUCKETS = 4096
# Hexadecimal digits of a hash that name its histogram bucket.
PREFIX_DIGITS = 4


def label_counts(df: DataFrame, label_col: str = "labels") -> DataFrame:
    return df.groupBy(label_col).agg(F.count("*").alias("n_rows"))


def first_n(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``n`` rows in id order (a distributed top-n, not a full sort)."""
    return df.orderBy(id_col).limit(n)


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in mapping.items() for x in item])


def label_lookup(c: Column, names: dict[int, str] = LABEL_NAMES) -> Column:
    """Class id to name, null for an unknown id."""
    return F.try_element_at(_literal_map(names), c)


def label_reverse_lookup(c: Column, names: dict[int, str] = LABEL_NAMES) -> Column:
    """Class name to id, null for an unknown name."""
    return F.try_element_at(_literal_map({v: k for k, v in names.items()}), c)


def label_to_zero_based(df: DataFrame, label_col: str = "labels", out_col: str = "label0") -> DataFrame:
    """Numeric labels minus one; rows whose label is not a number are dropped."""
    number = F.floor(F.col(label_col).try_cast("double")).cast("int")
    return df.withColumn(out_col, number - 1).filter(F.col(out_col).isNotNull())


def label_index(df: DataFrame, label_col: str = "labels", out_col: str = "label_idx") -> DataFrame:
    """Add the position 0..k-1 of the label in sorted order."""
    index = label_index_table(df, label_col, out_col)
    return df.join(counted_broadcast(index), label_col, "left")


def label_index_table(df: DataFrame, label_col: str = "labels", out_col: str = "label_idx") -> DataFrame:
    distinct = df.select(label_col).filter(F.col(label_col).isNotNull()).distinct()
    rank = F.row_number().over(Window.orderBy(label_col)) - 1
    return distinct.withColumn(out_col, rank.cast("int"))


def split_hash(id_col: str, seed: int) -> Column:
    """Seeded hash that other SQL engines compute alike."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def stratified_split(
    df: DataFrame,
    label_col: str = "labels",
    id_col: str = "doc_id",
    train_fraction: float | None = 0.8,
    train_size: int | None = None,
    seed: int = 42,
    out_col: str = "split",
) -> DataFrame:
    """Exact split per label: the rows with the smallest hashes become ``train``, the rest ``test``.

    Per label the last training hash is found first, from ids and labels alone: a histogram of hash
    prefixes (at most 65,536 counts per label) names the one bucket holding the cut, and only that
    bucket's rows are ranked. The split itself is then a comparison with a broadcast threshold, so no
    document is shuffled and a label with a third of all rows costs no more than the others.
    """
    keys = df.select(label_col, id_col).withColumn("_h", split_hash(id_col, seed))
    keys = keys.withColumn("_b", F.conv(F.substring("_h", 1, PREFIX_DIGITS), 16, 10).cast("int"))
    histogram = keys.groupBy(label_col, "_b").agg(F.count("*").alias("_n"))
    sizes = histogram.groupBy(label_col).agg(F.sum("_n").alias("_total"))
    if train_size is not None:
        sizes = _largest_remainder(sizes, label_col, train_size)
    else:
        sizes = sizes.withColumn("_want", F.round(F.col("_total") * F.lit(train_fraction)).cast("long"))

    before = F.sum("_n").over(Window.partitionBy(label_col).orderBy("_b")) - F.col("_n")
    cuts = (
        histogram.withColumn("_before", before)
        .join(sizes, label_col)
        .filter((F.col("_before") <= F.col("_want")) & (F.col("_want") < F.col("_before") + F.col("_n")))
        .select(label_col, F.col("_b"), (F.col("_want") - F.col("_before")).alias("_rest"))
    )
    cuts = counted_broadcast(cuts)
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy("_h", id_col))
    last = (
        keys.join(cuts, [label_col, "_b"])
        .withColumn("_r", rank)
        .filter(F.col("_r") == F.col("_rest"))
        .select(label_col, F.col("_h").alias("_last"))
    )
    # A cut between buckets is the bare prefix: it sorts before every hash that starts with it. A label
    # without cut wants all of its rows; "g" sorts after every hexadecimal digit.
    prefix = F.lower(F.lpad(F.hex("_b"), PREFIX_DIGITS, "0"))
    bound = F.when(F.col("_rest").isNull(), "g").when(F.col("_rest") == 0, prefix).otherwise(F.col("_last"))
    bounds = (
        sizes.select(label_col).join(cuts, label_col, "left").join(last, label_col, "left").select(label_col, bound.alias("_bound"))
    )
    marked = df.join(counted_broadcast(bounds), label_col, "left")
    side = F.when(split_hash(id_col, seed) <= F.col("_bound"), "train").otherwise("test")
    return marked.withColumn(out_col, side).select(*df.columns, out_col)


def _largest_remainder(sizes: DataFrame, label_col: str, train_size: int) -> DataFrame:
    """Share ``train_size`` over the labels in proportion to their rows (one row per label)."""
    share = F.col("_total") * F.lit(train_size) / F.sum("_total").over(Window.partitionBy())
    base = sizes.withColumn("_base", F.floor(share)).withColumn("_frac", share - F.floor(share))
    missing = F.lit(train_size) - F.sum("_base").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc("_frac"), label_col))
    return base.withColumn("_want", (F.col("_base") + F.when(order <= missing, 1).otherwise(0)).cast("long")).drop(
        "_base", "_frac"
    )


def _bucket(id_col: str, lo: int, hi: int, width: int) -> Column:
    # Ids spread over the whole BIGINT range would overflow a BIGINT difference.
    kind = "bigint" if hi - lo < 2**63 else "decimal(20, 0)"
    return F.expr(f"cast((cast(`{id_col}` as {kind}) - cast({lo} as {kind})) div cast({width} as {kind}) as bigint)")


def cut_points(df: DataFrame, id_col: str, positions: list[int]) -> list[int]:
    """Exact values at the given 0-based positions of a sorted BIGINT column.

    Each pass counts one level of a narrowing histogram (map-side combined, at most 4,096 counts per
    position leave the executors), so no row is sorted or moved. Six passes cover the BIGINT range.
    """
    if not positions:
        return []
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    state = {p: (int(low), int(high), p) for p in positions}
    while any(lo < hi for lo, hi, _ in state.values()):
        spans = {}
        for lo, hi, _ in state.values():
            if lo < hi:
                spans[(lo, hi)] = -(-(hi - lo + 1) // HISTOGRAM_BUCKETS)
        counts = {}
        for (lo, hi), width in spans.items():
            rows = (
                df.filter(F.col(id_col).between(lo, hi))
                .groupBy(_bucket(id_col, lo, hi, width).alias("b"))
                .agg(F.count("*").alias("n"))
                .orderBy("b")
                .collect()
            )
            counts[(lo, hi)] = rows
        for p, (lo, hi, rank) in state.items():
            if lo == hi:
                continue
            width = spans[(lo, hi)]
            for b, n in counts[(lo, hi)]:
                if rank < n:
                    start = lo + b * width
                    state[p] = (start, min(start + width - 1, hi), rank)
                    break
                rank -= n
    return [state[p][0] for p in positions]


def kfold(df: DataFrame, k: int = 3, id_col: str = "doc_id", out_col: str = "fold") -> DataFrame:
    """Contiguous folds in id order, the first ``n mod k`` folds one row larger. Ids must be unique."""
    n = df.count()
    starts, at = [], 0
    for i in range(k - 1):
        at += n // k + (1 if i < n % k else 0)
        starts.append(at)
    bounds = cut_points(df, id_col, [s for s in starts if s < n])
    fold = F.lit(0)
    for b in bounds:
        fold = fold + (F.col(id_col) >= F.lit(b)).cast("int")
    return df.withColumn(out_col, fold)


def samples_per_label(
    df: DataFrame, label_col: str = "labels", id_col: str = "doc_id", columns: list[str] | None = None
) -> DataFrame:
    """First document of each label."""
    columns = columns or [n for n in df.columns if n not in (label_col, id_col)]
    first = F.min_by(F.struct(*columns), id_col).alias("_first")
    return df.groupBy(label_col).agg(F.min(id_col).alias(id_col), first).select(label_col, id_col, "_first.*")
