"""Evaluation of topic assignments against labels.

Everything after ``contingency`` works on counts per (label, topic), a table of model size.
``by`` names extra key columns (model, split), so many models are scored in one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doctopics.constants import (
    RATING_BANDS,
    RATING_BANDS_REST,
    SUCCESS_BANDS,
    SUCCESS_BANDS_REST,
)
from doctopics.runtime import counted_broadcast, one_row

OUTLIER = -1


def drop_unassigned(df: DataFrame, label_col: str = "label0", topic_col: str = "topic") -> DataFrame:
    return df.filter((F.col(topic_col) != OUTLIER) & (F.col(label_col) != OUTLIER))


def contingency(
    df: DataFrame,
    label_col: str = "label0",
    topic_col: str = "topic",
    by: Sequence[str] = (),
    values: Sequence[int] | None = None,
) -> DataFrame:
    """Rows per (label, topic); ``values`` restricts both to a fixed list, as a 4 x 4 matrix would."""
    if values is not None:
        df = df.filter(F.col(label_col).isin(*values) & F.col(topic_col).isin(*values))
    return df.groupBy(*by, F.col(label_col).alias("label"), F.col(topic_col).alias("topic")).agg(F.count("*").alias("n"))


def contingency_wide(counts: DataFrame, topics: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One column per topic."""
    return counts.groupBy(*by, "label").pivot("topic", list(topics)).agg(F.sum("n")).na.fill(0)


# ---------------------------------------------------------------- one-to-one alignment


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs of a maximum-sum one-to-one assignment (shortest augmenting paths, O(rows^2 * columns))."""
    if gain.shape[0] > gain.shape[1]:
        return [(r, c) for c, r in best_assignment(gain.T)]
    rows, cols = gain.shape
    cost = -gain.astype(float)
    row_price, col_price = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, dtype=int)  # row (from 1) that owns a column; column 0 is the entry point
    for row in range(1, rows + 1):
        owner[0], at = row, 0
        reach = np.full(cols + 1, np.inf)
        came_from = np.zeros(cols + 1, dtype=int)
        done = np.zeros(cols + 1, dtype=bool)
        while owner[at] != 0:
            done[at] = True
            slack = cost[owner[at] - 1] - row_price[owner[at]] - col_price[1:]
            better = ~done[1:] & (slack < reach[1:])
            reach[1:][better] = slack[better]
            came_from[1:][better] = at
            nxt = 1 + int(np.argmin(np.where(done[1:], np.inf, reach[1:])))
            step = reach[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            reach[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[came_from[at]]
            at = came_from[at]
    return [(int(owner[c]) - 1, c - 1) for c in range(1, cols + 1) if owner[c]]


def align_topics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Topic to label, one to one, maximising matched rows: ``(*by, topic, label, n)``.

    The counts are labels x topics per model, so they are solved on the driver.
    """
    by = list(by)
    tables: dict[tuple, dict[tuple, int]] = defaultdict(dict)
    for r in counts.select(*by, "label", "topic", "n").collect():
        tables[tuple(r[n] for n in by)][(r["label"], r["topic"])] = r["n"]
    out = []
    for key, cells in tables.items():
        labels, topics = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
        gain = np.zeros((len(labels), len(topics)))
        for (a, b), n in cells.items():
            gain[labels.index(a), topics.index(b)] = n
        out += [(*key, topics[j], labels[i], int(gain[i, j])) for i, j in best_assignment(gain)]
    kinds = {f.name: f.dataType for f in counts.schema.fields}
    schema = T.StructType(
        [T.StructField(n, kinds[n]) for n in [*by, "topic", "label"]] + [T.StructField("n", T.LongType())]
    )
    return counts.sparkSession.createDataFrame(sorted(out), schema)


def aligned_accuracy(counts: DataFrame, alignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matched rows over all rows."""
    by = list(by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    matched = alignment.groupBy(*by).agg(F.sum("n").alias("matched"))
    joined = total.join(F.broadcast(matched), by) if by else one_row(total, matched)
    return joined.select(*by, "matched", "total", (F.col("matched") / F.col("total")).alias("Aligned_Accuracy"))


def alignment_table(alignment: DataFrame, names: dict[int, str]) -> DataFrame:
    """Alignment with the label's name."""
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return alignment.withColumn("label_name", F.try_element_at(pairs, "label"))


def aligned_predictions(
    df: DataFrame, alignment: DataFrame, topic_col: str = "topic", by: Sequence[str] = (), out_col: str = "pred"
) -> DataFrame:
    """Topic replaced by its aligned label; a topic without one becomes label 0."""
    side = alignment.select(*by, F.col("topic").alias(topic_col), F.col("label").alias(out_col))
    joined = df.join(counted_broadcast(side), [*by, topic_col], "left")
    return joined.withColumn(out_col, F.coalesce(out_col, F.lit(0)))


# ---------------------------------------------------------------- scores


def _entropy(shares: Column) -> Column:
    return -F.sum(shares * F.ln(shares))


def clustering_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ARI, NMI, homogeneity, completeness and V-measure from the contingency counts.

    Counts are squared as doubles, so tables of 10^10 rows do not overflow.
    """
    by = list(by)
    n = F.col("n").cast("double")
    wide = counts.withColumns(
        {
            "n": n,
            "a": F.sum(n).over(Window.partitionBy(*by, "label")),
            "b": F.sum(n).over(Window.partitionBy(*by, "topic")),
            "total": F.sum(n).over(Window.partitionBy(*by)),
        }
    )
    n, a, b, total = (F.col(x) for x in ("n", "a", "b", "total"))
    sums = wide.groupBy(*by).agg(
        F.max(total).alias("total"),
        F.sum(n * (n - 1)).alias("same"),
        # Each row total appears once per cell of its row: weight by the cell's share of the row.
        F.sum(n * (a - 1)).alias("label_pairs"),
        F.sum(n * (b - 1)).alias("topic_pairs"),
        F.sum(n / total * F.ln(total * n / (a * b))).alias("mi"),
        (-F.sum(n / total * F.ln(a / total))).alias("h_label"),
        (-F.sum(n / total * F.ln(b / total))).alias("h_topic"),
    )
    pairs = F.col("total") * (F.col("total") - 1)
    expected = F.try_divide(F.col("label_pairs") * F.col("topic_pairs"), pairs)
    upper = (F.col("label_pairs") + F.col("topic_pairs")) / 2
    perfect = (F.col("same") == F.col("label_pairs")) & (F.col("same") == F.col("topic_pairs"))
    ari = F.when(perfect, F.lit(1.0)).otherwise(F.try_divide(F.col("same") - expected, upper - expected))
    h = F.when(F.abs("h_label") < 1e-15, F.lit(1.0)).otherwise(F.try_divide("mi", "h_label"))
    c = F.when(F.abs("h_topic") < 1e-15, F.lit(1.0)).otherwise(F.try_divide("mi", "h_topic"))
    scored = sums.withColumns({"Homogeneity": h, "Completeness": c})
    h, c = F.col("Homogeneity"), F.col("Completeness")
    v = F.when(h + c == 0, F.lit(0.0)).otherwise(2 * h * c / (h + c))
    return scored.select(
        *by, ari.alias("ARI"), v.alias("NMI"), h.alias("Homogeneity"), c.alias("Completeness"), v.alias("V-Measure")
    )


def accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    equal = F.col(label_col) == F.col(pred_col)
    return df.groupBy(*by).agg(F.avg(F.when(equal, 1.0).otherwise(0.0)).alias("Accuracy"))


def _per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """Support, guesses and hits per class; each cell counts for its true and for its predicted class."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(none)

    def side(cls: str, support: Column, guessed: Column, hits: Column) -> Column:
        return F.struct(F.col(cls).alias("cls"), support.alias("support"), guessed.alias("guessed"), hits.alias("hits"))

    sides = cells.select(*by, F.inline(F.array(side("label", n, none, hit), side("pred", none, n, none))))
    return sides.groupBy(*by, "cls").agg(*[F.sum(x).alias(x) for x in ("support", "guessed", "hits")])


def classification_report(
    df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages; 0/0 counts as 0."""
    by = list(by)
    cells = df.groupBy(*by, F.col(label_col).alias("label"), F.col(pred_col).alias("pred")).agg(F.count("*").alias("n"))
    per = _per_class(cells, by)
    p = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    per = per.withColumns({"precision": p, "recall": r})
    p, r, s = F.col("precision"), F.col("recall"), F.col("support")
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    metrics = ["precision", "recall", "f1"]
    classes = per.select(*by, F.col("cls").cast("string").alias("class"), *metrics, "support")
    averages = per.groupBy(*by).agg(
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[F.try_divide(F.sum(F.col(m) * s), F.sum(s)).alias(f"weighted_{m}") for m in metrics],
    )
    share = F.try_divide("hits", "support")
    rows = [
        F.struct(F.lit("accuracy").alias("class"), *[share.alias(m) for m in metrics]),
        *[
            F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{m}").alias(m) for m in metrics])
            for kind in ("macro", "weighted")
        ],
    ]
    summary = averages.select(*by, "support", F.inline(F.array(*rows)))
    return classes.unionByName(summary)


def model_metrics(
    df: DataFrame, label_col: str = "label0", topic_col: str = "topic", by: Sequence[str] = ("model",)
) -> DataFrame:
    """Clustering scores, aligned accuracy and F1 averages, one row per key."""
    by = list(by)
    counts = contingency(drop_unassigned(df, label_col, topic_col), label_col, topic_col, by).persist()
    alignment = align_topics(counts, by)
    scores = clustering_scores(counts, by)
    hits = aligned_accuracy(counts, alignment, by).select(*by, "Aligned_Accuracy")
    # The report needs counts only, so it is computed from the contingency table, not from documents.
    side = alignment.select(*by, "topic", F.col("label").alias("pred"))
    cells = counts.join(F.broadcast(side), [*by, "topic"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
    f1 = report_from_counts(cells, by)
    out = scores.join(F.broadcast(hits), by).join(F.broadcast(f1), by)
    return out


def report_from_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro and weighted F1 from rows ``(*by, label, pred, n)``."""
    by = list(by)
    per = _per_class(cells, by)
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guessed")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    return per.groupBy(*by).agg(
        F.avg("f1").alias("Macro_F1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("Weighted_F1"),
    )


def topic_diversity(topic_words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct words over all topics divided by all words; 0 without words."""
    share = F.try_divide(F.count_distinct("term"), F.count("term"))
    return topic_words.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("Diversity"))


def rating_band(score: Column, scale: str = "rating") -> Column:
    """Accuracy to its verbal band."""
    bands, rest = (RATING_BANDS, RATING_BANDS_REST) if scale == "rating" else (SUCCESS_BANDS, SUCCESS_BANDS_REST)
    out = None
    for bound, name in bands:
        out = F.when(score > bound, name) if out is None else out.when(score > bound, name)
    return F.when(score.isNotNull(), out.otherwise(rest))
