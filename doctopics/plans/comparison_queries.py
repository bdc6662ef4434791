"""Ensembles and comparison tables over fixed assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import coherence
from doctopics.operators import comparison as cmp
from doctopics.operators import evaluation as ev
from doctopics.operators import terms
from doctopics.plans.base import V_ASSIGN, WORDS_CTE, assignments, documents, r6, register, tokens
from doctopics.plans.evaluation_queries import METRICS, SCORE_NAMES, topic_words
from doctopics.plans.topic_queries import COHERENCE_SQL
from doctopics.runtime import one_row


@register(
    "ensemble_vote",
    f"""WITH {V_ASSIGN}, votes AS (SELECT doc_id, topic, count(*) AS n, min(model_order) AS o FROM v_assign GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS rn FROM votes)
    SELECT doc_id, CAST(topic AS INT) AS topic FROM r WHERE rn = 1""",
)
def ensemble_vote(spark, sf_dir):
    return cmp.ensemble_vote(assignments(spark, sf_dir))


RENAMED = {**SCORE_NAMES, "Aligned_Accuracy": "aligned_accuracy"}
BOARD_SQL = """round(ari, 4) + 0.0 AS ari, round(v, 4) AS nmi, round(h, 4) AS homogeneity, round(c, 4) AS completeness,
    round(v, 4) AS v_measure, round(acc, 4) AS aligned_accuracy"""


def _board(spark, sf_dir):
    long = cmp.unpivot_metrics(ev.model_metrics(assignments(spark, sf_dir)))
    return cmp.leaderboard(long)


@register("leaderboard", f"WITH {V_ASSIGN}, {METRICS} SELECT model, {BOARD_SQL}, round(macro, 4) AS macro_f1, round(weighted, 4) AS weighted_f1 FROM metrics")
def leaderboard(spark, sf_dir):
    names = {**RENAMED, "Macro_F1": "macro_f1", "Weighted_F1": "weighted_f1"}
    return _board(spark, sf_dir).select("model", *[r6(f"`{k}`", v) for k, v in names.items()])


_UNPIVOT = " UNION ALL ".join(
    f"SELECT model, '{metric}' AS metric, {name} AS value FROM board" for metric, name in RENAMED.items()
)


@register(
    "best_model_per_metric",
    f"""WITH {V_ASSIGN}, {METRICS}, board AS (SELECT model, {BOARD_SQL} FROM metrics), long AS ({_UNPIVOT}),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn FROM long)
    SELECT metric, model, value FROM r WHERE rn = 1""",
)
def best_model_per_metric(spark, sf_dir):
    board = _board(spark, sf_dir).withColumn("model_order", F.substring("model", 2, 1).cast("int"))
    return cmp.best_model_per_metric(board).select("metric", "model", r6("value", "value"))


@register(
    "final_comparison",
    f"""{COHERENCE_SQL}, {V_ASSIGN}, {METRICS},
    div AS (SELECT count(DISTINCT term) / CAST(count(*) AS DOUBLE) AS d FROM topic_words),
    coh AS (SELECT avg(k) AS k FROM (SELECT topic, avg(c) AS k FROM cos GROUP BY topic))
    SELECT model AS "Model", CAST(NULL AS DOUBLE) AS "Coherence", CAST(NULL AS DOUBLE) AS "Diversity", round(ari, 6) + 0.0 AS "ARI",
      round(v, 6) AS "NMI", round(h, 6) AS "Homogeneity", round(c, 6) AS "Completeness", round(v, 6) AS "V-Measure",
      round(acc, 6) AS "Accuracy", true AS timed FROM metrics
    UNION ALL SELECT 'class terms', round(k, 6), round(d, 6), NULL, NULL, NULL, NULL, NULL, NULL, true FROM div, coh""",
)
def final_comparison(spark, sf_dir):
    """Assignments scored against the labels, and described topics by coherence and diversity; each with its run time."""
    words = topic_words(spark, sf_dir)

    def scored():
        return ev.model_metrics(assignments(spark, sf_dir)).withColumnsRenamed({"model": "Model", "Aligned_Accuracy": "Accuracy"})

    def described():
        mean = coherence.coherence_cv(tokens(spark, sf_dir), words).agg(F.avg("coherence").alias("Coherence"))
        return one_row(ev.topic_diversity(words).withColumn("Model", F.lit("class terms")), mean)

    timed = [cmp.timed(job) for job in (scored, described)]
    table = cmp.final_comparison([rows.withColumn("Runtime (s)", F.lit(seconds)) for rows, seconds in timed])
    numbers = [n for n in table.columns if n not in ("Model", "Runtime (s)")]
    return table.select("Model", *[r6(f"`{n}`", n) for n in numbers], (F.col("`Runtime (s)`") > 0).alias("timed"))


@register(
    "job_runs",
    f"""WITH {WORDS_CTE} SELECT 'term_frequency' AS job, count(DISTINCT term) AS rows FROM words
    UNION ALL SELECT 'clustering_scores', 3
    UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def job_runs(spark, sf_dir):
    jobs = {
        "term_frequency": lambda: terms.term_frequency(tokens(spark, sf_dir)),
        "clustering_scores": lambda: ev.clustering_scores(ev.contingency(assignments(spark, sf_dir), by=["model"]), ["model"]),
        "documents": lambda: documents(spark, sf_dir),
    }
    return cmp.job_runs(spark, jobs).select("job", "rows")
