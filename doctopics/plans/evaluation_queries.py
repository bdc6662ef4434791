"""Evaluation of fixed assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import evaluation as ev
from doctopics.plans.base import V_ASSIGN, assignments, r6, register, tokens
from doctopics.operators import terms
from doctopics.plans.term_queries import FULL
from doctopics.constants import CLUSTER_METRICS, LABEL_NAMES

VALID = "valid AS (SELECT * FROM v_assign WHERE topic <> -1 AND label0 <> -1)"
COUNTS = f"""{VALID}, counts AS (SELECT model, label0 AS label, topic, count(*) AS n FROM valid GROUP BY ALL)"""
# Best permutation by brute force: every topic (or none) for each of the four labels.
ALIGN = f"""{COUNTS}, models AS (SELECT DISTINCT model FROM counts),
  opts AS (SELECT DISTINCT model, topic FROM counts),
  score AS (
    SELECT a.model, a.topic AS t0, b.topic AS t1, c.topic AS t2, d.topic AS t3,
      (SELECT coalesce(sum(n), 0) FROM counts x WHERE x.model = a.model AND (
          (label = 0 AND x.topic = a.topic) OR (label = 1 AND x.topic = b.topic)
          OR (label = 2 AND x.topic = c.topic) OR (label = 3 AND x.topic = d.topic))) AS matched
    FROM opts a JOIN opts b ON a.model = b.model AND b.topic <> a.topic
      JOIN opts c ON c.model = a.model AND c.topic NOT IN (a.topic, b.topic)
      JOIN opts d ON d.model = a.model AND d.topic NOT IN (a.topic, b.topic, c.topic)),
  best AS (SELECT model, arg_max([t0, t1, t2, t3], matched) AS ts, max(matched) AS matched FROM score GROUP BY model),
  alignment AS (SELECT model, CAST(i - 1 AS INT) AS label, ts[i] AS topic, matched FROM best, range(1, 5) r(i))"""
PRED = f"""{ALIGN}, pred AS (SELECT v.model, doc_id, label0 AS label, coalesce(a.label, 0) AS pred
    FROM valid v LEFT JOIN alignment a ON a.model = v.model AND a.topic = v.topic)"""
BY = ["model"]


def _counts(spark, sf_dir):
    return ev.contingency(ev.drop_unassigned(assignments(spark, sf_dir)), by=BY)


@register("drop_unassigned", f"WITH {V_ASSIGN}, {VALID} SELECT model, doc_id, label0, topic FROM valid")
def drop_unassigned(spark, sf_dir):
    return ev.drop_unassigned(assignments(spark, sf_dir)).select("model", "doc_id", "label0", "topic")


@register("contingency", f"WITH {V_ASSIGN}, {COUNTS} SELECT model, label, topic, n FROM counts")
def contingency(spark, sf_dir):
    return _counts(spark, sf_dir)


@register(
    "align_topics",
    f"""WITH {V_ASSIGN}, {ALIGN} SELECT model, topic, label, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM alignment LEFT JOIN counts USING (model, label, topic)""",
)
def align_topics(spark, sf_dir):
    return ev.align_topics(_counts(spark, sf_dir), BY)


@register(
    "aligned_accuracy",
    f"""WITH {V_ASSIGN}, {ALIGN}, totals AS (SELECT model, sum(n) AS total FROM counts GROUP BY model)
    SELECT model, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total,
        round(matched / CAST(total AS DOUBLE), 6) AS aligned_accuracy FROM best JOIN totals USING (model)""",
)
def aligned_accuracy(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    out = ev.aligned_accuracy(counts, ev.align_topics(counts, BY), BY)
    return out.select("model", "matched", "total", r6("Aligned_Accuracy", "aligned_accuracy"))


NAMES0 = {k - 1: v for k, v in LABEL_NAMES.items()}


@register(
    "alignment_table",
    f"""WITH {V_ASSIGN}, {ALIGN}, names(label, label_name) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in NAMES0.items())})
    SELECT model, topic, label_name, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM alignment LEFT JOIN counts USING (model, label, topic) JOIN names USING (label)""",
)
def alignment_table(spark, sf_dir):
    aligned = ev.align_topics(_counts(spark, sf_dir), BY)
    return ev.alignment_table(aligned, NAMES0).select("model", "topic", "label_name", "n")


@register("aligned_predictions", f"WITH {V_ASSIGN}, {PRED} SELECT model, doc_id, label, CAST(pred AS INT) AS pred FROM pred")
def aligned_predictions(spark, sf_dir):
    valid = ev.drop_unassigned(assignments(spark, sf_dir))
    out = ev.aligned_predictions(valid, ev.align_topics(ev.contingency(valid, by=BY), BY), by=BY)
    return out.select("model", "doc_id", F.col("label0").alias("label"), "pred")


SCORES = """wide AS (SELECT model, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY model, label) AS DOUBLE) AS a,
      CAST(sum(n) OVER (PARTITION BY model, topic) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) AS t
    FROM counts),
  rows_l AS (SELECT model, label, CAST(sum(n) AS DOUBLE) AS a FROM counts GROUP BY ALL),
  rows_t AS (SELECT model, topic, CAST(sum(n) AS DOUBLE) AS b FROM counts GROUP BY ALL),
  parts AS (
    SELECT w.model, max(t) AS t, sum(n * (n - 1) / 2) AS same, sum(n / t * ln(n * t / (a * b))) AS mi,
      (SELECT sum(a * (a - 1) / 2) FROM rows_l l WHERE l.model = w.model) AS pl,
      (SELECT sum(b * (b - 1) / 2) FROM rows_t r WHERE r.model = w.model) AS pt
    FROM wide w GROUP BY w.model),
  ents AS (SELECT p.*, (SELECT -sum(a / p.t * ln(a / p.t)) FROM rows_l l WHERE l.model = p.model) AS hl,
      (SELECT -sum(b / p.t * ln(b / p.t)) FROM rows_t r WHERE r.model = p.model) AS ht FROM parts p),
  hc AS (SELECT *, mi / hl AS h, mi / ht AS c, pl * pt / (t * (t - 1) / 2) AS expected FROM ents),
  scores AS (SELECT model, (same - expected) / ((pl + pt) / 2 - expected) AS ari,
      CASE WHEN h + c = 0 THEN 0 ELSE 2 * h * c / (h + c) END AS v, h, c FROM hc)"""
SCORE_COLUMNS = """round(ari, 6) + 0.0 AS ari, round(v, 6) AS nmi, round(h, 6) AS homogeneity, round(c, 6) AS completeness,
    round(v, 6) AS v_measure"""
SCORE_NAMES = dict(zip(CLUSTER_METRICS, ["ari", "nmi", "homogeneity", "completeness", "v_measure"]))


@register("clustering_scores", f"WITH {V_ASSIGN}, {COUNTS}, {SCORES} SELECT model, {SCORE_COLUMNS} FROM scores")
def clustering_scores(spark, sf_dir):
    out = ev.clustering_scores(_counts(spark, sf_dir), BY)
    return out.select("model", *[r6(f"`{k}`", v) for k, v in SCORE_NAMES.items()])


PER_CLASS = """classes AS (SELECT DISTINCT model, label AS cls FROM pred UNION SELECT DISTINCT model, pred FROM pred),
  per AS (SELECT c.model, c.cls,
      (SELECT count(*) FROM pred p WHERE p.model = c.model AND p.label = c.cls) AS support,
      (SELECT count(*) FROM pred p WHERE p.model = c.model AND p.pred = c.cls) AS guessed,
      (SELECT count(*) FROM pred p WHERE p.model = c.model AND p.pred = c.cls AND p.label = c.cls) AS hits FROM classes c),
  pr AS (SELECT *, CASE WHEN guessed = 0 THEN 0 ELSE hits / CAST(guessed AS DOUBLE) END AS p,
      CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS r FROM per),
  f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


@register(
    "classification_report",
    f"""WITH {V_ASSIGN}, {PRED}, {PER_CLASS}
    SELECT model, CAST(cls AS VARCHAR) AS class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT model, 'accuracy', round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
      round(sum(hits) / CAST(sum(support) AS DOUBLE), 6), round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
      CAST(sum(support) AS BIGINT) FROM f GROUP BY model
    UNION ALL SELECT model, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
      FROM f GROUP BY model
    UNION ALL SELECT model, 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f GROUP BY model""",
)
def classification_report(spark, sf_dir):
    out = ev.classification_report(aligned_predictions(spark, sf_dir), by=BY)
    return out.select("model", "class", *[r6(n, n) for n in ("precision", "recall", "f1")], "support")


@register("accuracy", f"WITH {V_ASSIGN}, {PRED} SELECT model, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred GROUP BY model")
def accuracy(spark, sf_dir):
    return ev.accuracy(aligned_predictions(spark, sf_dir), by=BY).select("model", r6("Accuracy", "accuracy"))


METRICS = f"""{PRED}, {SCORES}, {PER_CLASS}, totals AS (SELECT model, sum(n) AS total FROM counts GROUP BY model),
  f1s AS (SELECT model, avg(f1) AS macro, sum(f1 * support) / sum(support) AS weighted FROM f GROUP BY model),
  metrics AS (SELECT s.*, matched / CAST(total AS DOUBLE) AS acc, macro, weighted
    FROM scores s JOIN best USING (model) JOIN totals USING (model) JOIN f1s USING (model))"""


@register(
    "model_metrics",
    f"""WITH {V_ASSIGN}, {METRICS} SELECT model, {SCORE_COLUMNS}, round(acc, 6) AS aligned_accuracy,
        round(macro, 6) AS macro_f1, round(weighted, 6) AS weighted_f1 FROM metrics""",
)
def model_metrics(spark, sf_dir):
    out = ev.model_metrics(assignments(spark, sf_dir))
    names = {**SCORE_NAMES, "Aligned_Accuracy": "aligned_accuracy", "Macro_F1": "macro_f1", "Weighted_F1": "weighted_f1"}
    return out.select("model", *[r6(f"`{k}`", v) for k, v in names.items()])


TOPIC_WORDS = """sums AS (SELECT lang, term, round(sum(weight), 9) AS weight
        FROM cells JOIN documents USING (doc_id) GROUP BY lang, term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM sums),
    topic_words AS (SELECT lang AS topic, CAST(rank AS INT) AS rank, term FROM ranked WHERE rank <= 10)"""


def topic_words(spark, sf_dir, n=10):
    """Top terms per language as fixed topics."""
    df = tokens(spark, sf_dir)
    return terms.top_terms_per_class(df, terms.fit_vectorizer(df), "lang", n).withColumnRenamed("lang", "topic")


@register(
    "topic_diversity",
    f"{FULL}, {TOPIC_WORDS} SELECT round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS diversity FROM topic_words",
)
def topic_diversity(spark, sf_dir):
    return ev.topic_diversity(topic_words(spark, sf_dir)).select(r6("Diversity", "diversity"))


@register(
    "rating_bands",
    f"""WITH {V_ASSIGN}, {ALIGN}, totals AS (SELECT model, sum(n) AS total FROM counts GROUP BY model),
    acc AS (SELECT model, matched / CAST(total AS DOUBLE) AS a FROM best JOIN totals USING (model))
    SELECT model, CASE WHEN a > 0.8 THEN 'very good' WHEN a > 0.7 THEN 'good' WHEN a > 0.6 THEN 'ok' ELSE 'not so good' END AS rating,
      CASE WHEN a > 0.75 THEN 'very successful' WHEN a > 0.6 THEN 'successful' ELSE 'partly successful' END AS success
    FROM acc""",
)
def rating_bands(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    score = F.col("Aligned_Accuracy")
    out = ev.aligned_accuracy(counts, ev.align_topics(counts, BY), BY)
    return out.select("model", ev.rating_band(score).alias("rating"), ev.rating_band(score, "success").alias("success"))
