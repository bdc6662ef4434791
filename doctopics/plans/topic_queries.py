"""Describing topics, and coherence, over fixed topics (the language of a document)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import coherence, describe
from doctopics.plans.base import (
    STOP_SQL,
    V_ASSIGN,
    WORD_RE,
    WORDS_CTE,
    assignments,
    documents,
    merge_cte,
    r6,
    register,
    tokens,
)
from doctopics.plans.evaluation_queries import TOPIC_WORDS, topic_words
from doctopics.plans.term_queries import FULL

CTF = f"""{WORDS_CTE}, counts AS (SELECT lang AS topic, term, count(*) AS n FROM words GROUP BY ALL),
  sizes AS (SELECT topic, sum(n) AS size FROM counts GROUP BY topic),
  ctf AS (SELECT topic, term, n / CAST(size AS DOUBLE) *
        ln(1 + floor((SELECT avg(size) FROM sizes)) / sum(n) OVER (PARTITION BY term)) AS weight
    FROM counts JOIN sizes USING (topic))"""


def _topics(spark, sf_dir):
    return tokens(spark, sf_dir).withColumnRenamed("lang", "topic")


@register("class_tfidf", f"WITH {CTF} SELECT topic, term, round(weight, 6) AS weight FROM ctf")
def class_tfidf(spark, sf_dir):
    return describe.class_tfidf(_topics(spark, sf_dir)).select("topic", "term", r6("weight", "weight"))


# Topic numbers for ranking, with French as the outlier topic.
TOPIC_ID = "CASE topic WHEN 'fr' THEN -1 WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END"


@register(
    "topic_words_scored",
    f"""WITH {CTF}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM ctf)
    SELECT {TOPIC_ID} AS topic, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 20""",
)
def topic_words_scored(spark, sf_dir):
    weights = describe.class_tfidf(_topics(spark, sf_dir)).withColumn("topic", F.expr(TOPIC_ID))
    return describe.topic_words_scored(weights, 20).select("topic", "rank", "term", r6("weight", "weight"))


@register(
    "topic_info",
    f"""WITH {V_ASSIGN}, s AS (SELECT topic, count(*) AS size FROM v_assign WHERE model = 'm2' GROUP BY topic)
    SELECT CAST(topic AS INT) AS topic, size, CAST(CASE WHEN topic <> -1 THEN
        row_number() OVER (PARTITION BY topic <> -1 ORDER BY size DESC, topic) END AS INT) AS rank FROM s""",
)
def topic_info(spark, sf_dir):
    return describe.topic_info(assignments(spark, sf_dir).filter("model = 'm2'"))


SOURCE_ID = "CAST(substr(source, 4) AS INT)"


def _by_source(spark, sf_dir):
    """Documents with their source number as topic."""
    docs = documents(spark, sf_dir).select("doc_id", F.expr(SOURCE_ID).alias("topic"))
    return tokens(spark, sf_dir).join(docs, "doc_id")


@register(
    "reduce_topics",
    f"""WITH RECURSIVE {WORDS_CTE}, sourced AS (SELECT doc_id, {SOURCE_ID} AS topic FROM documents),
    counts AS (SELECT topic, term, count(*) AS n FROM words JOIN sourced USING (doc_id) GROUP BY ALL),
    sizes AS (SELECT topic, sum(n) AS size FROM counts GROUP BY topic),
    ctf AS (SELECT topic, term, n / CAST(size AS DOUBLE) *
        ln(1 + floor((SELECT avg(size) FROM sizes)) / sum(n) OVER (PARTITION BY term)) AS weight FROM counts JOIN sizes USING (topic)),
    gsize AS (SELECT topic, count(*) AS size FROM sourced GROUP BY topic),
    gcell AS (SELECT a.topic AS i, b.topic AS j, sum(a.weight * b.weight) AS x FROM ctf a JOIN ctf b USING (term) GROUP BY ALL),
    {merge_cte(5)} SELECT topic, reduced_topic FROM grouped""",
)
def reduce_topics(spark, sf_dir):
    df = _by_source(spark, sf_dir)
    return describe.reduce_topics(describe.class_tfidf(df), describe.topic_info(df), 5)


@register(
    "representative_docs",
    f"""WITH {V_ASSIGN}, f AS (SELECT model, topic, min(doc_id) AS doc_id FROM v_assign WHERE model = 'm2' GROUP BY ALL)
    SELECT CAST(topic AS INT) AS topic, doc_id, md5(substr(text, 1, 200)) AS excerpt_md5 FROM f JOIN documents USING (doc_id)""",
)
def representative_docs(spark, sf_dir):
    assigned = assignments(spark, sf_dir).filter("model = 'm2'").select("doc_id", "topic")
    df = assigned.join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return describe.representative_docs(df).select("topic", "doc_id", F.md5("excerpt").alias("excerpt_md5"))


# The texts are invented words, so a few of them stand in for the news keywords of the rules.
STAND_INS = {"that": "game", "the": "stock", "die": "market", "les": "comput", "de": "presid"}
STAND_IN_SQL = "CASE term " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAND_INS.items()) + " ELSE term END"
RULE_WORDS = f"""{FULL.replace(f"WHERE term NOT IN ({STOP_SQL})", "")}, {TOPIC_WORDS},
    w AS (SELECT topic, list({STAND_IN_SQL} ORDER BY rank) AS ws FROM topic_words GROUP BY topic)"""


def _rule_words(spark, sf_dir):
    from doctopics.functions.tokens import word_tokens
    from doctopics.operators import terms
    from doctopics.runtime import spread

    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    df = docs.select("doc_id", F.col("lang").alias("topic"), word_tokens(F.col("text"), ()).alias("tokens"))
    top = terms.top_terms_per_class(df, terms.fit_vectorizer(df), "topic", 10)
    return top.withColumn("term", F.expr(STAND_IN_SQL))


@register(
    "topic_label_rules",
    f"""{RULE_WORDS} SELECT topic, array_to_string(ws[1:3], ' + ') AS head,
        CASE WHEN list_has_any(ws[1:5], ['game', 'team', 'season', 'win']) THEN 'SPORTS'
             WHEN list_has_any(ws[1:5], ['compani', 'stock', 'market', 'business']) THEN 'BUSINESS'
             WHEN list_has_any(ws[1:5], ['microsoft', 'softwar', 'comput', 'internet']) THEN 'SCIENCE/TECH'
             WHEN list_has_any(ws[1:5], ['said', 'presid', 'minist', 'countri']) THEN 'WORLD' ELSE 'MIXED' END AS guess
    FROM w""",
)
def topic_label_rules(spark, sf_dir):
    return describe.topic_label_rules(_rule_words(spark, sf_dir))


@register(
    "clear_topic_share",
    f"""{RULE_WORDS}, c AS (SELECT count(*) FILTER (list_has_any(ws[1:3], ['game', 'team', 'season'])
            OR list_has_any(ws[1:3], ['compani', 'stock', 'market'])
            OR list_has_any(ws[1:3], ['presid', 'minist', 'govern'])) AS clear_topics, count(*) AS topics FROM w)
    SELECT clear_topics, topics, clear_topics >= topics * 0.7 AS coherent FROM c""",
)
def clear_topic_share(spark, sf_dir):
    return describe.clear_topic_share(_rule_words(spark, sf_dir))


# Windows by brute force: every start of every window, every relevant word in it.
COHERENCE_SQL = f"""{FULL}, {TOPIC_WORDS},
  lists AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD_RE}'), lambda w: w NOT IN ({STOP_SQL})) AS ts FROM documents),
  toks AS (SELECT doc_id, greatest(len(ts) - 109, 1) AS s, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM lists),
  total AS (SELECT CAST(sum(greatest(len(ts) - 109, 1)) AS DOUBLE) AS n FROM lists),
  occ AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(pos - 109, 0), least(pos, s - 1) + 1)) AS st
    FROM toks WHERE term IN (SELECT term FROM topic_words)),
  single AS (SELECT term, count(*) / (SELECT n FROM total) AS p FROM occ GROUP BY term),
  pair AS (SELECT a.term AS x, b.term AS y, count(*) / (SELECT n FROM total) AS p
    FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.st = b.st
    WHERE EXISTS (SELECT 1 FROM topic_words t JOIN topic_words u USING (topic) WHERE t.term = a.term AND u.term = b.term)
    GROUP BY ALL),
  pcells AS (SELECT t.topic, t.term AS x, u.term AS y, coalesce(pr.p, 0) AS pxy, px.p AS px, py.p AS py
    FROM topic_words t JOIN topic_words u USING (topic) LEFT JOIN single px ON px.term = t.term
      LEFT JOIN single py ON py.term = u.term LEFT JOIN pair pr ON pr.x = t.term AND pr.y = u.term),
  npmi AS (SELECT topic, x, y, ln((pxy + 1e-12) / (px * py)) / -ln(pxy + 1e-12) AS v FROM pcells),
  psums AS (SELECT topic, y, sum(v) AS s FROM npmi GROUP BY topic, y),
  norms AS (SELECT topic, sqrt(sum(s * s)) AS ns FROM psums GROUP BY topic),
  cos AS (SELECT topic, x, sum(v * s) / (sqrt(sum(v * v)) * any_value(ns)) AS c
    FROM npmi JOIN psums USING (topic, y) JOIN norms USING (topic) GROUP BY topic, x)"""


@register(
    "coherence_cv",
    COHERENCE_SQL
    + " SELECT topic, round(avg(c), 6) AS coherence FROM cos GROUP BY topic",
)
def coherence_cv(spark, sf_dir):
    words = topic_words(spark, sf_dir)
    return coherence.coherence_cv(tokens(spark, sf_dir), words).select("topic", r6("coherence", "coherence"))
