"""Registry, input tables and the SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctopics.constants import ENGLISH_STOP_WORDS
from doctopics.functions.tokens import word_tokens
from doctopics.runtime import spread
from doctopics.sources.selection import stratified_split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---------------------------------------------------------------- derived news articles
# The driver's documents have no titles and no datelines; these expressions add both. They run
# unchanged in Spark and DuckDB.

ARTICLE_COLUMNS = {
    "labels": "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 END",
    "title": """concat(substr(text, 1, 40),
        CASE doc_id % 3 WHEN 0 THEN ' (Reuters)' WHEN 1 THEN '  (AP)' ELSE '' END)""",
    "description": """concat(CASE doc_id % 10
          WHEN 0 THEN 'NEW YORK (Reuters) - '      WHEN 1 THEN 'SAN FRANCISCO, Calif. (AP) -- '
          WHEN 2 THEN 'SPACE.com - '               WHEN 3 THEN 'WASHINGTON, AFP - '
          WHEN 4 THEN 'LOS ANGELES Reuters - '     WHEN 5 THEN 'BAGHDAD Reuters -- '
          WHEN 6 THEN 'Reuters - '                 WHEN 7 THEN 'Iraq AP - '
          WHEN 8 THEN 'A--B -- '                   ELSE '' END,
        text,
        CASE doc_id % 4 WHEN 0 THEN ' costs #36;5 on Monday' WHEN 1 THEN ' &lt;b&gt;x&lt;/b&gt; &amp;amp; y'
                        WHEN 2 THEN ' FullQuote quot;z quota a%20b' ELSE ' see www.site.com or a@b.org' END)""",
}
V_ARTICLES = "v_articles AS (SELECT doc_id, {} FROM documents)".format(
    ", ".join(f"{sql} AS {name}" for name, sql in ARTICLE_COLUMNS.items())
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{sql} AS {name}" for name, sql in ARTICLE_COLUMNS.items()]
    return documents(spark, sf_dir).selectExpr("doc_id", *columns)


# Three fixed topic assignments over the same documents: good, relabelled with outliers, unrelated.
ASSIGN_BRANCHES = [
    ("m1", 1, "CASE WHEN doc_id % 7 < 5 THEN labels - 1 ELSE (labels % 4) END"),
    ("m2", 2, "CASE WHEN doc_id % 5 = 0 THEN -1 ELSE (labels + 1) % 4 END"),
    ("m3", 3, "CAST(doc_id % 4 AS INT)"),
]
V_ASSIGN = (
    V_ARTICLES
    + ", v_assign AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, labels - 1 AS label0, '{m}' AS model, {o} AS model_order, {sql} AS topic FROM v_articles"
        for m, o, sql in ASSIGN_BRANCHES
    )
    + ")"
)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three assignments from one scan of the documents."""
    labelled = articles(spark, sf_dir).select("doc_id", "labels")
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(o).alias("model_order"), F.expr(sql).cast("int").alias("topic"))
            for m, o, sql in ASSIGN_BRANCHES
        ]
    )
    return labelled.select("doc_id", (F.col("labels") - 1).alias("label0"), F.inline(models))


# ---------------------------------------------------------------- tokens and splits

WORD_RE = r"[\p{L}\p{N}_]{2,}"
STOP_SQL = sql_list(ENGLISH_STOP_WORDS)

# words: one row per kept token
WORDS_CTE = f"""words AS (
    SELECT * FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS term FROM documents)
    WHERE term NOT IN ({STOP_SQL}))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, tokens)`` of all documents."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", word_tokens(F.col("text")).alias("tokens"))


SPLIT_CTE = """splits AS (
    SELECT doc_id, lang,
           CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42-', CAST(doc_id AS VARCHAR))), doc_id)
                     <= round(CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE) * 0.8) THEN 'train' ELSE 'test' END AS split
    FROM documents)"""


def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(tokens(spark, sf_dir), "lang")


# stats: term counts; vocab: the 5000 most frequent terms
def vocab_cte(n: int = 5000, source: str = "words") -> str:
    return f"""stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {source} GROUP BY term),
    vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_id, term, tf, df
              FROM (SELECT * FROM stats ORDER BY tf DESC, term LIMIT {n}))"""


def tfidf_cte(n_docs: str = "(SELECT count(*) FROM documents)", source: str = "words") -> str:
    """cells: normalised TF-IDF weights over ``vocab``."""
    return f"""raw AS (
        SELECT w.doc_id, v.term_id, v.term, count(*) * (ln((1.0 + {n_docs}) / (1.0 + any_value(v.df))) + 1) AS w
        FROM {source} w JOIN vocab v USING (term) GROUP BY w.doc_id, v.term_id, v.term),
    cells AS (SELECT doc_id, term_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def merge_cte(target: int) -> str:
    """grouped (topic, reduced_topic): the smallest topic merged into its most similar one until ``target`` are left.

    Over ``gsize (topic, size)`` and ``gcell (i, j, x)``, the inner products of the topic vectors. A step of the recursion is one
    merge; the groups are a list of weight, coefficients over the topics and members. Ties go to the lower position.
    """
    return f"""numbered AS (SELECT topic, size, row_number() OVER (ORDER BY topic) AS p FROM gsize),
    gram AS (SELECT list(line ORDER BY p) AS m FROM (SELECT a.p, list(x ORDER BY b.p) AS line
        FROM gcell JOIN numbered a ON a.topic = i JOIN numbered b ON b.topic = j GROUP BY a.p)),
    merges AS (
      SELECT list({{'w': CAST(size AS DOUBLE), 'm': [topic],
          'c': list_transform(range(1, (SELECT count(*) FROM numbered) + 1), lambda q: CASE WHEN q = p THEN 1 / sqrt(m[p][p]) ELSE 0.0 END)}} ORDER BY p) AS g
      FROM numbered, gram
      UNION ALL
      SELECT list_filter(list_transform(g, lambda x, i: CASE WHEN i = s THEN NULL WHEN i = near THEN
            {{'w': x.w + g[s].w, 'm': list_concat(x.m, g[s].m), 'c': list_transform(mc, lambda y: y / len)}} ELSE x END), lambda x: x IS NOT NULL)
      FROM (SELECT *, sqrt(list_dot_product(mc, list_transform(m, lambda line: list_dot_product(line, mc)))) AS len
        FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda q: g[near].w * g[near].c[q] + g[s].w * g[s].c[q]) AS mc
          FROM (SELECT *, list_position(sims, list_max(sims)) AS near
            FROM (SELECT *, list_transform(g, lambda x, i: CASE WHEN i = s THEN -1e300 ELSE list_dot_product(x.c, v) END) AS sims
              FROM (SELECT *, list_transform(m, lambda line: list_dot_product(line, g[s].c)) AS v
                FROM (SELECT g, m, list_position(list_transform(g, lambda x: x.w), list_min(list_transform(g, lambda x: x.w))) AS s
                  FROM merges, gram WHERE len(g) > {target}))))))),
    last AS (SELECT g FROM merges ORDER BY len(g) LIMIT 1),
    ranked AS (SELECT x, row_number() OVER (ORDER BY x.w DESC, x.m[1]) - 1 AS reduced FROM (SELECT unnest(g) AS x FROM last)),
    grouped AS (SELECT unnest(x.m) AS topic, CAST(reduced AS INT) AS reduced_topic FROM ranked)"""


def r6(column, name: str):
    """Rounded double without negative zero, for comparisons across engines."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
