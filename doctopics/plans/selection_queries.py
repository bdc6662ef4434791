"""Sources, sinks, row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.constants import LABEL_NAMES
from doctopics.functions.text import combine_text
from doctopics.plans.base import (
    SPLIT_CTE,
    V_ARTICLES,
    articles,
    documents,
    register,
    table,
)
from doctopics.plans.cleaning_queries import DATELINE_CTES, SQL_FULL_TRANSFORM
from doctopics.runtime import work_path
from doctopics.sources import labelled, selection

NAMES_SQL = ", ".join(f"({k}, '{v}')" for k, v in LABEL_NAMES.items())


def _news_csv(spark, df, name: str) -> str:
    path = work_path(spark, name)
    news = df.select(F.col("labels").alias("Class Index"), F.col("title").alias("Title"), "description")
    labelled.write_csv(news.withColumnRenamed("description", "Description"), path)
    return path


@register(
    "read_labelled_csv",
    f"WITH {V_ARTICLES} SELECT labels, title AS \"Title\", md5(description) AS text_md5 FROM v_articles",
)
def read_labelled_csv(spark, sf_dir):
    path = _news_csv(spark, articles(spark, sf_dir), "news")
    df = labelled.read_labelled_csv(spark, path, encoding="UTF-8")
    return df.select("labels", "Title", F.md5("Description").alias("text_md5"))


@register(
    "read_labelled_union",
    f"""WITH {V_ARTICLES}, {SPLIT_CTE}
    SELECT split, labels, title AS "Title", md5(description) AS text_md5 FROM v_articles JOIN splits USING (doc_id)""",
)
def read_labelled_union(spark, sf_dir):
    split = selection.stratified_split(articles(spark, sf_dir))
    paths = [_news_csv(spark, split.filter(F.col("split") == s), s) for s in ("train", "test")]
    df = labelled.read_labelled_union(spark, *paths, encoding="UTF-8")
    return df.select("split", "labels", "Title", F.md5("Description").alias("text_md5"))


@register("read_second_corpus", "SELECT role AS labels, md5(text) AS text_md5 FROM conversations")
def read_second_corpus(spark, sf_dir):
    path = work_path(spark, "second")
    labelled.write_csv(table(spark, sf_dir, "conversations").selectExpr("role AS labels", "text AS data"), path)
    df = labelled.read_second_corpus(spark, path, "labels string, data string", encoding="UTF-8")
    return df.select("labels", F.md5("data").alias("text_md5"))


CATEGORY_SCHEMA = "category string, headline string, short_description string"


def _category_csv(spark, sf_dir) -> str:
    docs = documents(spark, sf_dir)
    json_path, csv_path = work_path(spark, "category-json"), work_path(spark, "category-csv")
    docs.selectExpr("lang AS category", "source AS headline", "text AS short_description").write.json(json_path)
    labelled.jsonl_to_csv(spark, json_path, csv_path, CATEGORY_SCHEMA)
    return csv_path


@register("jsonl_to_csv", "SELECT lang AS category, source AS headline, md5(text) AS text_md5 FROM documents")
def jsonl_to_csv(spark, sf_dir):
    df = labelled.read_csv(spark, _category_csv(spark, sf_dir), CATEGORY_SCHEMA, "UTF-8")
    return df.select("category", "headline", F.md5("short_description").alias("text_md5"))


@register("read_category_corpus", "SELECT lang AS labels, source AS headline, md5(text) AS text_md5 FROM documents")
def read_category_corpus(spark, sf_dir):
    df = labelled.read_category_corpus(spark, _category_csv(spark, sf_dir), CATEGORY_SCHEMA)
    return df.select("labels", "headline", F.md5("short_description").alias("text_md5"))


_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABEL_NAMES.items())
CLEANED_CTES = DATELINE_CTES.replace(
    V_ARTICLES,
    V_ARTICLES.replace("v_articles AS", "raw_articles AS", 1)
    + f", v_articles AS (SELECT doc_id, CASE labels {_NAMES} END AS labels, title, {SQL_FULL_TRANSFORM} AS description FROM raw_articles)",
    1,
)


@register(
    "cleaned_cache",
    f"""WITH {CLEANED_CTES}, {SPLIT_CTE}
    SELECT doc_id, split, labels, source, location, title, md5(description) AS text_md5
    FROM moved JOIN splits USING (doc_id)""",
)
def cleaned_cache(spark, sf_dir):
    base = work_path(spark, "news")

    def build():
        return selection.stratified_split(labelled.clean_articles(articles(spark, sf_dir)))

    labelled.cleaned_cache(spark, base, build)  # writes
    df = labelled.cleaned_cache(spark, base, build)  # reads
    return df.select("doc_id", "split", "labels", "source", "location", "title", F.md5("description").alias("text_md5"))


@register("label_counts", "SELECT lang AS labels, count(*) AS n_rows FROM documents GROUP BY lang")
def label_counts(spark, sf_dir):
    return selection.label_counts(documents(spark, sf_dir).withColumnRenamed("lang", "labels"))


@register("first_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def first_n(spark, sf_dir):
    return selection.first_n(documents(spark, sf_dir).select("doc_id", "lang", "n_chars"), 500)


@register(
    "label_lookup",
    f"""WITH {V_ARTICLES}, names(id, label_name) AS (VALUES {NAMES_SQL})
    SELECT doc_id, label_name FROM v_articles LEFT JOIN names ON labels = id""",
)
def label_lookup(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", selection.label_lookup(F.col("labels")).alias("label_name"))


LANG_NAME = "CASE lang WHEN 'en' THEN 'World' WHEN 'fr' THEN 'Sports' WHEN 'de' THEN 'Business' ELSE 'Weather' END"


@register(
    "label_reverse_lookup",
    f"""WITH names(id, label_name) AS (VALUES {NAMES_SQL}), d AS (SELECT doc_id, {LANG_NAME} AS label_name FROM documents)
    SELECT doc_id, label_name, id AS labels FROM d LEFT JOIN names USING (label_name)""",
)
def label_reverse_lookup(spark, sf_dir):
    named = documents(spark, sf_dir).selectExpr("doc_id", f"{LANG_NAME} AS label_name")
    return named.withColumn("labels", selection.label_reverse_lookup(F.col("label_name")))


LABEL_TEXT = "CASE WHEN lang = 'es' THEN 'unknown' ELSE substr(source, 4) END"


@register(
    "label_to_zero_based",
    f"""SELECT doc_id, TRY_CAST({LABEL_TEXT} AS INT) - 1 AS label0 FROM documents
    WHERE TRY_CAST({LABEL_TEXT} AS INT) IS NOT NULL""",
)
def label_to_zero_based(spark, sf_dir):
    labelled_docs = documents(spark, sf_dir).selectExpr("doc_id", f"{LABEL_TEXT} AS labels")
    return selection.label_to_zero_based(labelled_docs).select("doc_id", "label0")


@register(
    "label_index",
    "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS label_idx FROM documents",
)
def label_index(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "source")
    return selection.label_index(df, "source").select("doc_id", "source", "label_idx")


@register("stratified_split", f"WITH {SPLIT_CTE} SELECT doc_id, lang, split FROM splits")
def stratified_split(spark, sf_dir):
    return selection.stratified_split(documents(spark, sf_dir).select("doc_id", "lang"), "lang")


@register(
    "kfold",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
    s AS (SELECT *, n // 3 AS q, n % 3 AS m FROM r)
    SELECT doc_id, CAST(CASE WHEN i < m * (q + 1) THEN i // (q + 1) ELSE m + (i - m * (q + 1)) // q END AS INT) AS fold
    FROM s""",
)
def kfold(spark, sf_dir):
    return selection.kfold(documents(spark, sf_dir).select("doc_id"), 3)


@register(
    "combine_text",
    f"WITH {V_ARTICLES} SELECT doc_id, md5(title || ' ' || description) AS combined_md5 FROM v_articles",
)
def combine_text_query(spark, sf_dir):
    combined = combine_text(F.col("title"), F.col("description"))
    return articles(spark, sf_dir).select("doc_id", F.md5(combined).alias("combined_md5"))


@register(
    "samples_per_label",
    """WITH first AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang)
    SELECT d.lang, doc_id, substr(text, 1, 60) AS original,
           trim(regexp_replace(lower(substr(text, 1, 60)), '\\s+', ' ', 'g')) AS cleaned
    FROM first f JOIN documents d USING (doc_id)""",
)
def samples_per_label(spark, sf_dir):
    head = F.substring("text", 1, 60)
    df = documents(spark, sf_dir).select("doc_id", "lang", head.alias("original"))
    df = df.withColumn("cleaned", F.trim(F.regexp_replace(F.lower("original"), r"(?U)\s+", " ")))
    return selection.samples_per_label(df, "lang")
