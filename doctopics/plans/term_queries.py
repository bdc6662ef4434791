"""Term statistics and document vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import terms
from doctopics.plans.base import (
    SPLIT_CTE,
    WORDS_CTE,
    documents,
    r6,
    register,
    split_tokens,
    tfidf_cte,
    tokens,
    vocab_cte,
)
from doctopics.sources.selection import samples_per_label

N_DOCS = "(SELECT count(*) FROM documents)"
TRAIN_CTE = f"{WORDS_CTE}, {SPLIT_CTE}, train_words AS (SELECT w.* FROM words w JOIN splits USING (doc_id) WHERE split = 'train')"
N_TRAIN = "(SELECT count(*) FROM splits WHERE split = 'train')"
FULL = f"WITH {WORDS_CTE}, {vocab_cte()}, {tfidf_cte()}"
FITTED = f"WITH {TRAIN_CTE}, {vocab_cte(source='train_words')}, {tfidf_cte(N_TRAIN)}"


@register("term_frequency", f"WITH {WORDS_CTE} SELECT term, count(*) AS tf FROM words GROUP BY term")
def term_frequency(spark, sf_dir):
    return terms.term_frequency(tokens(spark, sf_dir))


@register("document_frequency", f"WITH {WORDS_CTE} SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term")
def document_frequency(spark, sf_dir):
    return terms.document_frequency(tokens(spark, sf_dir))


@register("vocab_top_n", f"WITH {WORDS_CTE}, {vocab_cte()} SELECT term_id, term, tf, df FROM vocab")
def vocab_top_n(spark, sf_dir):
    return terms.vocab_top_n(terms.term_stats(tokens(spark, sf_dir)), 5000)


DICTIONARY = f"""kept AS (SELECT * FROM stats WHERE df >= 5 AND df <= 0.8 * {N_DOCS} ORDER BY df DESC, term LIMIT 5000)"""


@register(
    "dictionary_filter",
    f"""WITH {WORDS_CTE}, {vocab_cte()}, {DICTIONARY}
    SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_id, term, tf, df FROM kept""",
)
def dictionary_filter(spark, sf_dir):
    n_docs = documents(spark, sf_dir).count()
    return terms.dictionary_filter(terms.term_stats(tokens(spark, sf_dir)), n_docs)


@register(
    "bag_of_words",
    f"""WITH {WORDS_CTE}, {vocab_cte()}, {DICTIONARY},
    dict AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS term_id, term FROM kept)
    SELECT doc_id, term_id, count(*) AS cnt FROM words JOIN dict USING (term) GROUP BY doc_id, term_id""",
)
def bag_of_words(spark, sf_dir):
    df = tokens(spark, sf_dir)
    n_docs = documents(spark, sf_dir).count()
    fitted = terms.vectorizer_from(terms.dictionary_filter(terms.term_stats(df), n_docs), n_docs)
    return terms.bag_of_words(df, fitted)


@register(
    "count_vectorize",
    f"""WITH {TRAIN_CTE}, {vocab_cte(source='train_words')}
    SELECT split, doc_id, term_id, count(*) AS cnt FROM words JOIN splits USING (doc_id) JOIN vocab USING (term)
    GROUP BY split, doc_id, term_id""",
)
def count_vectorize(spark, sf_dir):
    _, vectors = terms.vectorize_many(split_tokens(spark, sf_dir), weighting="counts")
    cells = terms.long_form(vectors, keep=["split"])
    return cells.select("split", "doc_id", "term_id", F.col("weight").cast("long").alias("cnt"))


@register("tfidf", f"{FULL} SELECT doc_id, term_id, round(weight, 6) AS weight FROM cells")
def tfidf(spark, sf_dir):
    df = tokens(spark, sf_dir)
    cells = terms.tfidf(df, terms.fit_vectorizer(df))
    return cells.select("doc_id", "term_id", r6("weight", "weight"))


@register(
    "vectorize_many",
    f"""{FITTED} SELECT split, count(*) AS n_cells, count(DISTINCT doc_id) AS n_docs, round(sum(weight), 6) AS total,
        round(sum(weight * term_id), 6) AS weighted FROM cells JOIN splits USING (doc_id) GROUP BY split""",
)
def vectorize_many(spark, sf_dir):
    _, vectors = terms.vectorize_many(split_tokens(spark, sf_dir))
    cells = terms.long_form(vectors, keep=["split"])
    per_doc = cells.groupBy("split", "doc_id").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("term_id")).alias("x")
    )
    return per_doc.groupBy("split").agg(
        F.sum("n").alias("n_cells"), F.count("*").alias("n_docs"), r6(F.sum("w"), "total"), r6(F.sum("x"), "weighted")
    )


TOP_DOC = """top_doc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank,
    term, weight FROM cells)"""


@register(
    "top_terms_per_doc",
    f"{FULL}, {TOP_DOC} SELECT doc_id, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM top_doc WHERE rank <= 10",
)
def top_terms_per_doc(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    top = terms.top_terms_per_doc(fitted.tfidf(df), fitted, 10)
    return top.select("doc_id", "rank", "term", r6("weight", "weight"))


@register(
    "top_terms_per_label_sample",
    f"""{FULL}, {TOP_DOC}, first AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang)
    SELECT lang, doc_id, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight
    FROM first JOIN top_doc USING (doc_id) WHERE rank <= 5""",
)
def top_terms_per_label_sample(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    first = samples_per_label(df, "lang", columns=["tokens"])
    top = terms.top_terms_per_doc(fitted.tfidf(first), fitted, 5)
    return first.select("lang", "doc_id").join(top, "doc_id").select("lang", "doc_id", "rank", "term", r6("weight", "weight"))


@register(
    "matrix_stats",
    f"""{FULL}, c AS (SELECT count(*) AS nnz FROM cells)
    SELECT {N_DOCS} AS n_rows, (SELECT count(*) FROM vocab) AS n_cols, nnz,
        round((1 - nnz / CAST({N_DOCS} * (SELECT count(*) FROM vocab) AS DOUBLE)) * 100, 6) AS sparsity_pct, round(nnz / CAST({N_DOCS} AS DOUBLE), 6) AS mean_nnz
    FROM c""",
)
def matrix_stats(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    out = terms.matrix_stats(fitted.tfidf(df), fitted.size)
    return out.select("n_rows", "n_cols", "nnz", r6("sparsity_pct", "sparsity_pct"), r6("mean_nnz", "mean_nnz"))


@register(
    "term_weight_extremes",
    f"""{FULL}, totals AS (SELECT term, round(sum(weight), 9) AS total FROM cells GROUP BY term),
    r AS (SELECT *, row_number() OVER (ORDER BY total DESC, term) AS hi, row_number() OVER (ORDER BY total, term) AS lo
          FROM totals WHERE total > 0)
    SELECT 'largest' AS kind, CAST(hi AS INT) AS rank, term, round(total, 6) AS total FROM r WHERE hi <= 10
    UNION ALL SELECT 'smallest', CAST(lo AS INT), term, round(total, 6) FROM r WHERE lo <= 10""",
)
def term_weight_extremes(spark, sf_dir):
    df = tokens(spark, sf_dir)
    fitted = terms.fit_vectorizer(df)
    out = terms.term_weight_extremes(terms.tfidf(df, fitted), fitted)
    return out.select("kind", "rank", "term", r6("total", "total"))


@register(
    "corpus_stats",
    f"""WITH {TRAIN_CTE}, {vocab_cte(source='train_words')},
    kept AS (SELECT * FROM stats WHERE df >= 5 AND df <= 0.8 * {N_TRAIN} ORDER BY df DESC, term LIMIT 5000)
    SELECT {N_TRAIN} AS n_train, (SELECT count(*) FROM splits WHERE split = 'test') AS n_test,
        (SELECT count(*) FROM stats) AS vocab_before, (SELECT count(*) FROM kept) AS vocab_after,
        round((SELECT sum(df) FROM kept) / CAST({N_TRAIN} AS DOUBLE), 6) AS mean_distinct_terms""",
)
def corpus_stats(spark, sf_dir):
    out = terms.corpus_stats(split_tokens(spark, sf_dir))
    return out.select("n_train", "n_test", "vocab_before", "vocab_after", r6("mean_distinct_terms", "mean_distinct_terms"))


@register(
    "top_terms_by_df",
    f"WITH {WORDS_CTE}, {vocab_cte()} SELECT term, df FROM stats ORDER BY df DESC, term LIMIT 10",
)
def top_terms_by_df(spark, sf_dir):
    return terms.top_terms_by_df(terms.document_frequency(tokens(spark, sf_dir)))


@register(
    "vocab_sample",
    f"""WITH {WORDS_CTE}, {vocab_cte()} SELECT term_id, term FROM vocab
    WHERE term_id < 20 OR term_id BETWEEN 1000 AND 1019 OR term_id >= (SELECT count(*) FROM vocab) - 20""",
)
def vocab_sample(spark, sf_dir):
    fitted = terms.fit_vectorizer(tokens(spark, sf_dir))
    return terms.vocab_sample(fitted.vocabulary(spark), fitted.size)


@register(
    "class_word_frequencies",
    f"""WITH {WORDS_CTE}, {SPLIT_CTE}, c AS (SELECT split, w.lang AS labels, term, count(*) AS n
        FROM words w JOIN splits USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY split, labels ORDER BY n DESC, term) AS rank FROM c)
    SELECT split, labels, term, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2500""",
)
def class_word_frequencies(spark, sf_dir):
    df = split_tokens(spark, sf_dir).withColumnRenamed("lang", "labels")
    return terms.class_word_frequencies(df).select("split", "labels", "term", "n", "rank")


FLAGSHIP_SQL = f"""{FULL}, sums AS (SELECT lang, term, round(sum(weight), 9) AS weight
        FROM cells JOIN documents USING (doc_id) GROUP BY lang, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM sums)
    SELECT lang, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10"""


@register("top_terms_per_class", FLAGSHIP_SQL)
def top_terms_per_class(spark, sf_dir):
    """Flagship: which ten terms characterise each class?"""
    df = tokens(spark, sf_dir)
    top = terms.top_terms_per_class(df, terms.fit_vectorizer(df), "lang", 10)
    return top.select("lang", "rank", "term", r6("weight", "weight"))
