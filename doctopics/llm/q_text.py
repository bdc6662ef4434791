"""Thin queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.llm import licenses
from doctopics.llm.base import register, table
from doctopics.llm.bpe import encode_documents
from doctopics.llm.collocations import collocations
from doctopics.llm.decontaminate import contamination
from doctopics.llm.langid import identify_languages
from doctopics.llm.minhash_dedup import near_duplicate_classes
from doctopics.llm.packing import pack_documents
from doctopics.llm.ppm import score_held_out
from doctopics.llm.quality import quality_rules, trusted_documents
from doctopics.llm.resample import importance_resample
from doctopics.llm.sharding import stratified_shards
from doctopics.llm.substring_dedup import dedup_substrings


@register("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    """No SQL: windows of all documents are too slow in plain SQL; checked against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op2_minhash_dedup")
def op2_minhash_dedup(spark, sf_dir):
    """No SQL: set similarity of all documents is too slow in plain SQL; checked against brute force."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary the packing query uses; another file is a parameter of ``pack_documents``."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    """No SQL: tokenising and packing; checked piece by piece against the tokenizer and by an exact round trip."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    """No SQL: a trained byte model; checked against a plain coder, the base against plain counting."""
    return score_held_out(table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    """No SQL: trained classifiers; checked by accuracy on the documents they were not trained on."""
    return identify_languages(table(spark, sf_dir, "documents"))


@register("op6_sharding")
def op6_sharding(spark, sf_dir):
    """No SQL: DuckDB has no crc32; checked against plain sorting."""
    return stratified_shards(table(spark, sf_dir, "documents"))


@register("op7_license_scan", licenses.ORACLE)
def op7_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@register("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    """No SQL: DuckDB has other hashes; the base is checked by SQL in the tests, the ratio against brute force."""
    labels = table(spark, sf_dir, "labels")
    rules = quality_rules(table(spark, sf_dir, "documents"), trusted_documents(labels), toxic=labels)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rules.select("doc_id", *counts, "base_failed", "kept", "n_grams", F.round("llr", 9).alias("llr"))


OP3_SQL = r"""WITH
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  g AS (SELECT DISTINCT item_id, len, w[k : k + len - 1] AS gram
        FROM (SELECT item_id, w, len, unnest(range(1, len(w) - len + 2)) AS k FROM (SELECT *, least(10, len(w)) AS len FROM i WHERE len(w) > 0))),
  s AS (SELECT DISTINCT len FROM g),
  o AS (SELECT doc_id, k, len, w[k : k + len - 1] AS gram
        FROM (SELECT doc_id, w, s.len, unnest(range(1, len(w) - s.len + 2)) AS k FROM d, s WHERE len(w) >= s.len)),
  m AS (SELECT o.doc_id, o.k, o.len, g.item_id FROM o JOIN g USING (len, gram)),
  h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + len)) AS p FROM m) GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM m GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@register("op3_decontamination", OP3_SQL)
def op3_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_tokenizer_path() -> str:
    """The vocabulary the encoding query uses; another file is a parameter of ``encode_documents``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op11_bpe_round_trip")
def op11_bpe_round_trip(spark, sf_dir):
    """No SQL: a tokenizer; checked text by text against the tokenizers library and by an exact round trip."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = encode_documents(docs, byte_tokenizer_path(), out=None, decoded="decoded", drop_text=True, listed="listed")
    commas = F.length("listed") - F.length(F.replace("listed", F.lit(",")))
    return coded.select(
        "doc_id",
        F.when(F.col("listed") == "", 0).otherwise(commas + 1).cast("long").alias("n_tokens"),
        F.sha2("listed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP12_SQL = r"""WITH RECURSIVE
  p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS i,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
      FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
  g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, w[s : s + k - 1] AS parts
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, phrase, any_value(parts) AS parts, count(*) AS a FROM g GROUP BY ALL),
  t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY ALL),
  c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND a >= 10),
  s AS (SELECT c.lang, c.k, c.phrase, c.parts, c.a, cut, x.a AS l, y.a AS r,
      CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1 : cut], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[cut + 1 : c.k], ' ')),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  o AS (SELECT lang, array_to_string(parts[q : q + 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest([1, 2]) AS q FROM b WHERE k = 3) GROUP BY ALL),
  d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE b.k = 3 OR o.longer IS NULL OR 100 * o.longer < 50 * b.a)
  SELECT lang, rank, phrase, a, l, r, n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) JOIN t USING (lang)
  WHERE rank <= 2000"""


@register("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@register("op13_importance_resampling")
def op13_importance_resampling(spark, sf_dir):
    """No SQL: DuckDB has no crc32; checked against brute force."""
    rows = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
