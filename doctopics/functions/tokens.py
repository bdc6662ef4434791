"""Tokenisers. All return ``ARRAY<STRING>`` columns, one row per document, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctopics.constants import ENGLISH_STOP_WORDS
from doctopics.functions.porter import stem
from doctopics.functions.text import WORD, WORD_END, WORD_START, squeeze_ws
from doctopics.runtime import MAX_BROADCAST_ROWS, materialise

# Spoken contractions the word tokeniser splits in two.
CONTRACTIONS = [("can", "not"), ("gon", "na"), ("got", "ta"), ("wan", "na"), ("lem", "me"), ("gim", "me")]


def _without(tokens: Column, stop_words: Iterable[str]) -> Column:
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def word_tokens(c: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased words of two or more word characters, stop words removed."""
    return _without(F.regexp_extract_all(F.lower(c), F.lit(WORD + "{2,}"), F.lit(0)), stop_words)


def whitespace_tokens(c: Column) -> Column:
    """Split at white space, case kept."""
    return F.filter(F.split(squeeze_ws(c), " "), lambda t: t != "")


def preprocess_tokens(c: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower case, letters only (digits split words), stop words and words of one or two letters dropped."""
    text = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", " ")
    text = F.regexp_replace(text, r"\p{Nd}+", " ")
    parts = "|".join(f"{head}(?={tail}{WORD_END})" for head, tail in CONTRACTIONS)
    text = F.regexp_replace(text, f"{WORD_START}({parts})", "$1 ")
    return F.filter(_without(F.split(squeeze_ws(text), " "), stop_words), lambda t: F.length(t) > 2)


def ngrams_1_2(tokens: Column) -> Column:
    """Unigrams followed by the bigrams of neighbouring tokens."""
    pairs = F.zip_with(
        tokens,
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _porter(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda words: [stem(w) for w in words], na_action="ignore")


def stem_tokens(tokens: Column) -> Column:
    """Porter stems of a token array. Map-only: no join on hot words, repeated words are cached per worker."""
    return _porter(tokens)


def map_tokens(
    df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", max_shipped: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Replace tokens by the form the lexicon ``(form, lemma)`` gives; unknown tokens stay.

    A form with several lemmas has the first one in string order; entries with a null do not count. There is one row for
    each row of ``df``, whatever its id, and null tokens give an empty array. A lexicon of up to ``max_shipped`` forms is
    looked up within the row: nothing is shuffled. Of a larger one the forms most used in ``df`` are shipped, and the
    other words are joined by shuffle, so that no frequent word is one key. Both ways give the same rows.
    """
    side = lexicon.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    rows = side.limit(max_shipped + 1).collect()
    if len(rows) <= max_shipped:
        known = df.sparkSession.sparkContext.broadcast(dict(rows))

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def replaced(tokens: pd.Series) -> pd.Series:
            lemma = known.value
            return tokens.map(lambda words: [lemma.get(w, w) for w in words], na_action="ignore")

        return df.select(id_col, F.coalesce(replaced(F.col(tokens_col)), F.array().cast("array<string>")).alias(tokens_col))
    # rows are numbered in a table, so that a repeated task sees the same numbers
    numbered = materialise(df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(tokens_col).alias("_t")), "tokens")
    long = numbered.select("_row", F.posexplode("_t").alias("pos", "form")).filter("form IS NOT NULL")
    used = long.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(max_shipped)
    often = F.broadcast(used.join(side, "form", "left").select("form", F.coalesce("lemma", "form").alias("often")))
    marked = long.join(often, "form", "left")
    rest = marked.filter("often IS NULL").join(side, "form", "left").withColumn("often", F.coalesce("lemma", "form")).drop("lemma")
    word = F.struct("pos", F.col("often").alias("term"))
    found = marked.filter("often IS NOT NULL").unionByName(rest).groupBy("_row").agg(F.array_sort(F.collect_list(word)).alias("_w"))
    out = numbered.select("_row", "_id", "_t").join(found, "_row", "left")
    replaced_at = F.map_from_entries(F.coalesce("_w", F.array().cast("array<struct<pos:int,term:string>>")))
    whole = F.transform("_t", lambda t, i: F.try_element_at(F.col("_m"), i))
    out = out.withColumn("_m", replaced_at)
    return out.select(F.col("_id").alias(id_col), F.coalesce(whole, F.array().cast("array<string>")).alias(tokens_col))


def lemmatise_tokens(df: DataFrame, lexicon: DataFrame, **columns: str) -> DataFrame:
    """Noun lemmas from a user-supplied lexicon table."""
    return map_tokens(df, lexicon, **columns)
