"""Datelines: split ``NEW YORK (Reuters) - text`` into source, location and text.

All rules are per-row column expressions, so the whole job is one projection over the scan: no join
on the source (a single agency may own a third of all rows) and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctopics.constants import COUNTRIES, TOP_LEVEL_DOMAINS
from doctopics.functions.text import WORD, WORD_END, WORD_START, squeeze_ws, strip_ws

# Search windows of the two separators.
LONG_DASH_WINDOW = 35
SHORT_DASH_WINDOW = 30

_TLD = "|".join(TOP_LEVEL_DOMAINS)

# Rule patterns with the groups that hold source and location, in order of precedence.
# (?d) keeps "." and "$" to the newline rules the patterns were written for, (?U) widens \s.
_F = "(?Ud)"
ANCHORED_RULES = [
    # name, pattern, group of source, group of location
    ("website", rf"{_F}^\s*([A-Za-z]+\.(?:{_TLD}))\s*(.*)$", 1, 2),
    ("abbreviation", rf"{_F}^\s*((?:Calif\.|Flo\.))\s+(.*)$", 2, 1),
    ("dot", rf"{_F}^\s*([\p{{L}}\p{{N}}_-]+\.)(?!\s*(?:{_TLD}){WORD_END})(.*)$", 2, 1),
    ("combo", rf"{_F}^\s*([^\n]+?)\s*\(([^()]+)\)\s*$", 2, 1),
    ("parentheses", rf"{_F}^\s*([A-Z ]+)\s*\(([^)]+)\)", 2, 1),
    ("comma", rf"{_F}^\s*([A-Z ]+),\s*(.+)$", 2, 1),
]
TWO_CAPITALS = rf"{_F}{WORD_START}([A-Z]{{2,}})\s+([A-Z]{{2,}}){WORD_END}"
ONE_CAPITAL = rf"{WORD_START}[A-Z]{{4,}}{WORD_END}"


def extract_source(df: DataFrame, text_col: str = "description", source_col: str = "source") -> DataFrame:
    """Split at the first ``--`` if `` -- `` is near the start, else at the first ``-`` if `` - `` is."""
    c = F.col(text_col)

    def split_at(separator: str) -> Column:
        at = F.instr(c, separator)
        head = strip_ws(F.substring(c, F.lit(1), at - 1))
        tail = strip_ws(F.substring(c, at + len(separator), F.length(c)))
        return F.struct(head.alias("head"), tail.alias("tail"))

    parts = (
        F.when(F.substring(c, 1, LONG_DASH_WINDOW).contains(" -- "), split_at("--"))
        .when(F.substring(c, 1, SHORT_DASH_WINDOW).contains(" - "), split_at("-"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("head"), c.alias("tail")))
    )
    split = df.withColumn("_parts", parts)
    return split.withColumns({source_col: F.col("_parts.head"), text_col: F.col("_parts.tail")}).drop("_parts")


def clean_title_by_source(
    df: DataFrame, title_col: str = "title", source_col: str = "source"
) -> DataFrame:
    """Delete ``(source)`` from the title, for sources that are one word."""
    title, source = F.col(title_col), F.col(source_col)
    marker = F.concat(F.lit("("), F.replace(source, F.lit("\\"), F.lit("")), F.lit(")"))
    one_word = source.isNotNull() & ~source.contains(" ")
    return df.withColumn(title_col, F.when(one_word, squeeze_ws(F.replace(title, marker, F.lit("")))).otherwise(title))


def split_source(c: Column) -> Column:
    """``struct(source, location)`` of the first rule that fits; location null if none does."""

    def pair(source: Column, location: Column) -> Column:
        return F.struct(strip_ws(source).alias("source"), strip_ws(location).alias("location"))

    out = None
    for name, pattern, source_group, location_group in ANCHORED_RULES:
        first, second = (F.regexp_extract(c, pattern, g) for g in (source_group, location_group))
        fits = c.rlike(pattern)
        if name == "website":
            second = F.nullif(second, F.lit(""))
        if name == "combo":
            fits = fits & second.contains(",")
        out = F.when(fits, pair(first, second)) if out is None else out.when(fits, pair(first, second))

    both = F.regexp_extract(c, TWO_CAPITALS, 0)
    words = F.concat(F.regexp_extract(c, TWO_CAPITALS, 1), F.lit(" "), F.regexp_extract(c, TWO_CAPITALS, 2))
    out = out.when(c.rlike(TWO_CAPITALS), pair(F.replace(c, both, F.lit("")), words))

    word = F.regexp_extract(c, ONE_CAPITAL, 0)
    whole_word = F.concat(F.lit(WORD_START), word, F.lit(WORD_END))
    out = out.when(c.rlike(ONE_CAPITAL), pair(F.regexp_replace(c, whole_word, F.lit("")), word))
    return out.otherwise(F.struct(c.alias("source"), F.lit(None).cast("string").alias("location")))


def restructure_source(
    df: DataFrame, source_col: str = "source", location_col: str = "location"
) -> DataFrame:
    """Apply ``split_source``; rows without a found location keep source and location."""
    if location_col not in df.columns:
        df = df.withColumn(location_col, F.lit(None).cast("string"))
    split = df.withColumn("_split", split_source(F.col(source_col)))
    found = F.col("_split.location").isNotNull()
    return split.withColumns(
        {
            source_col: F.when(found, F.col("_split.source")).otherwise(F.col(source_col)),
            location_col: F.coalesce(F.col("_split.location"), F.col(location_col)),
        }
    ).drop("_split")


def _edge(inner: str, look: str) -> str:
    """Word boundary next to a country name; after a bracket it asks for a word character outside."""
    outside = {"start": rf"(?<={WORD})", "end": rf"(?={WORD})"}
    boundary = {"start": WORD_START, "end": WORD_END}
    return boundary[look] if re.match(r"\w", inner) else outside[look]


def country_pattern(name: str) -> str:
    """Whole-word, any-case pattern of a country name."""
    return f"(?iu){_edge(name[0], 'start')}{re.escape(name)}{_edge(name[-1], 'end')}"


def any_country_pattern(names: list[str]) -> str:
    """True exactly where one of the country patterns is; names with plain edges share their boundaries."""
    plain = [n for n in names if re.match(r"\w", n[0]) and re.match(r"\w", n[-1])]
    other = [country_pattern(n) for n in names if n not in plain]
    shared = f"(?iu){WORD_START}(?:{'|'.join(map(re.escape, plain))}){WORD_END}"
    return "|".join([shared] * bool(plain) + other)


def move_country(
    df: DataFrame,
    source_col: str = "source",
    location_col: str = "location",
    countries: list[str] = COUNTRIES,
) -> DataFrame:
    """Move the first country (in list order) found in the source to the location.

    One alternation, compiled once, tells whether any country occurs at all. Only then are the names
    tried in order, each behind a cheap substring test.
    """
    source, location = F.col(source_col), F.col(location_col)
    listed = F.array(
        *[F.struct(F.lit(n.lower()).alias("name"), F.lit(country_pattern(n)).alias("pattern")) for n in countries]
    )
    hits = F.filter(
        listed, lambda x: F.lower(source).contains(x["name"]) & F.rlike(source, x["pattern"])
    )
    pattern = F.when(source.rlike(any_country_pattern(countries)), F.get(hits, 0)["pattern"])
    found = F.regexp_substr(source, F.col("_pattern"))
    rest = F.when(
        F.col("_pattern").isNotNull(), strip_ws(F.regexp_replace(source, F.col("_pattern"), F.lit("")))
    ).otherwise(source)
    joined = F.when(F.coalesce(squeeze_ws(location), F.lit("")) == "", found).otherwise(
        F.concat(strip_ws(location), F.lit(" "), found)
    )
    return (
        df.withColumn("_pattern", pattern)
        .withColumns(
            {
                source_col: F.nullif(rest, F.lit("")),
                location_col: F.when(F.col("_pattern").isNotNull(), joined).otherwise(location),
            }
        )
        .drop("_pattern")
    )


def dateline_columns(
    df: DataFrame, label_col: str = "labels", title_col: str = "title", text_col: str = "description"
) -> DataFrame:
    """Extract, clean titles, restructure, move countries; then class, source, location, title, text."""
    out = extract_source(df, text_col)
    out = clean_title_by_source(out, title_col)
    out = move_country(restructure_source(out))
    front = [label_col, "source", "location", title_col, text_col]
    return out.select(*front, *[n for n in out.columns if n not in front])
