"""Text cleaning, tokenising and datelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.constants import COUNTRIES, EMBED_STOP_WORDS, TOP_LEVEL_DOMAINS, WEB_TOKENS, WEEKDAYS
from doctopics.functions import dateline, porter, text, tokens
from doctopics.plans.base import STOP_SQL, V_ARTICLES, WORD_RE, articles, documents, register, sql_list, table
from doctopics.runtime import spread

# ---------------------------------------------------------------- SQL counterparts

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def sql_markup(c: str) -> str:
    for pattern in (
        r"(?is)<script\b.*?</script\s*>",
        r"(?is)<style\b.*?</style\s*>",
        r"(?s)<!--.*?-->",
        r"<[!/?a-zA-Z][^>]*>",
    ):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return c


def sql_unescape(c: str) -> str:
    entities = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}
    for entity, char in entities.items():
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def sql_strip(c: str) -> str:
    return sql_unescape(sql_markup(c))


def sql_drop_words(c: str, words) -> str:
    # Separators are kept, so a second pass finds the neighbours the first one skipped.
    pattern = f"(?i)(^|{NOT_W})(?:{'|'.join(words)})($|{NOT_W})"
    for _ in range(3):
        c = f"regexp_replace({c}, '{pattern}', '\\1\\2', 'g')"
    return c


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sql_numeric(c: str) -> str:
    return f"replace({c}, '#36;', '$')"


def sql_unquote(c: str) -> str:
    return f"replace({c}, '%20', ' ')"


def sql_quot(c: str) -> str:
    for marker in ("quot;", "FullQuote", "quot"):
        c = f"replace({c}, '{marker}', '\"')"
    return c


TLD = "|".join(TOP_LEVEL_DOMAINS)
RE_WEBSITE = rf"^\s*([A-Za-z]+\.(?:{TLD}))\s*(.*)$"
RE_ABBREV = r"^\s*(Calif\.|Flo\.)\s+(.*)$"
RE_DOT = rf"^\s*((?:{W}|-)+\.)(.*)$"
RE_DOT_DOMAIN = rf"^\s*(?:{W}|-)+\.\s*(?:{TLD})($|{NOT_W})"
RE_COMBO = r"^\s*(.+?)\s*\(([^()]+)\)\s*$"
RE_PAREN = r"^\s*([A-Z ]+)\s*\(([^)]+)\)"
RE_COMMA = r"^\s*([A-Z ]+),\s*(.+)$"
RE_TWO = r"\b([A-Z]{2,})\s+([A-Z]{2,})\b"
RE_ONE = r"\b[A-Z]{4,}\b"
COUNTRY_VALUES = ", ".join(f"({i}, {sql_list([n])})" for i, n in enumerate(COUNTRIES))

SQL_EXTRACTED = f"""extracted AS (
    SELECT doc_id, labels, title,
      CASE WHEN cut > 0 THEN {sql_trim("substr(description, 1, cut - 1)")} END AS source,
      CASE WHEN cut > 0 THEN {sql_trim("substr(description, cut + width)")} ELSE description END AS description
    FROM (SELECT *,
        CASE WHEN contains(substr(description, 1, 35), ' -- ') THEN instr(description, '--')
             WHEN contains(substr(description, 1, 30), ' - ') THEN instr(description, '-') ELSE 0 END AS cut,
        CASE WHEN contains(substr(description, 1, 35), ' -- ') THEN 2 ELSE 1 END AS width
      FROM v_articles))"""
SQL_TITLED = f"""titled AS (
    SELECT doc_id, labels, source, description,
      CASE WHEN source IS NOT NULL AND NOT contains(source, ' ')
           THEN {sql_squeeze("replace(title, '(' || source || ')', '')")} ELSE title END AS title
    FROM extracted)"""
SQL_RESTRUCTURED = f"""ruled AS (
    SELECT *, CASE WHEN source IS NULL THEN 9
        WHEN regexp_matches(source, '{RE_WEBSITE}') THEN 1
        WHEN regexp_matches(source, '{RE_ABBREV}') THEN 2
        WHEN regexp_matches(source, '{RE_DOT}') AND NOT regexp_matches(source, '{RE_DOT_DOMAIN}') THEN 3
        WHEN regexp_matches(source, '{RE_COMBO}') AND contains(regexp_extract(source, '{RE_COMBO}', 1), ',') THEN 4
        WHEN regexp_matches(source, '{RE_PAREN}') THEN 5
        WHEN regexp_matches(source, '{RE_COMMA}') THEN 6
        WHEN regexp_matches(source, '{RE_TWO}') THEN 7
        WHEN regexp_matches(source, '{RE_ONE}') THEN 8 ELSE 9 END AS rule
    FROM titled),
  located AS (
    SELECT *, trim(CASE rule
        WHEN 1 THEN nullif(regexp_extract(source, '{RE_WEBSITE}', 2), '')
        WHEN 2 THEN regexp_extract(source, '{RE_ABBREV}', 1)
        WHEN 3 THEN regexp_extract(source, '{RE_DOT}', 1)
        WHEN 4 THEN regexp_extract(source, '{RE_COMBO}', 1)
        WHEN 5 THEN regexp_extract(source, '{RE_PAREN}', 1)
        WHEN 6 THEN regexp_extract(source, '{RE_COMMA}', 1)
        WHEN 7 THEN regexp_extract(source, '{RE_TWO}', 1) || ' ' || regexp_extract(source, '{RE_TWO}', 2)
        WHEN 8 THEN regexp_extract(source, '{RE_ONE}') END) AS location
    FROM ruled),
  restructured AS (
    SELECT doc_id, labels, title, description, location,
      CASE WHEN location IS NULL THEN source ELSE trim(CASE rule
        WHEN 1 THEN regexp_extract(source, '{RE_WEBSITE}', 1)
        WHEN 2 THEN regexp_extract(source, '{RE_ABBREV}', 2)
        WHEN 3 THEN regexp_extract(source, '{RE_DOT}', 2)
        WHEN 4 THEN regexp_extract(source, '{RE_COMBO}', 2)
        WHEN 5 THEN regexp_extract(source, '{RE_PAREN}', 2)
        WHEN 6 THEN regexp_extract(source, '{RE_COMMA}', 2)
        WHEN 7 THEN replace(source, regexp_extract(source, '{RE_TWO}'), '')
        WHEN 8 THEN regexp_replace(source, '\\b' || location || '\\b', '', 'g') END) END AS source
    FROM located)"""
SQL_MOVED = f"""countries(ord, name) AS (VALUES {COUNTRY_VALUES}),
  found AS (
    SELECT source, arg_min('(?i)\\b' || regexp_escape(name) || '\\b', ord) AS pattern
    FROM (SELECT DISTINCT source FROM restructured WHERE source IS NOT NULL), countries
    WHERE regexp_matches(source, '(?i)\\b' || regexp_escape(name) || '\\b') GROUP BY source),
  moved AS (
    SELECT doc_id, labels, title, description,
      nullif(CASE WHEN pattern IS NULL THEN source
                  ELSE trim(regexp_replace(source, pattern, '', 'g')) END, '') AS source,
      CASE WHEN pattern IS NULL THEN location
           WHEN trim(coalesce(location, '')) = '' THEN regexp_extract(source, pattern)
           ELSE trim(location) || ' ' || regexp_extract(source, pattern) END AS location
    FROM restructured LEFT JOIN found USING (source))"""
DATELINE_CTES = ", ".join([V_ARTICLES, SQL_EXTRACTED, SQL_TITLED, SQL_RESTRUCTURED, SQL_MOVED])


def _on_frame(column):
    """Lift a column function to ``(df, columns)``."""
    return lambda df, names: df.withColumns({n: column(F.col(n)) for n in names})


def on_description(name: str, sql: str, clean) -> None:
    """Register a cleaning step over the article texts."""

    @register(name, f"WITH {V_ARTICLES} SELECT doc_id, length({sql}) AS n, md5({sql}) AS cleaned_md5 FROM v_articles")
    def run(spark, sf_dir):
        df = spread(articles(spark, sf_dir).selectExpr("doc_id", "description AS cleaned"))
        cleaned = clean(df, ["cleaned"])
        return cleaned.select("doc_id", F.length("cleaned").cast("long").alias("n"), F.md5("cleaned").alias("cleaned_md5"))


def on_pages(name: str, sql: str, clean) -> None:
    """Register a cleaning step over the raw web pages."""

    @register(name, f"SELECT page_id, length({sql}) AS n, md5({sql}) AS cleaned_md5 FROM pages")
    def run(spark, sf_dir):
        df = spread(table(spark, sf_dir, "pages").selectExpr("page_id", "html AS cleaned"))
        cleaned = clean(df, ["cleaned"])
        return cleaned.select("page_id", F.length("cleaned").cast("long").alias("n"), F.md5("cleaned").alias("cleaned_md5"))


on_pages("strip_html", sql_strip("html"), text.strip_html)
on_pages("html_unescape", sql_unescape("html"), _on_frame(text.html_unescape))
on_description("url_unquote", sql_unquote("description"), _on_frame(text.url_unquote))
on_description("numeric_entities", sql_numeric("description"), _on_frame(text.numeric_entities))
on_description("replace_quot", sql_quot("description"), _on_frame(text.replace_quot))
on_description("drop_web_tokens", sql_drop_words("description", WEB_TOKENS), _on_frame(text.drop_web_tokens))
on_description("drop_weekdays", sql_drop_words("description", WEEKDAYS), _on_frame(text.drop_weekdays))
on_description("squeeze_ws", sql_squeeze("description"), _on_frame(text.squeeze_ws))

_full = sql_numeric(sql_unquote(sql_unescape(sql_strip("description"))))
SQL_FULL_TRANSFORM = sql_squeeze(sql_drop_words(sql_drop_words(_full, WEB_TOKENS), WEEKDAYS))
on_description("full_text_transform", SQL_FULL_TRANSFORM, text.full_text_transform)


@register(
    "count_quot",
    f"""WITH {V_ARTICLES}, hits AS (SELECT doc_id, description FROM v_articles WHERE contains(description, 'quot;'))
    SELECT 'count' AS kind, count(*) AS n_rows, CAST(NULL AS BIGINT) AS doc_id, NULL AS text_md5 FROM hits
    UNION ALL (SELECT 'example', NULL, doc_id, md5(description) FROM hits ORDER BY doc_id LIMIT 5)""",
)
def count_quot(spark, sf_dir):
    out = text.count_quot(articles(spark, sf_dir), "description")
    return out.select("kind", "n_rows", "doc_id", F.md5("description").alias("text_md5"))


def _reference_clean(c: str) -> str:
    return sql_unquote(sql_unescape(sql_strip(c)))


@register(
    "character_reference_clean",
    f"""WITH {V_ARTICLES} SELECT doc_id, {_reference_clean('title')} AS title,
        md5({_reference_clean('description')}) AS cleaned_md5 FROM v_articles""",
)
def character_reference_clean(spark, sf_dir):
    df = text.character_reference_clean(spread(articles(spark, sf_dir)), ["title", "description"])
    return df.select("doc_id", "title", F.md5("description").alias("cleaned_md5"))


def _noise(c: str) -> str:
    return _reference_clean(sql_numeric(sql_quot(sql_strip(c))))


@register(
    "noise_clean_v3",
    f"""WITH {V_ARTICLES} SELECT doc_id, md5({_noise('title')} || ' ' || {_noise('description')}) AS combined_md5
    FROM v_articles""",
)
def noise_clean_v3(spark, sf_dir):
    return text.noise_clean(spread(articles(spark, sf_dir))).select("doc_id", F.md5("combined").alias("combined_md5"))


_embed = sql_squeeze(sql_drop_words(sql_drop_words(sql_numeric("description"), WEB_TOKENS), WEEKDAYS))
_embed = f"regexp_replace(lower({_embed}), 'https?://[!$-_a-z]+', ' URL ', 'g')"
_embed = f"regexp_replace({_embed}, '\\S+@\\S+', ' EMAIL ', 'g')"


@register(
    "embed_preprocess",
    f"""WITH {V_ARTICLES}, t AS (SELECT doc_id, list_filter(string_split({sql_squeeze(_embed)}, ' '),
        lambda w: length(w) > 1 AND w NOT IN ({sql_list(EMBED_STOP_WORDS)})) AS ws FROM v_articles)
    SELECT doc_id, len(ws) AS n, md5(array_to_string(ws, ' ')) AS cleaned_md5 FROM t""",
)
def embed_preprocess(spark, sf_dir):
    df = spread(articles(spark, sf_dir).select("doc_id", "description"))
    df = df.select("doc_id", text.embed_preprocess(F.col("description")).alias("c"))
    n = F.when(F.col("c") == "", 0).otherwise(F.size(F.split("c", " ")))
    return df.select("doc_id", n.cast("long").alias("n"), F.md5("c").alias("cleaned_md5"))


# ---------------------------------------------------------------- tokens


def _token_report(df):
    return df.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


def _report_sql(ctes: str, tokens_sql: str = "tokens") -> str:
    return f"""WITH {ctes} SELECT doc_id, len({tokens_sql}) AS n_tokens,
        md5(array_to_string({tokens_sql}, ' ')) AS tokens_md5 FROM t"""


_clean_sql = r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\p{Nd}+', ' ', 'g')"
_case_sql = "CASE w " + " ".join(f"WHEN '{a}{b}' THEN ['{a}', '{b}']" for a, b in tokens.CONTRACTIONS) + " ELSE [w] END"
PREPROCESSED_CTE = f"""t AS (SELECT doc_id, lang, list_filter(
        flatten(list_transform(string_split({sql_squeeze(_clean_sql)}, ' '), lambda w: {_case_sql})),
        lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})) AS tokens FROM documents)"""


def preprocessed(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", tokens.preprocess_tokens(F.col("text")).alias("tokens"))


@register("preprocess_tokens", _report_sql(PREPROCESSED_CTE))
def preprocess_tokens(spark, sf_dir):
    return _token_report(preprocessed(spark, sf_dir))


def _stem_sql() -> str:
    """Porter stems of the distinct tokens ``forms(w0)`` as ``stems(w0, w)``, one CTE per step.

    A leading y is written Y, so that the vowel classes treat it as a consonant.
    """
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    positive, above_one = f"^(?:{c})?{v}{c}", f"^(?:{c})?(?:{v}{c}){{2}}"
    exactly_one = f"^(?:{c})?{v}{c}(?:{v})?$"
    short = f"(^{c}[aeiouy][^aeiouwxy]$)|(^[aeiou][^aeiou]$)"
    vowel = f"^(?:{c})?[aeiouy]"

    def m(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def cut(suffix: str) -> str:
        return f"left(w, -{len(suffix)})"

    def rules(pairs, pattern: str) -> str:
        cases = [
            f"WHEN w LIKE '%{old}' THEN CASE WHEN {m(cut(old), pattern)} THEN {cut(old)} || '{new}' ELSE w END"
            for old, new in pairs
        ]
        return "CASE " + " ".join(cases) + " ELSE w END"

    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in porter.IRREGULAR.items())
    fixed = f"(length(w0) <= 2 OR w0 IN ({sql_list(porter.IRREGULAR)}))"
    past = f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END
        WHEN w LIKE '%eed' THEN CASE WHEN {m("left(w, -3)", positive)} THEN left(w, -1) ELSE w END
        WHEN w LIKE '%ed' AND {m("left(w, -2)", vowel)} THEN '+' || left(w, -2)
        WHEN w LIKE '%ing' AND {m("left(w, -3)", vowel)} THEN '+' || left(w, -3) ELSE w END"""
    doubled = "length(w) > 2 AND right(w, 1) = substr(w, -2, 1) AND regexp_matches(w, '[^aeiou]$')"
    mended = f"""CASE WHEN w NOT LIKE '+%' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN substr(w, 2) || 'e'
        WHEN {doubled} AND NOT regexp_matches(w, '[lsz]$') THEN substr(w, 2, length(w) - 2)
        WHEN {doubled} THEN substr(w, 2)
        WHEN {m("substr(w, 2)", exactly_one)} AND {m("substr(w, 2)", short)} THEN substr(w, 2) || 'e' ELSE substr(w, 2) END"""
    four = [(x, "") for x in porter.STEP4 if x != "ion"]
    steps = [
        """CASE WHEN w LIKE '%ies' THEN CASE WHEN length(w) = 4 THEN left(w, -1) ELSE left(w, -2) END
        WHEN w LIKE '%sses' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END""",
        past,
        mended,
        "CASE WHEN w LIKE '%y' AND length(w) > 2 AND regexp_matches(left(w, -1), '([^aeiouy]|[aeiou]y)$') THEN left(w, -1) || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {m(cut('alli'), positive)} THEN left(w, -2) ELSE w END",
        rules(porter.STEP2, positive),
        f"CASE WHEN w LIKE '%logi' AND {m('left(w, -3)', positive)} THEN left(w, -1) ELSE w END",
        rules(porter.STEP3, positive),
        rules(four[:11], above_one).removesuffix(" ELSE w END")
        + f" WHEN w LIKE '%ion' THEN CASE WHEN {m(cut('ion'), above_one)} AND regexp_matches({cut('ion')}, '[st]$') THEN {cut('ion')} ELSE w END "
        + rules(four[11:], above_one).removeprefix("CASE "),
        f"""CASE WHEN w LIKE '%e' AND ({m("left(w, -1)", above_one)} OR ({m("left(w, -1)", exactly_one)}
            AND NOT {m("left(w, -1)", short)})) THEN left(w, -1) ELSE w END""",
        f"CASE WHEN w LIKE '%ll' AND {m('left(w, -1)', above_one)} THEN left(w, -1) ELSE w END",
    ]
    ctes = ["s0 AS (SELECT w0, CASE WHEN starts_with(w0, 'y') THEN 'Y' || substr(w0, 2) ELSE w0 END AS w FROM forms)"]
    for i, step in enumerate(steps):
        ctes.append(f"s{i + 1} AS (SELECT w0, {step} AS w FROM s{i})")
    done = f"CASE WHEN {fixed} THEN CASE w0 {irregular} ELSE w0 END ELSE replace(w, 'Y', 'y') END"
    ctes.append(f"stems AS (SELECT w0, {done} AS w FROM s{len(steps)})")
    return ", ".join(ctes)


STEMMED = f"""WITH {PREPROCESSED_CTE}, long AS (SELECT doc_id, unnest(tokens) AS w0, generate_subscripts(tokens, 1) AS i FROM t),
    forms AS (SELECT DISTINCT w0 FROM long), {_stem_sql()},
    lists AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM long JOIN stems USING (w0) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(ws), 0) AS n_tokens, md5(coalesce(array_to_string(ws, ' '), '')) AS tokens_md5
    FROM documents LEFT JOIN lists USING (doc_id)"""


@register("stem_tokens", STEMMED)
def stem_tokens(spark, sf_dir):
    return _token_report(preprocessed(spark, sf_dir).withColumn("tokens", tokens.stem_tokens(F.col("tokens"))))


@register(
    "lemmatise_tokens",
    _report_sql(
        PREPROCESSED_CTE,
        "list_transform(tokens, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END)",
    ),
)
def lemmatise_tokens(spark, sf_dir):
    df = preprocessed(spark, sf_dir)
    forms = df.select(F.explode("tokens").alias("form")).distinct().filter("length(form) > 3 AND form LIKE '%s'")
    lexicon = forms.select("form", F.expr("left(form, length(form) - 1)").alias("lemma"))
    return _token_report(tokens.lemmatise_tokens(df, lexicon))


WORD_LISTS_CTE = f"""t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD_RE}'),
        lambda w: w NOT IN ({STOP_SQL})) AS tokens FROM documents)"""


def _words(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", tokens.word_tokens(F.col("text")).alias("tokens"))


@register("sk_tokenise", _report_sql(WORD_LISTS_CTE))
def sk_tokenise(spark, sf_dir):
    return _token_report(_words(spark, sf_dir))


@register(
    "whitespace_tokens",
    _report_sql(
        f"t AS (SELECT doc_id, list_filter(string_split({sql_squeeze('text')}, ' '), lambda w: w <> '') AS tokens FROM documents)"
    ),
)
def whitespace_tokens(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return _token_report(docs.select("doc_id", tokens.whitespace_tokens(F.col("text")).alias("tokens")))


@register(
    "ngrams_1_2",
    _report_sql(
        WORD_LISTS_CTE,
        "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))",
    ),
)
def ngrams_1_2(spark, sf_dir):
    return _token_report(_words(spark, sf_dir).withColumn("tokens", tokens.ngrams_1_2(F.col("tokens"))))


# ---------------------------------------------------------------- datelines


@register(
    "extract_source",
    f"WITH {V_ARTICLES}, {SQL_EXTRACTED} SELECT doc_id, source, md5(description) AS text_md5 FROM extracted",
)
def extract_source(spark, sf_dir):
    df = dateline.extract_source(articles(spark, sf_dir))
    return df.select("doc_id", "source", F.md5("description").alias("text_md5"))


@register(
    "clean_title_by_source",
    f"WITH {V_ARTICLES}, {SQL_EXTRACTED}, {SQL_TITLED} SELECT doc_id, source, title FROM titled",
)
def clean_title_by_source(spark, sf_dir):
    df = dateline.clean_title_by_source(dateline.extract_source(articles(spark, sf_dir)))
    return df.select("doc_id", "source", "title")


@register(
    "restructure_source",
    f"""WITH {V_ARTICLES}, {SQL_EXTRACTED}, {SQL_TITLED}, {SQL_RESTRUCTURED}
    SELECT doc_id, source, location FROM restructured""",
)
def restructure_source(spark, sf_dir):
    df = dateline.restructure_source(dateline.extract_source(articles(spark, sf_dir)))
    return df.select("doc_id", "source", "location")


@register("move_country", f"WITH {DATELINE_CTES} SELECT doc_id, source, location FROM moved")
def move_country(spark, sf_dir):
    df = dateline.restructure_source(dateline.extract_source(articles(spark, sf_dir)))
    return dateline.move_country(df).select("doc_id", "source", "location")


@register(
    "dateline_columns",
    f"WITH {DATELINE_CTES} SELECT doc_id, labels, source, location, title, md5(description) AS text_md5 FROM moved",
)
def dateline_columns(spark, sf_dir):
    df = dateline.dateline_columns(articles(spark, sf_dir))
    return df.select("labels", "source", "location", "title", F.md5("description").alias("text_md5"), "doc_id")
