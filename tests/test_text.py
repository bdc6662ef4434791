"""Golden rows for cleaning, tokenising, stemming and datelines."""

from __future__ import annotations

import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doctopics.constants import COUNTRIES
from doctopics.functions import dateline, text, tokens
from doctopics.functions.porter import stem


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


def frame(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["c"] for r in fn(df, ["c"]).orderBy("i").collect()]


def test_single_steps(spark):
    assert column(spark, ["quota", "quot;a", "FullQuoteb", None], text.replace_quot) == ['"a', '"a', '"b', None]
    assert column(spark, ["#36;5", "#8364;", "#99999999999;", "#55296;"], text.numeric_entities) == [
        "$5", "€", "#99999999999;", "#55296;",
    ]
    assert column(spark, ["a+b%20c", "50% off", "%C3%A9"], text.url_unquote) == ["a+b c", "50% off", "é"]
    assert column(spark, ["&lt;b&gt; &amp;amp; &eacute;", None], text.html_unescape) == ["<b> &amp; é", None]
    assert column(spark, ["Mon. at www.x.com"], text.drop_noise_words) == [". at .x."]
    assert column(spark, ["a sun Sunny MON"], text.drop_weekdays) == ["a  Sunny "]
    assert column(spark, ["  a  \t b\n"], text.squeeze_ws) == ["a b"]


def test_markup(spark):
    soup = '<p>a<b>b</b></p><script>var t="</p>";</script><!-- x -->c &amp;lt; 1 < 2'
    assert frame(spark, [soup, None], text.strip_html) == ["abc &lt; 1 < 2", None]
    assert frame(spark, ["&amp;lt;i&gt; 50%25"], text.character_reference_clean) == ["<i> 50%"]
    assert frame(spark, ["<a>See</a> www.x.org on Monday #36;5 %41"], text.full_text_transform) == ["See .x. on $5 A"]


def test_embed_preprocess(spark):
    out = column(spark, ["See https://x.io at a@b.c THE end", "http only", None], text.embed_preprocess)
    assert out == ["see URL EMAIL end", "only", None]


def test_count_quot(spark):
    df = spark.createDataFrame([(i, "quot; x" if i % 2 else None) for i in range(20)], "doc_id long, t string")
    rows = text.count_quot(df, "t").collect()
    assert [r["n_rows"] for r in rows if r["kind"] == "count"] == [10]
    assert sorted(r["doc_id"] for r in rows if r["kind"] == "example") == [1, 3, 5, 7, 9]


def test_tokens(spark):
    words = column(spark, ["The b2b café's cannot GONNA won't 42abc", ""], tokens.preprocess_tokens)
    assert words == [["café", "gon", "abc"], []]
    assert column(spark, ["It is a b cd-ef"], lambda c: tokens.word_tokens(c, ())) == [["it", "is", "cd", "ef"]]
    assert column(spark, [" A  b C ", " "], tokens.whitespace_tokens) == [["A", "b", "C"], []]
    grams = column(spark, ["aa bb cc", "aa", ""], lambda c: tokens.ngrams_1_2(tokens.word_tokens(c, ())))
    assert grams == [["aa", "bb", "cc", "aa bb", "bb cc"], ["aa"], []]


@pytest.mark.parametrize(
    "word, root",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("dies", "die"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
        ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"),
        ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("conformabli", "conform"),
        ("radicalli", "radic"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"),
        ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("sensibiliti", "sensibl"),
        ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"),
        ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("communism", "commun"),
        ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
        ("roll", "roll"), ("companies", "compani"), ("software", "softwar"), ("news", "news"), ("dying", "die"), ("as", "as"),
    ],
)
def test_porter(word, root):
    assert stem(word) == root


def test_stems_and_lemmas(spark):
    df = spark.createDataFrame([(1, ["games", "running", "games"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    stems = df.select("doc_id", tokens.stem_tokens(F.col("tokens")).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in stems] == [["game", "run", "game"], [], None]
    lexicon = spark.createDataFrame([("games", "game")], "form string, lemma string")
    lemmas = tokens.lemmatise_tokens(df, lexicon).orderBy("doc_id").collect()
    assert [r["tokens"] for r in lemmas] == [["game", "running", "game"], [], []]


EXTRACT = [
    ("NEW YORK (Reuters) - Stocks rose", "NEW YORK (Reuters)", "Stocks rose"),
    ("SAN FRANCISCO, Calif. (AP) -- Rain - today", "SAN FRANCISCO, Calif. (AP)", "Rain - today"),
    ("A--B -- C", "A", "B -- C"),
    ("No dateline here at all, none - not in 30", None, "No dateline here at all, none - not in 30"),
    ("plain text", None, "plain text"),
    (None, None, None),
]
RULES = [
    ("NEW YORK (Reuters)", "Reuters", "NEW YORK"),
    ("NEW YORK (Reuters) extra", "Reuters", "NEW YORK"),
    ("SAN FRANCISCO, Calif. (AP)", "AP", "SAN FRANCISCO, Calif."),
    ("SPACE.com Houston", "SPACE.com", "Houston"),
    ("SPACE.com", "SPACE.com", None),
    ("SPACE.", "", "SPACE."),
    ("Calif. AP", "AP", "Calif."),
    ("St. Louis Post", "Louis Post", "St."),
    ("U.S. Newswire", "S. Newswire", "U."),
    ("WASHINGTON, AP", "AP", "WASHINGTON"),
    ("LOS ANGELES Reuters", "Reuters", "LOS ANGELES"),
    ("SOUTH KOREA", "", "SOUTH KOREA"),
    ("BAGHDAD Reuters", "Reuters", "BAGHDAD"),
    ("LONDON/PARIS (AFP)", "/PARIS (AFP)", "LONDON"),
    ("AP", "AP", None),
    (None, None, None),
]
MOVES = [
    ("Iraq AP", None, "AP", "Iraq"),
    ("iraq AP", "BAGHDAD ", "AP", "BAGHDAD iraq"),
    ("Papua New Guinea Reuters", None, "Papua New  Reuters", "Guinea"),
    ("", "SPACE.", None, "SPACE."),
    ("Nigeria", None, None, "Nigeria"),
    (None, "x", None, "x"),
    ("Reuters", "", "Reuters", ""),
    ("Congo (Congo-Brazzaville)", None, "Congo (Congo-Brazzaville)", None),
]
TITLES = [
    ("Stocks  up (Reuters)", "Reuters", "Stocks up"),
    ("Stocks  up (Reuters)", "NEW YORK (Reuters)", "Stocks  up (Reuters)"),
    ("Stocks  up", None, "Stocks  up"),
]


def test_extract_source(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(EXTRACT)], "i int, description string")
    rows = dateline.extract_source(df).orderBy("i").collect()
    assert [(r["source"], r["description"]) for r in rows] == [e[1:] for e in EXTRACT]


def test_restructure_source(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(RULES)], "i int, source string")
    rows = dateline.restructure_source(df).orderBy("i").collect()
    assert [(r["source"], r["location"]) for r in rows] == [e[1:] for e in RULES]


def test_move_country(spark):
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _, _) in enumerate(MOVES)], "i int, source string, location string")
    rows = dateline.move_country(df).orderBy("i").collect()
    assert [(r["source"], r["location"]) for r in rows] == [e[2:] for e in MOVES]


def test_every_country_is_found_in_list_order(spark):
    plain = [n for n in COUNTRIES if not n.endswith(")")]
    df = spark.createDataFrame([(n,) for n in plain], "source string").withColumn("location", F.lit(None).cast("string"))
    found = {r["n"]: r["location"] for r in dateline.move_country(df.withColumn("n", F.col("source"))).collect()}
    shadowed = {n: "Guinea" for n in ("Guinea-Bissau", "Papua New Guinea")}
    assert found == {n: shadowed.get(n, n) for n in plain}
    assert len(COUNTRIES) == 195


def test_clean_title(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(TITLES)], "i int, title string, source string")
    rows = dateline.clean_title_by_source(df).orderBy("i").collect()
    assert [r["title"] for r in rows] == [e[2] for e in TITLES]


def test_dateline_column_order(spark):
    df = spark.createDataFrame([(1, 3, "Up (AP)", "AP - text")], "doc_id long, labels int, title string, description string")
    out = dateline.dateline_columns(df)
    assert out.columns == ["labels", "source", "location", "title", "description", "doc_id"]
    assert tuple(out.first())[1:5] == ("AP", None, "Up", "text")


def test_embed_preprocess_long_address(spark):
    """The address pattern needs no recursion."""
    long = "see HTTPS://a.b/" + "x%20(y)*" * 15_000 + " now"
    df = spark.createDataFrame([(long,), ("https://" + "a" * 100_000 + "|rest of it",), ("b" * 100_000 + " @@x a@ @c d@e",)], "t string")
    out = [r[0] for r in df.select(text.embed_preprocess(F.col("t"))).collect()]
    assert out[0].split()[:2] == ["see", "URL"] and out[1].startswith("URL |rest")
    assert out[2].split()[1:] == ["EMAIL", "a@", "@c", "EMAIL"]


def test_url_unquote_matches_the_standard_library(spark):
    from urllib.parse import unquote

    texts = ["a%20b", "a+b%2Bc", "50% off", "%zz%41", "%C3%A9", "%E9x", "%", "é%C3%A9%2", "%41%", None, "", "plain", "%F0%9F%99%82", "%00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", text.url_unquote(F.col("t"))).collect()}
    assert got == {i: None if t is None else unquote(t) for i, t in enumerate(texts)}


def test_decoding_holds_few_strings_as_objects():
    """A batch of long texts is decoded in order, nulls kept, with at most a part of it as Python strings at once."""
    alive, most = 0, 0

    class Counted(str):
        def __new__(cls, text):
            nonlocal alive, most
            alive, most = alive + 1, max(most, alive + 1)
            return super().__new__(cls, text)

        def __del__(self):
            nonlocal alive
            alive -= 1

    values = [None if i % 5 == 0 else f"{i}&amp;" for i in range(1000)]
    out = text._decoded(pa.array(values), lambda s: Counted(html.unescape(s)))
    assert out.to_pylist() == [None if v is None else v.replace("&amp;", "&") for v in values]
    assert most <= 2 * text.DECODED_ROWS
    assert text._decoded(pa.array([], pa.string()), str.upper).to_pylist() == []
