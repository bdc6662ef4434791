"""Dynamic itemset counting of phrases: against SQL and brute force, whatever the shards, bitmaps and seeds."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from doctopics.llm.collocations import collocations, count_phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count=10, top=2000, max_words=3):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if 2 <= len(p) <= max_words and a >= min_count}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus(seed=5, docs=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Größe", "naïve", "日本"]
    rows = []
    for k in range(docs):
        text = []
        while len(text) < 80:
            text += rng.choice([["New", "York", "city"], ["ad", "hoc"], [rng.choice(words)], [rng.choice(words)], ["a\tb"], ["x."], ["!"], ["so,on"]])
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(text)))
    rows += [("en", None), ("en", ""), (None, " . , \n"), ("fr", "one two"), ("en", "same words again. " * 400), ("it", "\x1c\x85   " * 30)]
    return rows + [("es", "only copies here, and more")] * 25


def table(spark, rows):
    return spark.createDataFrame([(k % 7, x, t, 1, 1) for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, a int, shard int")


@pytest.mark.parametrize("shards,bits,max_words", [(2, 1 << 20, 3), (1, 1 << 16, 3), (3, 64, 3), (5, 1 << 12, 2)])
def test_brute_force(spark, shards, bits, max_words):
    rows = corpus()
    got = collocations(table(spark, rows), shards=shards, bits=bits, max_words=max_words)
    assert result(got) == brute(rows, max_words=max_words)


def test_cut_and_ties(spark):
    """Many phrases with one score: the first in byte order are reported."""
    rows = [("xx", f"Z{k}ä q{k} . é{k} B{k}") for k in range(40)] * 10
    for top in (1, 7, 50):
        assert result(collocations(table(spark, rows), top=top)) == brute(rows, top=top)


def test_empty_and_rare(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(None, None), ("en", "a b c")])).count() == 0
    with pytest.raises(ValueError):
        count_phrases(table(spark, []), max_words=4)


def test_equal_hashes_start_again(spark):
    """Words whose hashes are equal under one seed are told apart under the next."""

    def weak(word, seed):
        return zlib.crc32(word[:1] if seed == 0 else word)

    rows = [("en", "alpha beta alpha bravo. gamma beta")] * 12
    words, phrases = count_phrases(table(spark, rows), hash_word=weak)
    assert sorted((r["word"], r["n"]) for r in words.collect()) == [("alpha", 24), ("beta", 24), ("bravo", 12), ("gamma", 12)]
    assert sorted(r["n"] for r in phrases.collect()) == [12] * 6
