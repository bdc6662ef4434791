"""Language ID by held-out accuracy, and its code."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from doctopics.llm.langid import BUCKETS, SMOOTHING, STEEPNESS, Codec, codewords, fit, identify_languages, predict
from doctopics.llm.q_text import op9_language_id


def test_query_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = op9_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_far_apart(n):
    code = codewords(n)
    far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(far) >= code.shape[1] // 2 if n > 4 else min(far) > 0
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_edges(docs_of):
    rows = [(None, "the cat and the dog"), (1, None), (2, ""), (3, "123 !!"), (4, "the house and the tree"), (4, "the house and the tree")]
    rows += [(5, "der hund und die katze"), (6, "das haus und der baum"), (7, "die " * 100_000), (8, "日本"), (9, "x")]
    df = docs_of(rows, lang_pred=("int", [1] * 11), held_out=("int", [1] * 11)).drop("lang")
    df = df.selectExpr("*", "CASE WHEN doc_id IN (5, 6, 7) THEN 'de' WHEN doc_id = 9 THEN NULL ELSE 'en' END AS lang")
    out = sorted(((r["doc_id"], r["lang_pred"]) for r in identify_languages(df).collect()), key=repr)
    by = dict(out)
    assert len(out) == 11 and [by[i] for i in (1, 2, 3)] == ["und"] * 3
    assert by[None] == "en" and by[4] == "en" and by[7] == "de" and by[8] in ("en", "de")
    assert identify_languages(docs_of([])).count() == 0
    unlabelled = docs_of([(1, "abc")]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert identify_languages(unlabelled).first()["lang_pred"] == "und"


def test_flags_mixed_text(docs_of):
    en, de = "the cat and the dog went there with them", "der hund und die katze gehen nicht durch das haus"
    rows = [(k, (en if k % 2 else de) + f" {'the' if k % 2 else 'die'}") for k in range(40)] + [(1000, None)]
    mixed = " ".join(a + " " + b for a, b in zip(en.split(), de.split(), strict=False))
    df = docs_of([*rows, (2000, mixed)]).drop("lang").selectExpr("*", "CASE WHEN doc_id < 1000 THEN IF(doc_id % 2 = 1, 'en', 'de') END AS lang")
    out = {r["doc_id"]: r for r in identify_languages(df).collect()}
    assert all(out[k]["lang_pred"] == ("en" if k % 2 else "de") and not out[k]["ambiguous"] for k in range(40))
    assert out[1000]["ambiguous"] and out[2000]["score"] < min(out[k]["score"] for k in range(40))


def plain_grams(text):
    """Byte n-grams of 1 to 3 within runs of letters, A-Z lower-cased, as the buckets they hash to."""
    out, data = [], bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for k in range(len(data)):
        code = 0
        for n in range(3):
            if k < n or not (data[k - n] >= 0x80 or 97 <= data[k - n] <= 122):
                break
            code += (data[k - n] + 1) << (9 * n)
            x = code
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = ((x ^ (x >> shift)) * factor) % 2**64
            out.append((x ^ (x >> 31)) % BUCKETS)
    return out


def plain_fit(rows):
    """Weights, bias and trust by plain counting of (text, lang) rows."""
    languages = sorted({lang for _, lang in rows})
    code, counts = codewords(len(languages)), {x: Counter() for x in languages}
    for text, lang in rows:
        counts[lang].update(plain_grams(text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    profile = [{g: (counts[x][g] + SMOOTHING / BUCKETS) / (total[x] + SMOOTHING) for g in range(BUCKETS)} for x in languages]
    bits = range(code.shape[1])

    def mean(b, sign, g):
        side = [p[g] for p, c in zip(profile, code) if c[b] == sign]
        return sum(side) / len(side)

    weight = [[math.log((mean(b, 1, g) + 1e-7) / (mean(b, -1, g) + 1e-7)) for g in range(BUCKETS)] for b in bits]
    sides = [[sum(p[g] * weight[b][g] for g in range(BUCKETS)) for p in profile] for b in bits]
    bias = [-(min(m for m, c in zip(sides[b], code) if c[b] > 0) + max(m for m, c in zip(sides[b], code) if c[b] < 0)) / 2 for b in bits]

    def margins(text):
        own = plain_grams(text)
        return [sum(weight[b][g] for g in own) / len(own) + bias[b] if own else 0.0 for b in bits]

    trust = []
    for b in bits:
        rates = []
        for k, x in enumerate(languages):
            tries = [margins(t)[b] * code[k][b] > 0 for t, lang in rows if lang == x]
            rates.append(sum(tries) / len(tries))
        trust.append(max(2 * sum(rates) / len(rates) - 1, 0.01))
    return languages, code, margins, trust


def plain_decode(languages, code, margin, trust):
    losses = [sum(t * math.log1p(math.exp(-m * c * STEEPNESS)) for m, c, t in zip(margin, word, trust)) for word in code]
    near = [math.exp(min(losses) - x) for x in losses]
    return languages[losses.index(min(losses))], max(near) / sum(near)


def test_plain_version(spark, docs_of):
    texts = {"en": "the cat and the dog went there", "de": "der Hund und die Katze gehen", "fr": "le chien et le chat sont là", "nl": "de hond en de kat gaan"}
    rows = [(f"{t} {'x' * k}{k} {t[k:]}", lang) for lang, t in texts.items() for k in range(4)]
    frame = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    codec = fit(frame)
    languages, code, margins, trust = plain_fit(rows)
    assert codec.languages == languages and np.allclose(codec.trust, trust)
    asked = ["the house", "das Haus und der Baum", "le là", "de kat", "zq", "ÀÉ", "a" * 3000, "the der le de"]
    held = spark.createDataFrame([(k, t, False) for k, t in enumerate(asked)], "doc_id long, text string, held_out boolean")
    for r in predict(held, codec).collect():
        lang, score = plain_decode(languages, code, margins(asked[r["doc_id"]]), trust)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_ties_and_many_languages():
    """Equal losses go to the first language; decoding needs texts x languages numbers, not times bits."""
    code = codewords(512)
    codec = Codec([f"l{k:03d}" for k in range(512)], code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    best, share = codec.decode(np.zeros((2000, code.shape[1])))
    assert (best == 0).all() and np.allclose(share, 1 / 512)
    best, _ = codec.decode(code[[3, 400]].astype(float))
    assert best.tolist() == [3, 400]
