"""PPM scores against a plain coder, the word base against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctopics.llm import ppm
from doctopics.llm.ppm import END, Slots, Trie, adaptive_log10, adaptive_score, fit, score, score_held_out
from doctopics.llm.q_text import op4_lm_scoring

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute_base(rows):
    def tokens(t):
        return [*(t or "").encode().translate(LOWER).split(), None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for (i, t), h in zip(rows, held, strict=True)
    ]


def plain(train, text, order, least=0.0):
    """A coder straight from the definition: dictionaries, one byte at a time."""
    pad = bytes([END]) * order
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        s = pad + b" ".join(t.translate(LOWER).split()) + bytes([END])
        for p in range(order, len(s)):
            for o in range(order + 1):
                grams[o][s[p - o : p + 1]] += 1
    least *= sum(grams[0].values())
    kept = [{g: c for g, c in level.items() if c >= least} for level in grams]
    s, total = pad + b" ".join(text.translate(LOWER).split()) + bytes([END]), 0.0
    for p in range(order, len(s)):
        out = set()
        for o in range(order, -1, -1):
            here = {g[-1]: c for g, c in kept[o].items() if g[:-1] == s[p - o : p]}
            own = {x: c for x, c in here.items() if x not in out}
            # occurrences before bytes that are not kept are escapes
            other = sum(c for g, c in grams[o].items() if g[:-1] == s[p - o : p]) - sum(here.values()) if here else 0
            escapes = len(own) + other
            if s[p] in own:
                total += math.log10(own[s[p]] / (sum(own.values()) + escapes))
                break
            if escapes:
                total += math.log10(escapes / (sum(own.values()) + escapes))
            out = set(here)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = {r["doc_id"]: r for r in op4_lm_scoring(spark, sf_dir).collect()}
    want = brute_base(rows)
    assert len(out) == len(want)
    for i, held, n, known, total, base in want:
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in out.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 1.2 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out.values())


@pytest.mark.parametrize(("order", "share"), [(1, 1e-9), (3, 1e-9), (3, 0.02), (5, 0.004)])
def test_score_matches_plain_coder(docs_of, order, share):
    train = [b"the cat sat on the mat", b"The mat sat", b"", "éé ñ the".encode(), b"aaaa\n\nbbb"]
    texts = [b"the cat", b"", b"zebra THE mat", "é\U0001f642".encode(), b"aaaa"]
    df = docs_of([(k, t.decode()) for k, t in enumerate(train)])
    from pyspark.sql import functions as F

    asked = docs_of([(k, t.decode()) for k, t in enumerate(texts)]).withColumn("held_out", F.lit(True))
    out = {r["doc_id"]: r["score"] for r in score(asked, fit(df, order, share)).collect()}
    for k, t in enumerate(texts):
        assert out[k] == pytest.approx(plain(train, t, order, share))


@pytest.mark.parametrize("order", [1, 2, 5])
def test_rare_ngrams_predict(docs_of, monkeypatch, order):
    """N-grams too rare to be broadcast predict like frequent ones, and unseen ones escape through all orders."""
    monkeypatch.setattr(ppm, "SHARE", 0.02)
    train = [b"the cat sat on the mat", b"The mat sat", b"", "éé ñ the".encode(), b"aaaa\n\nbbb", b"qux zyx"]
    texts = [b"the cat", b"", b"zebra THE mat qux", "é\U0001f642".encode(), b"aaaa", b"qux zyx", b"zyxq" * 50]
    asked = docs_of([(k, t.decode()) for k, t in enumerate(texts)]).withColumn("held_out", F.lit(True))
    df = docs_of([(k, t.decode()) for k, t in enumerate(train)])
    out = {r["doc_id"]: r["score"] for r in score(asked, fit(df, order)).collect()}
    for k, t in enumerate(texts):
        assert out[k] == pytest.approx(plain(train, t, order))
    empty = score(asked.limit(1), fit(docs_of([]), order)).first()["score"]
    assert empty == pytest.approx(-8 * math.log10(256))


def test_edges(docs_of):
    rows = [(None, "no id"), (2, None), (3, ""), (4, "a b a"), (4, "a b a"), (6, "x" * 300_000), (7, "A\x0bB\x1cC")]
    df = docs_of(rows, score=("int", [1] * 7), rare=("int", [2] * 7), held_out=("int", [0] * 7))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in score_held_out(df).collect()), key=repr)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in brute_base(rows)), key=repr)
    assert score_held_out(docs_of([])).count() == 0


def test_adaptive(docs_of):
    out = {r["doc_id"]: r["score"] for r in adaptive_score(docs_of([(1, "ab" * 200), (2, "ab"), (3, None)])).collect()}
    assert out[1] > -40 and out[3] == pytest.approx(-math.log10(256))
    assert out[2] == pytest.approx(adaptive_log10(b"ab"))


def test_probabilities_sum_to_one():
    codes = [np.array([97, 98, 255], np.uint64), np.array([97 << 8 | 98, 98 << 8 | 97], np.uint64)]
    totals = [(np.array([0], np.uint64), np.array([12])), (np.array([97, 98], np.uint64), np.array([3, 4]))]
    trie = Trie(codes, [np.array([5, 4, 1]), np.array([3, 2])], totals)
    for context in (97, 98, 99):
        p = 10 ** trie.log10(np.array([context << 8 | s for s in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1)


def test_slots():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    table = Slots(codes)
    assert (table.find(codes) == np.arange(len(codes))).all()
    assert (table.find(codes + np.uint64(2**41)) == -1).all() and (Slots(codes[:0]).find(codes) == -1).all()
