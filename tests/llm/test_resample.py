"""Importance resampling: against brute force, and the drawn documents against the ranks."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from doctopics.llm.q_text import op13_importance_resampling
from doctopics.llm.resample import draw_documents, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target, percent=25, buckets=10_000, seed="7", min_words=20):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = (Counter(bucket(g) for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {k: math.floor(1000 * math.log(((t[k] + 1) * all_s) / ((s[k] + 1) * all_t))) for k in range(buckets)}
    out, eligible = [], []
    for d, text in rows:
        words, own = grams(text)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, None])
        if words >= min_words:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    df = op13_importance_resampling(spark, sf_dir)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    assert result(df) == brute(rows, target)


PROSE = " ".join(f"Wörd{k % 17} x{k}" for k in range(40))
ROWS = [(1, PROSE), (2, PROSE + " more"), (3, None), (4, ""), (5, " \n\t.,"), (None, PROSE), (None, PROSE), (6, "A-b_C.d'E " * 9)]
ROWS += [(2, PROSE + " more"), (7, " ".join(f"u{k}" for k in range(40_000))), (8, "日本 é́ \U0001f642 " * 30), (9, "one"), (-5, "x" * 70_000)]
ROWS += [(k, f"t{k} " * 25 + PROSE[: 8 * k]) for k in range(10, 40)]


@pytest.mark.parametrize("percent,target", [(25, ["wörd1 x1 Wörd2", None, ""]), (100, []), (0, ["x"]), (60, [PROSE] * 3)])
def test_edges(spark, docs_of, percent, target):
    df = docs_of(ROWS, rank=("int", [1] * len(ROWS)), _weighed=("int", [1] * len(ROWS)), score=("int", [1] * len(ROWS)))
    wanted = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    got = importance_resample(df, wanted, percent=percent, buckets=97)
    expected = brute(ROWS, target, percent, 97)
    assert result(got) == expected
    drawn = draw_documents(df, wanted, percent=percent, buckets=97)
    assert drawn.columns == df.columns
    ids = Counter(d for d, *_, rank in expected if rank is not None)
    seen = Counter(r["doc_id"] for r in drawn.collect())
    assert set(seen) == set(ids) and all(seen[d] >= n for d, n in ids.items())
    assert importance_resample(docs_of([]), wanted).count() == 0


def test_one_weight_for_all(spark, docs_of):
    """Equal texts have equal weights; noise alone ranks them, and ties go to smaller ids."""
    rows = [(k, PROSE) for k in range(3000)]
    assert result(importance_resample(docs_of(rows), docs_of([]))) == brute(rows, [])
