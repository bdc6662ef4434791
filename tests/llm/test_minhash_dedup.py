"""Near-duplicate classes against all pairs, signatures against similarity."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from doctopics.llm.minhash_dedup import components, dart_minhash, drop_near_duplicates, near_duplicate_classes, shingles
from doctopics.llm.q_text import op2_minhash_dedup


def sets(rows, size=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().split()
        n = min(size, len(w))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    return out


def brute(rows, similarity=0.8):
    """Smallest id of the class of each row."""
    s = sets(rows)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in df.collect()), key=repr)


def test_query_matches_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(a != b for a, b in want)
    assert got(op2_minhash_dedup(spark, sf_dir)) == want


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_large_group_of_chained_copies(docs_of):
    """Many copies of which most pairs lie below the threshold, and copies that only touch through others."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, edited(rng, base, rng.randrange(0, 9))) for k in range(500)]
    text = [f"c{k}" for k in range(200)]
    for k in range(40):  # a chain: each is the one before with two words changed
        rows.append((1000 + k, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(2000 + k, shared + " " + " ".join(f"q{k}x{j}" for j in range(60))) for k in range(300)]
    rng.shuffle(rows)
    assert got(near_duplicate_classes(docs_of(rows))) == brute(rows)


def test_edges(docs_of):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "only here"), (5, None), (6, ""), (7, " \n"), (8, "hi"), (9, "hi")]
    rows += [(10, "a b c d"), (11, "a b c"), (3, "a b c d e f"), (3, "something else altogether is in here")]
    df = docs_of(rows, node=("string", ["n"] * len(rows)), class_id=("int", [1] * len(rows)))
    out = near_duplicate_classes(df).collect()
    by = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in out), key=repr)
    want = [(None, 3, 3), (None, None, 1), (10, 10, 1), (11, 11, 1), (3, 3, 3), (3, 3, 3), (3, 3, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1)]
    assert by == sorted(want + [(8, 8, 2), (9, 8, 2)], key=repr)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 9
    assert near_duplicate_classes(docs_of([])).count() == 0


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    values = rng.integers(1, 2**63, 400, dtype=np.uint64)
    x = {v: float(w) for v, w in zip(values[:300].tolist(), rng.uniform(0.2, 3, 300), strict=True)}
    y = {v: x.get(v, 1.5) * (1 if i % 3 else 0.5) for i, v in enumerate(values[40:330].tolist())}
    keys = [sorted(d) for d in (x, y)]
    sig = dart_minhash(
        np.array(sum(keys, []), np.uint64), np.array([d[v] for d, k in zip((x, y), keys, strict=True) for v in k]), np.array([0, len(x), len(x) + len(y)]), 4000
    )
    union = set(x) | set(y)
    true = sum(min(x.get(v, 0), y.get(v, 0)) for v in union) / sum(max(x.get(v, 0), y.get(v, 0)) for v in union)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    assert (sig != 0).all()


def test_shingles_are_sets_of_words():
    values, counts, offs = shingles(pa.array(["a b c d e a b c d e", None, "x", "a b c d e"]), 5)
    assert np.diff(offs).tolist() == [5, 0, 1, 1] and sorted(counts[:5].tolist()) == [1, 1, 1, 1, 2]


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    out = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 150)}}
