"""Substring dedup against brute force."""

from __future__ import annotations

import pyarrow as pa

import hashlib
import random

import pytest

from doctopics.llm import substring_dedup as sd
from doctopics.llm.q_text import op8_substring_dedup
from doctopics.llm.substring_dedup import dedup_substrings, level_lengths


def brute(rows, size=13):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in docs:
        if i is not None:
            for k in range(len(words) - size + 1):
                w = tuple(words[k : k + size])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in docs:
        gone = set()
        if i is not None:
            for k in range(len(words) - size + 1):
                if first[tuple(words[k : k + size])] < i:
                    gone.update(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert key(result(op8_substring_dedup(spark, sf_dir))) == key(want)


@pytest.mark.parametrize("size", [2, 3, 13, 20, 29])
def test_edges_match_brute_force(docs_of, size):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(12)]
    phrase = [" ".join(f"p{j}x{k}" for k in range(30)) for j in range(3)]
    rows = [(None, phrase[0]), (1, None), (2, ""), (3, " \n\t "), (4, phrase[0]), (4, phrase[0] + " a"), (4, phrase[0])]
    rows += [(-5, "a b " + phrase[1]), (7, phrase[1] + " " + phrase[1]), (8, "x " + phrase[1].replace(" ", "\n") + " y")]
    rows += [(9, " ".join(["same"] * 40)), (10, " ".join(["same"] * 14)), (11, phrase[0].upper())]
    rows += [(20 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(40)]
    assert key(result(dedup_substrings(docs_of(rows), size))) == key(brute(rows, size))


def test_clashing_columns_and_texts(docs_of):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(1, text), (2, "before\n" + text), (3, "left  alone\n")]
    df = docs_of(rows, n_words=("string", ["a", "b", "c"]), seeds=("int", [1, 2, 3]), h=("int", [4, 5, 6]), _rest=("int", [7, 8, 9]))
    got = {r["doc_id"]: r for r in dedup_substrings(df).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == [text, "before", "left  alone\n"]
    assert [got[i]["n_words"] for i in (1, 2, 3)] == [20, 21, 2]
    assert [got[i]["seeds"] for i in (1, 2, 3)] == [1, 2, 3] and got[2]["_rest"] == 8


def test_empty_table_and_long_text(docs_of):
    assert dedup_substrings(docs_of([])).count() == 0
    long = " ".join(f"u{k}" for k in range(300_000))
    got = {r["doc_id"]: r["n_removed"] for r in dedup_substrings(docs_of([(1, "a " + long), (2, long)])).collect()}
    assert got == {1: 0, 2: 300_000}


def test_passage_in_many_documents(docs_of):
    passage = " ".join(f"c{k}" for k in range(50))
    rows = [(k, f"a{k} b{k} {passage} z{k}") for k in range(400)]
    got = result(dedup_substrings(docs_of(rows)))
    assert sum(r[2] for r in got) == 399 * 50


def test_levels_double_until_nothing_survives(docs_of):
    """50 words take four lengths; passages of 49 words survive three of them and are kept."""
    assert [level_lengths(n) for n in (2, 3, 13, 14, 15, 50)] == [[1], [2], [7], [7], [7, 14], [7, 14, 28]]
    long, short = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("l", 60), ("s", 49)))
    rows = [(k, f"a{k} {long} b{k}") for k in range(3)] + [(10 + k, f"c{k} {short} d{k}") for k in range(3)] + [(20, "x " * 80), (21, short[:80])]
    got = result(dedup_substrings(docs_of(rows), 50))
    assert key(got) == key(brute(rows, 50)) and sum(r[2] for r in got) == 120
    assert key(result(dedup_substrings(docs_of(rows[3:]), 50))) == key(brute(rows[3:], 50))
    alone = [(k, " ".join(f"u{k}x{j}" for j in range(70))) for k in range(4)]
    assert sum(r[2] for r in result(dedup_substrings(docs_of(alone), 50))) == 0


def test_candidates_travel_short():
    """Hashes of the levels before the last take SEED_BITS; the last level's are whole."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = pa.record_batch([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    seeds = next(sd._first(13, 7)(iter([docs]))).column("h").to_numpy()
    assert len(seeds) > 50 and 0 <= seeds.min() and seeds.max() < 1 << sd.SEED_BITS
    packed = next(sd._pack_text(iter([docs.append_column("_rest", pa.array([0]))])))
    marked = packed.append_column("seeds", pa.array([seeds.tolist()], pa.list_(pa.int64())))
    whole = next(sd._next(13, 7, 13)(iter([marked]))).column("w").to_numpy()
    assert len(whole) == 400 - 13 + 1 and (whole.view("uint64") >= 1 << sd.SEED_BITS).any()
    short = next(sd._next(50, 7, 14)(iter([marked]))).column("w").to_numpy()
    assert not len(short) or short.max() < 1 << sd.SEED_BITS
