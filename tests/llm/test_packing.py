"""Packing against the tokenizer itself, and the bins against a plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from doctopics.llm.packing import OpenBins, WordEncoder, pack_documents
from doctopics.llm.q_text import op1_best_fit_packing, tokenizer_path


def check(rows, texts, most=4096, waste=None):
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), most)):
            own = np.array(ids[a : a + most], "<u4")
            want.append((d, k, a, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    if waste is not None:
        assert len(places) <= waste + sum(r["length"] for r in rows) / most
    return len(places)


def test_query(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op1_best_fit_packing(spark, sf_dir).collect(), texts, waste=1.5)


def test_edges(docs_of):
    odd = "É́ ﬁ İstanbul don't WE'LL a<|endoftext|>b  x y \u0000 🙂🙂 it's\x1cok 12345 !!??\x85z Σίσυφος ΟΔΟΣ"
    texts = [(1, None), (2, ""), (3, " \n"), (None, "null id"), (4, odd), (4, odd), (5, "word " * 9000), (6, "x" * 50_000), (7, "\t" + odd)]
    rows = pack_documents(docs_of(texts, piece=("int", [9] * 9), _task=("int", [1] * 9)), tokenizer_path()).collect()
    check(rows, texts)
    assert pack_documents(docs_of([]), tokenizer_path()).count() == 0


def test_small_sequences_many_tasks(docs_of):
    rng = random.Random(1)
    texts = [(k, "the " * rng.randrange(90)) for k in range(2000)]
    tokens = sum(t.count("the") + 1 for _, t in texts)
    for bins, waste in ((16, 1.08), (128, 1.02)):
        df = pack_documents(docs_of(texts), tokenizer_path(), max_tokens=64, open_bins=bins, task_sequences=100)
        assert check(df.collect(), texts, most=64) <= waste * tokens / 64 + 15


def test_bins_follow_best_fit():
    rng = random.Random(2)
    bins, free = OpenBins(100, 10**6), {}
    for _ in range(3000):
        size = rng.randrange(1, 101)
        which, offset = bins.put(size)
        fits = [f for f in free.values() if f >= size]
        if fits:
            assert free[which] == min(fits)
        else:
            assert which not in free
        assert offset == 100 - free.get(which, 100)
        free[which] = free.get(which, 100) - size


def test_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.put(s)[0] for s in (6, 7, 8)] == [0, 1, 2]  # bin 1 had least free space and was closed
    assert bins.put(4)[0] == 0 and bins.put(3)[0] == 3


def test_words_have_the_tokenizers_ids():
    encoder = WordEncoder(tokenizer_path())
    assert encoder.plain
    rng = random.Random(4)
    letters = "abcdefgXYZ" + "".join(map(chr, range(0xC0, 0x250))) + "ßİıŉΣσ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", "***", "'", "!!", "'s", "n't", "_", "1"]) for _ in range(3000)]
    words += ["x" * 5000, "it's", "'sound", "(a)", "a-b", "é́", "<|endoftext|>", "a<|endoftext|>."]
    sizes, ids = encoder._ids(words)
    at = 0
    for word, n in zip(words, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids, word
        at += n
