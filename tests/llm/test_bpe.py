"""Forced-boundary BPE: against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import json
import random

import pyarrow as pa
import pytest

from doctopics.llm.bpe import BytePairs, decode_documents, encode_documents
from doctopics.llm.q_text import byte_tokenizer_path, op11_bpe_round_trip

PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "½", "!", "?", " ", "　"]
PARTS += ["<|endoftext|>", "<|endo", "日", "本", "🙂", "́", "İ", "'S", "\x00", "\x1c", "\x85", "​", "ß", "²", "٣", "֋", "\U000323b0"]
ODD = [None, "", "a" * 5000, "'" * 50, "é" * 3000, "日" * 1000, " " * 100, "\n" * 50 + "x", "'s", "don't 's ''s !'s 's's", "x<|endoftext|>", "<|endoftext|>" * 2]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokenizer_path())


@pytest.fixture(scope="module")
def own():
    with open(byte_tokenizer_path(), encoding="utf-8") as f:
        return BytePairs(f.read())


def test_ids_are_the_librarys(own, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(8000)] + ODD
    ids = own.encode(pa.array(texts))
    assert ids.to_pylist() == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.decode(ids).to_pylist() == [t or "" for t in texts]


def test_parts_of_characters_decode_like_the_library(own, library):
    rng = random.Random(2)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 40))] for _ in range(2000)]
    assert own.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == library.decode_batch(lists, skip_special_tokens=False)
    odd = pa.array([None, [-1, 99_999_999, 50256, None], []], pa.list_(pa.int32()))
    assert own.decode(odd).to_pylist() == ["", "<|endoftext|>", ""]


def test_cuts_are_certain(own, library):
    """A pair that is cut stands inside no token, and cuts do occur within words."""
    for token in list(library.get_vocab())[::97]:
        raw = own.table[library.token_to_id(token)].as_py()
        assert all(own.inside[a * 256 + b] for a, b in zip(raw, raw[1:]))
    assert not own.inside[ord("z") * 256 + ord("q")] and not own.inside.all()


def test_fragments_are_forgotten_at_the_bound(own, monkeypatch):
    monkeypatch.setattr("doctopics.llm.bpe.KNOWN_FRAGMENTS", 5)
    texts = pa.array([f"word{k} <|endoftext|>" for k in range(50)])
    first = own.encode(texts)
    assert first.equals(own.encode(texts)) and len(own.known) <= 5


def test_other_kinds_are_refused(own):
    with open(byte_tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        BytePairs(json.dumps(spec))


def test_columns(spark, docs_of, library):
    rows = [(k, t) for k, t in enumerate([*ODD, "twice", "twice"])] + [(None, "x y"), (0, "again")]
    df = docs_of(rows, ids=("int", [7] * len(rows)), Decoded=("int", [7] * len(rows)))
    out = decode_documents(encode_documents(df, byte_tokenizer_path()), byte_tokenizer_path())
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"}
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert encode_documents(docs_of([]), byte_tokenizer_path()).count() == 0


def test_query(spark, sf_dir, library):
    rows = {r["doc_id"]: r for r in op11_bpe_round_trip(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        expected = (d["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
        assert tuple(rows[d["doc_id"]]) == expected


def test_joined_ids(spark, docs_of, library):
    """The ids as text, with no list of them: the JVM then makes no string of every id."""
    texts = [*ODD, "two words", "x" * 3000]
    out = encode_documents(docs_of(list(enumerate(texts))), byte_tokenizer_path(), out=None, listed="listed")
    assert "ids" not in out.columns
    for r in out.collect():
        assert r["listed"] == ",".join(map(str, library.encode(r["text"] or "", add_special_tokens=False).ids))


def test_query_moves_no_lists(spark, sf_dir):
    plan = op11_bpe_round_trip(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan
