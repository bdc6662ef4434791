"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate as decontaminate
from tests.llm import test_minhash_dedup as near
from tests.llm import test_packing as packing
from tests.llm import test_quality as quality
from tests.llm import test_substring_dedup as substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).persist()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for name, (_, after) in stages.items():
        assert name == "packing" or after.columns == COLUMNS


def test_quality(spark, sf_dir, stages):
    before, after = stages["quality"]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    markers, limit = quality.brute_markers(pairs(before), labels)
    toxic = {d for d, t in pairs(before) if sum(markers.get(g, 0.0) for g in quality.all_grams(t)) > limit}
    kept = {r[0] for r in quality.brute(pairs(before), trusted, 1 << 16) if r[7]} - toxic
    assert {d for d, _ in pairs(after)} == kept and 0 < len(kept) < before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    classes = near.brute(pairs(before))
    assert sorted(d for d, _ in pairs(after)) == sorted({c for _, c in classes})
    assert set(pairs(after)) <= set(pairs(before))


def test_substring(stages):
    before, after = stages["substring_dedup"]
    want = {r[0]: r for r in substring.brute(pairs(before))}
    texts = dict(pairs(before))
    assert {d for d, _ in pairs(after)} == {d for d, r in want.items() if not r[2] or r[2] < r[1]}
    for r in after.collect():
        _, n, gone, digest = want[r["doc_id"]]
        words = r["text"].encode().split()
        assert len(words) == n - gone and substring.hashlib.sha256(b" ".join(words)).hexdigest() == digest
        assert r["text"] == texts[r["doc_id"]] if not gone else r["n_chars"] == len(r["text"])


def test_decontamination(spark, sf_dir, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r[0] for r in decontaminate.brute(pairs(before), items) if not r[5]]
    assert sorted(d for d, _ in pairs(after)) == sorted(clean) and len(clean) < before.count()


def test_packing(stages):
    before, after = stages["packing"]
    packing.check(after.collect(), pairs(before), waste=1.5)


def test_run_and_edges(spark, docs_of, tmp_path, sf_dir):
    rng = random.Random(3)
    prose = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(prose)) + [(100, None), (None, prose[0] + " tail"), (101, ""), (102, "### " * 50), (3, prose[3]), (103, "long " + " ".join(f"v{k}" for k in range(20_000)))]
    docs_of(rows, kept=("int", [1] * len(rows))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= set(range(40)) and not {r["doc_id"] for r in out} & {100, 101, 102}
    empty = tmp_path / "empty"
    docs_of([]).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
