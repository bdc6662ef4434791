"""How the inputs of classifier fits are dealt, and what a forest keeps."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors

from doctopics.operators import supervised


def test_fit_partitions_follow_filled_cells(spark):
    """40,000 wide but nearly empty rows take a few partitions, however wide; nothing is lost."""
    rows = spark.range(0, 40_000, 1, 16).rdd.map(
        lambda r: (r[0], "train" if r[0] % 5 else "test", float(r[0] % 2), Vectors.sparse(3000, [r[0] % 3000], [1.0]))
    )
    df = spark.createDataFrame(rows, ["doc_id", "split", "label_idx", "features"])
    train, test, n = supervised._split(df, "split")
    assert train.rdd.getNumPartitions() == supervised.FIT_PARTITIONS
    assert (train.count(), test.count(), n) == (32_000, 8_000, 32_000)
    train.unpersist()
    test.unpersist()


def test_forest_does_not_walk_its_trees_again():
    forest = supervised.clf_random_forest()
    assert forest.getCacheNodeIds() and forest.getNumTrees() == 100 and forest.getMaxDepth() == supervised.MAX_DEPTH
