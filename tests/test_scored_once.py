"""Queries that spread a computed array over rows compute it once; a plain explode filters by its size and computes it again."""

from __future__ import annotations

import pytest

from doctopics.plans import model_queries

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, value", [("pca_fit", "score"), ("doc_topic_dist", "p")])
def test_scored_once(spark, name, value):
    rows = getattr(model_queries, name)(spark, TINY)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") + plan.count("+- *ArrowEvalPython") <= 1
    assert rows.filter(f"{value} IS NULL").count() == 0
