from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from ``(doc_id, text)`` pairs; other columns as in the driver's table, plus any given."""

    def make(rows, **more):
        names = "".join(f", {k} {v[0]}" for k, v in more.items())
        data = [
            (i, t, "en", f"src{k % 3}", None if t is None else len(t), *[v[1][k] for v in more.values()])
            for k, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long{names}")

    return make
