"""The vector index over more vectors than it learns from, and over copies."""

import numpy as np
import pandas as pd
import pytest

from siftwell.plans import load_plans


@pytest.mark.parametrize("n, copies", [(60_000, 1), (400, 60)])
def test_recall_is_reached(spark, tmp_path, n, copies):
    x = np.random.default_rng(7).normal(size=(n, 64)).astype(np.float32)
    x = np.tile(x, (copies, 1))
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), dtype=np.int32)}).to_parquet(tmp_path / "embeddings.parquet")
    row = load_plans()["vector_index_search"].run(spark, str(tmp_path)).first()
    assert (row.vectors, row.found) == (len(x), 10 * row.queries)
    assert row.recall_reached and row.scores_are_exact
