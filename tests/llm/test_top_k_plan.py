"""Blocks of queries, repeated for all blocks of rows, must not be gathered on the driver."""

import numpy as np

from gridloom.llm import topk


def test_top_k_broadcasts_no_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.random(4).tolist()) for i in range(200)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=4, row_block=40)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
