"""Memory at size: what a task holds."""

import pandas as pd

from stepweave.sources import code


def test_facts_of_a_batch_come_in_bounded_frames():
    text = "\n".join(f"class P{k}(nn.Module):\n    def forward(self, x):\n        return x" for k in range(10))
    files = pd.DataFrame({"code_id": "c", "path": [f"f{i}.py" for i in range(1500)], "basename": "b", "content": text})
    sizes = [len(f) for f in code._fact_batches(iter([files]))]
    assert sum(sizes) == 1500 * 20 and max(sizes) <= 5_000


def test_stacks_are_dealt_once(spark):
    from workload.views import spark_view

    plan = spark_view(spark, "/root/testdata/sf0.001", "stack_text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # by order; lines, traces and stacks of a kernel follow in the task


def test_edges_between_few_nodes_are_not_dealt_by_these_nodes(spark):
    import re

    from pyspark.sql import functions as F

    from stepweave.graph import edges

    many = spark.range(3000).select(F.lit("g").alias("graph_id"), (F.col("id") % 2).alias("src_id"), (F.col("id") % 3 + 10).alias("dst_id"), F.col("id").alias("edge_ord"))
    bundles = edges.edge_bundles(many, 100)
    got = {(r["source_fanout"], r["target_fanin"], r["bundle_total"]) for r in bundles.collect()}
    assert got == {(1500, 1000, 500)} and bundles.filter("bundle_index < 0 or bundle_index > 499").isEmpty()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", bundles._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("src_id" in d and "dst_id" in d for d in dealt)  # never by one end alone
