"""Steps that grow with the files deal out both sides of a join: their compressed files say
little of how large a side is, and a broadcast one goes through the driver whole."""

import factloom.plans.evidence  # registers its queries
from factloom.operators import graph
from factloom.plans.queries import QUERIES


def test_locked_chains_broadcasts_nothing(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1,), (2,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    plans, kept = [], graph.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(graph, "stored", seen)
    found = QUERIES["locked_chains"](spark, str(tmp_path))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plans[-1]
    assert not [p for p in plans if "BroadcastHashJoin" in p]
