"""Representatives of equal vectors are picked without a shuffle of the vectors."""
from pyspark.sql import functions as F

from doppel.operators import simjoin


def picked(spark):
    rows = [(i, [1, 2, 3 + i % 4], [0.5, 0.5, 0.7]) for i in range(40)] + [(40, [], [])]
    vecs = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large for Spark to choose it
    try:
        reps, members = simjoin.collapse_copies(vecs)
        plan = reps._jdf.queryExecution().sparkPlan().toString()
        found = sorted(r["doc_id"] for r in reps.collect())
        groups = sorted(tuple(r) for r in members.groupBy("rep").agg(F.count("*")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == [0, 1, 2, 3] and groups == [(i, 10) for i in range(4)]
    return plan


def test_vectors_stay_where_they_are(spark):
    assert "BroadcastHashJoin" in picked(spark)


def test_many_representatives_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "REPS_ROWS", 3)
    assert "BroadcastHashJoin" not in picked(spark)
