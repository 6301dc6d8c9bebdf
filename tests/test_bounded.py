"""What a duplicate check holds: small cached batches, one encoder run, one Python worker a step, small rows."""
import numpy as np
from pyspark.sql import functions as F

from doppel.operators import embeddings as E
from doppel.operators.simjoin import threshold_join
from doppel.session import BATCH_BYTES, CACHED_ROWS, bound_batches, keep

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_kept_tables_are_objects_in_small_batches(spark):
    kept = keep(spark.range(4 * CACHED_ROWS, numPartitions=1).toDF("i"))
    kept.count()
    assert kept.storageLevel.useMemory and kept.storageLevel.useDisk and kept.storageLevel.deserialized
    held = kept._jdf.queryExecution().withCachedData().cacheBuilder().cachedColumnBuffers()
    assert held.count() == 4  # before: one batch, and Java's serialization kept the last 100 of them alive
    assert spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize") == "10000"


def test_the_corpus_is_encoded_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(i):
        runs.add(1)
        return [1.0, float(i)]

    corpus = spark.range(50, numPartitions=2).select(F.col("id").alias("doc_id"), encode.asNondeterministic()("id").alias("embedding"))
    new = spark.createDataFrame([(100, [1.0, 3.0])], "doc_id long, embedding array<double>")
    got = E.embedding_hits(new, corpus, 0.999, best=5).collect()
    assert {r["id"] for r in got} >= {3} and runs.value == 50  # before: four times as many


def test_texts_are_encoded_by_one_worker_and_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "")], "doc_id long, content string")
    unit = E._unit(E.hash_embeddings(docs, dim=16), "doc_id", "embedding")
    plan = unit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan and unit.count() == 1


def test_a_product_that_is_the_threshold_is_a_hit(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[4, 3] + [0] * 62, [1, 0] + [0] * 62, [24, 7] + [0] * 62, [0, 5] + [0] * 62])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for t, want in ((0.8, {(0, 1), (0, 2), (1, 2)}), (0.96, {(1, 2)}), (0.6, {(0, 1), (0, 2), (0, 3), (1, 2)})):
        assert {(r["a"], r["b"]) for r in E.embedding_threshold_join(emb, None, t).collect()} == want


def test_arrow_batches_are_bounded_unless_the_caller_did(spark):
    before = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY)
        bound_batches(spark)
        assert spark.conf.get(KEY) == str(BATCH_BYTES)
        spark.conf.set(KEY, "1234567")
        bound_batches(spark)
        assert spark.conf.get(KEY) == "1234567"
    finally:
        spark.conf.set(KEY, before)


def test_several_blocks_a_partition_lose_no_pair(spark, monkeypatch):
    from doppel.operators import simjoin as sj
    monkeypatch.setattr(sj, "PACKED_ROWS", 8)
    monkeypatch.setattr(sj, "LEAST_ROWS", 8)
    monkeypatch.setattr(sj, "FEW_BLOCKS", 2)
    rng = np.random.default_rng(5)
    mat = rng.random((120, 6)) * (rng.random((120, 6)) < 0.6) + np.eye(6)[rng.integers(6, size=120)]
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    rows = [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(mat)]
    vectors = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")
    order = spark.range(6).selectExpr("int(id) as term_id", "int(id) as order_rank")
    got = [(r["a"], r["b"]) for r in threshold_join(vectors, None, order, 0.7, dense_ratio=0.0).collect()]
    sims = mat @ mat.T
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(sims >= 0.7)) if i < j}


def test_a_task_of_kmeans_hands_on_one_model_at_a_time():
    from doppel.operators.clusters import _handed_on
    sums, counts = np.arange(24.0).reshape(3, 8), np.array([[1, 2], [3, 0], [0, 0]])
    far = [(0.5, np.array([1]), np.array([2.0])), (-1.0, None, None), (-1.0, None, None)]
    got = [b.to_pylist() for b in _handed_on(sums, counts, np.ones(3), far, 7)]
    assert [(r["model"], r["cluster"], r["n"]) for b in got for r in b] == [
        (0, 2, 0), (0, -1, 0), (0, 0, 1), (0, 1, 2), (1, 2, 0), (1, 0, 3), (2, 2, 0)]
    assert len(got) == 3 and got[0][2]["terms"] == [1, 2, 3] and got[1][1]["sums"] == [8.0, 9.0, 10.0, 11.0]
