"""What the Jaccard join reads again and again, and how much of it a worker is handed at a time."""
from pyspark.sql import functions as F

from doppel.llm import common, jaccard

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, base, base + " end", "other " * 3 + "text"] * 3 + [base.replace("w7 ", "x ")]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sets_of_pairs_are_read_without_joining_the_classes_again(spark, monkeypatch):
    plans, linked = [], jaccard._linked

    def spy(pairs, sets, percent):
        plans.append(sets._jdf.queryExecution().optimizedPlan().toString())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "_linked", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark)).collect()}
    assert got == {i: 3 if i % 4 == 3 else 0 for i in range(12)} | {12: 0}
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_batches_are_bounded_in_bytes_while_sets_are_made(spark, monkeypatch):
    seen, linked = [], jaccard._linked

    def spy(*args):
        seen.append(spark.conf.get(KEY, None))
        return linked(*args)

    monkeypatch.setattr(jaccard, "_linked", spy)
    before = spark.conf.get(KEY, None)
    jaccard.jaccard_components(documents(spark))
    assert seen == [str(jaccard.BATCH_BYTES)] * 2 and spark.conf.get(KEY, None) == before


def test_bounded_batches_hold_few_long_rows_and_keep_a_lower_bound_of_the_session(spark):
    def rows(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    long_rows = spark.range(0, 600, 1, 1).select(F.sequence(F.lit(1), F.lit(2000)).cast("array<long>").alias("h"))

    def largest():
        return long_rows.mapInArrow(rows, "n long, size long").agg(F.sum("n"), F.max("size")).first()

    with common.bounded_batches(spark, 1 << 20):
        n, size = largest()
        assert n == 600 and size <= (1 << 20) + 40_000
    spark.conf.set(KEY, "100000")
    try:
        with common.bounded_batches(spark, 1 << 20):
            assert spark.conf.get(KEY) == "100000" and largest()[0] == 600
        assert spark.conf.get(KEY) == "100000"
    finally:
        spark.conf.unset(KEY)
