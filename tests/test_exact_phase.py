"""The exact phase of a duplicate check hashes the texts in one pass and shuffles none."""
from pyspark.sql import functions as F

from doppel.operators.dedup import duplicate_hits, exact_matches
from doppel.operators.tfidf import fit_tfidf

BASE = [(1, "one two three four"), (2, "five six seven eight"), (3, "one two three four"), (4, None), (5, " padded ")]


def tables(spark):
    docs = spark.createDataFrame(BASE, "doc_id long, content string")
    new = spark.createDataFrame([(10, " one two three four "), (11, "nothing like it"), (12, None), (13, "padded")],
                                "doc_id long, content string")
    return docs, new


def test_no_text_meets_in_the_join(spark):
    docs, new = tables(spark)
    found = exact_matches(new, docs)
    assert [tuple(r) for r in found.collect()] == [(10, 1)]
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "content" not in plan.left().output().mkString() + plan.right().output().mkString()


def test_corpus_texts_are_read_in_one_pass(spark):
    docs, new = tables(spark)
    model = fit_tfidf(docs.where("content is not null"), min_df=1, max_df=1.0)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    told = docs.coalesce(1).select("doc_id", seen("content").alias("content"))
    hits = duplicate_hits(new, told, model).collect()
    assert {(r["doc_id"], r["id"]) for r in hits} == {(10, 1), (13, 5)}
    assert read.value <= 2 * len(BASE)  # one pass, which may ask for a text again to see that it isn't null
