"""The pipeline's stages on the small tables: each one's decisions take effect on its input."""
import corpus_pipeline
from doppel.llm import langid, simhash


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs.count()
        if k < 4:
            assert docs.columns == columns
    assert seen["language ID"] == 200  # clean documents stay
    assert 0 < seen["SimHash near-dedup"] <= seen["line dedup"] <= 200
    assert before.count() == docs.select("doc_id", "start").where("start = 0").count()


def test_language_stage_rejects_what_has_no_letters(spark):
    rows = [(i, "the cat and the dog ran", "en", "s", 1) for i in range(20)]
    rows += [(20 + i, "der Hund und die Katze", "de", "s", 1) for i in range(20)] + [(99, "12 34", None, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, df, "")
    assert 99 not in {r["doc_id"] for r in kept.collect()} and kept.count() == 40
    assert langid.UNDETERMINED == "und" and simhash.MAX_BITS == 4
