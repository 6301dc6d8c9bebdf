"""S1 file form, S3-S8 artifacts, F6 lookup."""
import os

from pyspark.sql import functions as F

from doppel.plans.corpus_ops import Corpus, load_model, lookup_documents, save_model
from doppel.sources.corpus import read_corpus_dir, read_text_dir


def test_read_text_dir(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "good.txt").write_bytes("Hello World!".encode())
    (d / "bad.txt").write_bytes(b"a \xff b")
    (d / "onlybad.txt").write_bytes(b"\xff\xfe\xfd")
    (d / "blank.txt").write_bytes(b"  \n\t ")
    (d / "hash.txt").write_bytes(b"###")
    (d / "a b.c.txt").write_bytes(b"Spaces in name")
    (d / "p+q.txt").write_bytes(b"plus")
    (d / "upper.TXT").write_bytes(b"not matched")
    (d / "empty.txt").write_bytes(b"")
    got = {r["doc_id"]: r["content"] for r in read_corpus_dir(spark, str(d)).collect()}
    assert got == {"good": "hello world!", "bad": "a b", "hash": "", "a b.c": "spaces in name",
                   "p+q": "plus"}
    strict = {r["doc_id"]: r["valid_utf8"] for r in read_text_dir(spark, str(d), strict_utf8=True).collect()}
    assert strict["bad"] is False and strict["good"] is True
    assert read_corpus_dir(spark, str(tmp_path / "missing")).count() == 0


def test_artifacts_roundtrip_and_build_or_load(spark, small_model, tmp_path):
    docs, m = small_model
    root = str(tmp_path / "art")
    save_model(m, root)
    back = load_model(spark, root)
    assert back.n_docs == m.n_docs and back.vocab_size == m.vocab_size
    assert back.vectors.exceptAll(m.vectors.select(back.vectors.columns)).count() == 0
    assert load_model(spark, str(tmp_path / "none")) is None
    c = Corpus.build_or_load(spark, docs, str(tmp_path / "state"), cluster=False)
    st = c.status().first()
    assert st["documents"] == st["tfidf_vectors"] == 200 and st["clusters"] == 0
    assert not st["clusters_loaded"]


def test_lookup(spark, small_model):
    docs, _ = small_model
    ids = spark.createDataFrame([(0,), (999999,)], "doc_id long")
    got = {r["doc_id"]: r["found"] for r in lookup_documents(docs, ids).collect()}
    assert got == {0: True, 999999: False}


def test_similar_documents_not_found(spark, small_model):
    docs, m = small_model
    c = Corpus(docs, m)
    ids = spark.createDataFrame([(0,), (999999,)], "doc_id long")
    res = c.similar_documents(ids, method="tfidf", threshold=0.3, limit=5).collect()
    assert any(r["status"] == "not_found" and r["query_document_id"] == 999999 for r in res)
    import pytest
    with pytest.raises(ValueError):
        c.similar_documents(ids, method="bm25")


def test_read_incoming_statuses(spark, tmp_path):
    from doppel.sources.corpus import read_incoming
    d = tmp_path / "new"
    d.mkdir()
    (d / "fresh.txt").write_bytes(b"  A brand NEW text!  ")
    (d / "taken.txt").write_bytes(b"whatever")
    (d / "broken.txt").write_bytes(b"bad \xff byte")
    req = spark.createDataFrame([("fresh",), ("taken",), ("broken",), ("ghost",)], "doc_name string")
    corpus = spark.createDataFrame([("taken", "x")], "doc_id string, content string")
    got = {r["doc_id"]: (r["status"], r["content"]) for r in read_incoming(spark, str(d), req, corpus).collect()}
    assert got == {"fresh": ("ok", "a brand new text!"), "taken": ("exists", None),
                   "broken": ("invalid", None), "ghost": ("not_found", None)}


def test_admitted_documents_survive_a_reload(spark, small_model, tmp_path):
    from doppel.operators.embeddings import hash_embeddings
    docs, m = small_model
    root = str(tmp_path / "state")
    c = Corpus.create(docs, m, hash_embeddings).save(root)
    old = docs.first()
    batch = spark.createDataFrame([(90001, "zebra quartz violin harbor " * 5, 1), (90002, old["content"], 2),
                                   (90003, old["content"], 3), (90003, "crimson lantern orbit", 4),
                                   (old["doc_id"], "whatever", 5)], "doc_id long, content string, arrival int")
    _, status = c.admit(batch, root, recluster=False)
    got = {(r["doc_id"], r["occurrence"]): r["status"] for r in status.collect()}
    assert got == {(90001, 1): "accepted", (90002, 1): "duplicate", (90003, 1): "duplicate",
                   (90003, 2): "accepted", (old["doc_id"], 1): "exists"}
    again = Corpus.build_or_load(spark, docs, root, cluster=False, embed=hash_embeddings)
    assert again.version == 2
    text = {r["doc_id"]: r["content"] for r in again.documents.where("doc_id > 90000").collect()}
    assert set(text) == {90001, 90003} and text[90003] == "crimson lantern orbit"
    for table in (again.model.vectors, again.embeddings):
        assert table.where("doc_id > 90000").count() == 2 and table.count() == 202
    import pytest
    with pytest.raises(RuntimeError, match="in force"):  # a second process that still holds version 1
        c.refresh(batch.limit(1), root, recluster=False)
    assert Corpus.load(spark, root).version == 2


def test_similar_documents_has_one_schema_without_embeddings(spark, small_model):
    docs, m = small_model
    ids = spark.createDataFrame([(0,), (999999,)], "doc_id long")
    plain = Corpus(docs, m).similar_documents(ids, "embedding", 0.5, 5)
    assert plain.columns == Corpus(docs, m).similar_documents(ids, "tfidf", 0.5, 5).columns
    assert [(r["query_document_id"], r["status"]) for r in plain.collect()] == [(999999, "not_found")]
