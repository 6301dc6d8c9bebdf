"""Driver contract: entry(), queries() and oracle_sql() line up; oracles agree at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = ["preprocess_text", "document_stats", "tokens_tf", "vocabulary", "tfidf_vectors",
        "similar_pairs_tfidf", "topk_tfidf", "cluster_sizes", "exact_matches", "hash_embeddings",
        "similar_pairs_embedding", "corpus_upsert", "document_lookup", "admission"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["doc1", "doc2", "similarity"]
    assert df.count() == 27


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).fetchdf()
    assert rows_of(got) == rows_of(exp)
