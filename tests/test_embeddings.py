"""P7, J4, J5, M4."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from doppel.operators.embeddings import (cosine_embedding, cosine_tfidf_dense, hash_embeddings,
                                         similar_embedding_pairs, similarity_matrix)

SF = "/root/testdata/sf0.001"


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 2.0]), (2, [1.0, 0.0], [-1.0, 0.0]),
                                (3, [1.0, 2.0], [2.0, 4.0])], "id int, a array<double>, b array<double>")
    got = {r["id"]: (r["e"], r["t"]) for r in
           df.select("id", cosine_embedding(F.col("a"), F.col("b")).alias("e"),
                     cosine_tfidf_dense(F.col("a"), F.col("b")).alias("t")).collect()}
    assert got[1] == (0.0, 0.0)
    assert got[2][0] == pytest.approx(-1.0) and got[2][1] == 0.0  # tfidf flavour clamps
    assert got[3][0] == pytest.approx(1.0) and got[3][1] == pytest.approx(1.0)
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert bad.select(cosine_tfidf_dense(F.col("a"), F.col("b"))).first()[0] == 0.0
    with pytest.raises(Exception):
        bad.select(cosine_embedding(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("t", [0.2, 0.35])
def test_embedding_pairs_equal_brute_force(spark, t):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    ids = np.array([r["vec_id"] for r in rows])
    mat = np.array([r["embedding"] for r in rows], dtype=np.float64)
    mat = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    sims = mat @ mat.T
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids))
            if ids[i] < ids[j] and sims[i, j] >= t}
    got = {(r["doc1"], r["doc2"]) for r in similar_embedding_pairs(e, t, cell_rows=64).collect()}
    assert got == want


def test_similarity_matrix_shape(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(30)
    m = similarity_matrix(e, cell_rows=8)
    assert m.count() == 900
    assert m.where("i = j").agg(F.min("similarity")).first()[0] == pytest.approx(1.0)


def test_hash_embeddings_unit_norm(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "")], "doc_id long, content string")
    got = {r["doc_id"]: r["embedding"] for r in hash_embeddings(docs, dim=16).collect()}
    assert len(got[1]) == 16 and abs(np.linalg.norm(got[1]) - 1) < 1e-12
    assert not any(got[2])


@pytest.mark.parametrize("lookup", [200_000, 0])
def test_idf_embeddings_equal_plain_hashing(spark, small_model, monkeypatch, lookup):
    import hashlib

    from doppel.operators import embeddings as E
    monkeypatch.setattr(E, "LOOKUP_ROWS", lookup)
    docs, m = small_model
    places = {}
    for r in m.vocabulary.select("term", "term_id").collect():
        h = int(hashlib.md5(r["term"].encode()).hexdigest()[:8], 16)
        places[r["term_id"]] = h % 48, -1 if h // 48 % 2 else 1
    extra = spark.createDataFrame([(10**6, [], [])], "doc_id long, term_ids array<int>, weights array<double>")
    vectors = m.vectors.unionByName(extra)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in E.idf_embeddings(vectors, m.vocabulary, 48).collect()}
    assert len(got) == vectors.count() and not got[10**6].any()
    for r in m.vectors.collect():
        v = np.zeros(48)
        for t, w in zip(r["term_ids"], r["weights"]):
            v[places[t][0]] += places[t][1] * w
        assert np.allclose(got[r["doc_id"]], v / (np.linalg.norm(v) or 1.0))


def test_idf_encoder_tells_texts_apart(spark, small_model):
    from doppel.operators.embeddings import idf_encoder
    docs, m = small_model
    given = spark.read.parquet(f"{SF}/documents.parquet").count()
    few = similar_embedding_pairs(idf_encoder(m)(docs).withColumnRenamed("doc_id", "vec_id"), 0.8).count()
    many = similar_embedding_pairs(hash_embeddings(docs).withColumnRenamed("doc_id", "vec_id"), 0.8).count()
    assert few < many / 10 and few < given


def test_zero_vectors_qualify_at_a_threshold_of_zero(spark):
    from doppel.operators.embeddings import embedding_hits
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.6, 0.8])]
    emb = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    hits = {(r["query_document_id"], r["id"]): round(r["similarity"], 6)
            for r in embedding_hits(emb, emb, 0.0).collect()}
    assert hits == {(1, 2): 0.0, (1, 4): 0.6, (2, 1): 0.0, (2, 3): 0.0, (2, 4): 0.0, (3, 2): 0.0,
                    (4, 1): 0.6, (4, 2): 0.0}
    assert embedding_hits(emb, emb.limit(0), -1.0).count() == 0


def clustered(spark, n=1500, dim=32, groups=40):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, dim))
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("t", [-1.0, 0.0, 0.3, 0.8])
@pytest.mark.parametrize("pivots", [None, 25])
def test_blocks_and_bounds_lose_nothing(spark, t, pivots):
    from doppel.operators.embeddings import embedding_threshold_join
    v, emb = clustered(spark, n=300)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    got = embedding_threshold_join(emb, None, t, n_pivots=pivots, cell_rows=32).collect()
    want = {(i, j) for i, j in zip(*np.nonzero(sims >= t)) if i < j}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert max((abs(r["similarity"] - sims[r["a"], r["b"]]) for r in got), default=0) < 1e-9
    part = emb.where("vec_id < 20")
    got = embedding_threshold_join(part, emb, t, n_pivots=pivots, cell_rows=32).collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i, j in zip(*np.nonzero(sims >= t)) if i < 20 and i != j}


def test_share_of_pairs_that_are_scored(spark):
    from doppel.operators.embeddings import scored_share
    _, emb = clustered(spark)
    low, high = (scored_share(emb, t, cell_rows=64).first() for t in (0.2, 0.8))
    assert high["pairs"] == 1500 * 1499 // 2 and high["scored"] < 0.25 * high["pairs"]
    assert high["met"] <= low["met"]
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = scored_share(given, 0.8).first()
    assert got["scored"] < 0.2 * got["pairs"]


@pytest.mark.parametrize("t", [-1.0, 0.0, 0.5])
@pytest.mark.parametrize("limit", [0, 1, 6])
def test_top_hits_of_equal_vectors_equal_brute_force(spark, t, limit):
    from doppel.operators.search import top_embedding_hits
    kinds = [[3.0, 4.0], [4.0, 3.0], [-1.0, 0.0], [0.0, 0.0], [6.0, 8.0]]  # the first and last have one direction
    kind = [1, 2, 3, 4, 1, 3] + [0] * 60 + [4, 4, 2]
    v = np.array([kinds[k] for k in kind])
    n = np.linalg.norm(v, axis=1)
    sims = np.divide(v @ v.T, np.outer(n, n), out=np.zeros((len(v), len(v))), where=np.outer(n, n) > 0)
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
    for queries in (set(range(len(v))), {0, 3, 7, 8, 66}):
        want = set()
        for q in queries:
            hits = sorted((-round(sims[q, j], 4), j) for j in range(len(v)) if j != q and sims[q, j] >= t - 1e-12)
            want |= {(q, j, -s, k + 1) for k, (s, j) in enumerate(hits[:limit])}
        got = top_embedding_hits(emb.where(F.col("doc_id").isin(*queries)), emb, t, limit).collect()
        assert {(r["query_document_id"], r["id"], r["similarity_score"], r["rank"]) for r in got} == want
        assert len(got) == len(want)


def test_top_hits_of_equal_vectors_are_linear(spark):
    from doppel.operators.search import top_embedding_hits
    emb = spark.range(20_000).selectExpr("id as doc_id", "array(0.6D, 0.8D) as embedding")
    assert top_embedding_hits(emb, emb, 0.5, 3).count() == 60_000  # not 400 million pairs


def test_ids_of_two_types_meet_as_texts(spark):
    from doppel.operators.embeddings import embedding_hits
    left = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<double>")
    right = spark.createDataFrame([("a", [1.0, 0.1]), ("1", [1.0, 0.0])], "doc_id string, embedding array<double>")
    got = {(r["query_document_id"], r["id"]) for r in embedding_hits(left, right, 0.9, exclude_same_id=False).collect()}
    assert got == {("1", "a"), ("1", "1")}


def test_an_encoder_gets_few_rows_at_a_time(spark):
    from doppel.operators import embeddings as E

    def encode(pdf):
        return np.full((len(pdf), 2), float(len(pdf)))

    rows = E.encode_with(spark.range(3000).coalesce(1).withColumnRenamed("id", "doc_id"), encode).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert max(r["embedding"][0] for r in rows) <= E.ENCODE_ROWS  # before: all 3,000


def test_terms_are_hashed_as_sql_does(spark):
    from doppel.operators import embeddings as E
    terms = ["alpha", "beta", "zz", "gamma", "the"]
    h = E._term_hash(F.col("t"))
    want = {r["t"]: (r["b"], r["s"]) for r in spark.createDataFrame([(t,) for t in terms], "t string").select(
        "t", F.pmod(h, F.lit(64)).alias("b"), F.when(F.pmod(F.floor(h / 64), F.lit(2)) == 0, 1).otherwise(-1).alias("s")).collect()}
    places = E._TermPlaces(64, most=2)
    for _ in range(2):
        bucket, sign = places.of(terms)
        assert {t: (b, s) for t, b, s in zip(terms, bucket, sign)} == want
