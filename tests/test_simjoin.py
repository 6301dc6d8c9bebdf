"""The prefix-filtered block join equals brute force on the sf0.001 corpus."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doppel.operators import clusters as cl
from doppel.operators.search import similar_documents_tfidf
from doppel.operators.simjoin import similar_pairs, threshold_join


def dense_vectors(model):
    rows = model.vectors.collect()
    ids = np.array([r["doc_id"] for r in rows])
    mat = np.zeros((len(rows), model.vocab_size))
    for i, r in enumerate(rows):
        mat[i, r["term_ids"]] = r["weights"]
    return ids, mat


def brute_pairs(ids, mat, t, same=None):
    sims = np.clip(mat @ mat.T, 0, 1)
    out = {}
    for i in range(len(ids)):
        for j in range(len(ids)):
            if ids[i] < ids[j] and sims[i, j] >= t and (same is None or same[i] == same[j]):
                out[(ids[i], ids[j])] = sims[i, j]
    return out


@pytest.mark.parametrize("t", [0.3, 0.7, 0.95])
def test_pairs_equal_brute_force(spark, small_model, t):
    _, m = small_model
    ids, mat = dense_vectors(m)
    want = brute_pairs(ids, mat, t)
    got = {(r["doc1"], r["doc2"]): r["similarity"]
           for r in similar_pairs(m.vectors, m.vocabulary, t, n_docs=m.n_docs).collect()}
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-9
    if t == 0.7:
        assert len(got) == 27  # golden count for sf0.001


@pytest.mark.parametrize("ratio", [0.0, 1e9])
def test_dense_and_sparse_paths_agree(spark, small_model, ratio):
    _, m = small_model
    got = threshold_join(m.vectors, None, m.vocabulary, 0.5, n_left=m.n_docs, n_right=m.n_docs,
                         block_rows=64, dense_ratio=ratio)
    ids, mat = dense_vectors(m)
    assert {(r["a"], r["b"]) for r in got.collect()} == set(brute_pairs(ids, mat, 0.5))


def test_clustered_subset_of_all(spark, small_model):
    _, m = small_model
    clusters = cl.modulo_clusters(m.vectors, m.n_docs)
    got = {(r["doc1"], r["doc2"]) for r in
           similar_pairs(m.vectors, m.vocabulary, 0.5, clusters=clusters, n_docs=m.n_docs).collect()}
    ids, mat = dense_vectors(m)
    cmap = {r["doc_id"]: r["cluster_id"] for r in clusters.collect()}
    want = brute_pairs(ids, mat, 0.5, same=[cmap[i] for i in ids])
    assert got == set(want)
    assert got <= set(brute_pairs(ids, mat, 0.5))


def test_topk_limits_and_order(spark, small_model):
    _, m = small_model
    res = similar_documents_tfidf(m.vectors, m.vocabulary, 0.3, 3, n_docs=m.n_docs).collect()
    by_q = {}
    for r in res:
        by_q.setdefault(r["query_document_id"], []).append(r)
    for q, rows in by_q.items():
        rows.sort(key=lambda r: r["rank"])
        assert len(rows) <= 3 and all(r["id"] != q for r in rows)
        scores = [r["similarity_score"] for r in rows]
        assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        similar_documents_tfidf(m.vectors, m.vocabulary, 0.3, -1)


def test_query_subset_search(spark, small_model):
    _, m = small_model
    q = m.vectors.select("doc_id").orderBy("doc_id").limit(20)
    got = similar_documents_tfidf(m.vectors, m.vocabulary, 0.3, 100, query_ids=q, n_docs=m.n_docs)
    ids, mat = dense_vectors(m)
    sims = np.clip(mat @ mat.T, 0, 1)
    qs = set(r[0] for r in q.collect())
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids))
            if ids[i] in qs and i != j and sims[i, j] >= 0.3}
    assert {(r["query_document_id"], r["id"]) for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [4, 12, 1024])  # all keys large, some, none
@pytest.mark.parametrize("ratio", [0.0, 1e9])
def test_keys_of_all_sizes(spark, small_model, block_rows, ratio):
    _, m = small_model
    key = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 17 + F.col("doc_id") % 5 * 20).cast("int")
    vectors = m.vectors.withColumn("cluster_id", key)
    ids, mat = dense_vectors(m)
    of = {r["doc_id"]: r["cluster_id"] for r in vectors.collect()}
    same = [of[i] for i in ids]
    assert len(Counter(same)) > 20 and max(Counter(same).values()) > 60
    args = dict(block_key="cluster_id", block_rows=block_rows, dense_ratio=ratio)
    got = [(r["a"], r["b"]) for r in threshold_join(vectors, None, m.vocabulary, 0.3, **args).collect()]
    want = set(brute_pairs(ids, mat, 0.3, same))
    assert set(got) == want and len(got) == len(want)
    some = vectors.where("doc_id % 4 = 1")
    got = [(r["a"], r["b"]) for r in threshold_join(some, vectors, m.vocabulary, 0.3, **args).collect()]
    want = {(x, y) for p in want for x, y in (p, p[::-1]) if x % 4 == 1}
    assert set(got) == want and len(got) == len(want)


def copies(spark, hot=400):
    """A hot group of copies, two small ones that tie with each other, near copies and single vectors."""
    kinds = {0: [0.6, 0.8, 0.0, 0.0], 1: [0.8, 0.6, 0.0, 0.0], 2: [0.6, 0.0, 0.8, 0.0], 3: [0.0, 0.0, 0.6, 0.8]}
    kind = [0 if i < hot else 1 + i % 3 for i in range(hot + 30)]
    kind = kind[::-1]  # the copies have the greater ids
    rows = [(i, i % 3, [j for j, w in enumerate(kinds[k]) if w], [w for w in kinds[k] if w]) for i, k in enumerate(kind)]
    rows += [(9000, 1, [], []), (9001, 0, [1], [1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, cluster_id int, term_ids array<int>, weights array<double>")
    return rows, vectors, spark.range(4).selectExpr("int(id) as term_id", "int(id) as order_rank")


def plain_top(rows, t, limit, queries, same_cluster=(), lonely=()):
    dense = np.zeros((len(rows), 4))
    for i, r in enumerate(rows):
        dense[i, r[2]] = r[3]
    sims, out = np.clip(dense @ dense.T, 0, 1), set()
    for i, q in enumerate(rows):
        if q[0] not in queries:
            continue
        hits = [(-round(sims[i, j], 4), r[0]) for j, r in enumerate(rows) if j != i and sims[i, j] >= t and (
            not same_cluster or q[0] in lonely or (r[0] not in lonely and r[1] == q[1]))]
        out |= {(q[0], h, -s, k + 1) for k, (s, h) in enumerate(sorted(hits)[:limit])}
    return out


@pytest.mark.parametrize("limit", [0, 1, 7])
@pytest.mark.parametrize("asked", [None, (3, 40, 41, 429, 9000, 9001, 77777)])
@pytest.mark.parametrize("clustered", [False, True])
def test_top_hits_of_copies_equal_brute_force(spark, limit, asked, clustered):
    rows, vectors, order = copies(spark)
    lonely = {3, 100, 9001} if clustered else set()
    clusters = vectors.where(~F.col("doc_id").isin(*lonely)).select("doc_id", "cluster_id") if clustered else None
    q = None if asked is None else spark.createDataFrame([(i,) for i in asked + asked[:2]], "doc_id long")
    got = similar_documents_tfidf(vectors.drop("cluster_id"), order, 0.5, limit, q, clusters).collect()
    want = plain_top(rows, 0.5, limit, {r[0] for r in rows} if asked is None else asked, clustered, lonely)
    assert {(r["query_document_id"], r["id"], r["similarity_score"], r["rank"]) for r in got} == want
    assert len(got) == len(want) and all(r["method"] == "tfidf" for r in got)


def test_top_hits_of_copies_are_linear_in_the_copies(spark):
    from doppel.operators.search import top_tfidf_hits
    from doppel.session import release
    release()
    _, vectors, order = copies(spark, hot=3000)
    hits = top_tfidf_hits(vectors.drop("cluster_id"), order, 0.5, 5).cache()
    assert hits.count() == 3031 * 5  # 4.5 million pairs of copies are never formed
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scores_of_given_pairs(spark):
    from doppel.operators.search import score_pairs
    rows = [(1, [0, 2], [0.6, 0.8]), (2, [2, 5], [3.0, 4.0]), (3, [], []), (4, [1], [1.0]), (5, [0], [-2.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")
    pairs = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (1, 1, "x"), (1, 3, None), (1, 4, "y"), (1, 5, "y"), (1, 9, "z"),
                                   (None, 1, "z")], "doc1 long, doc2 long, note string")
    got = {(r["doc1"], r["doc2"]): r["similarity"] for r in score_pairs(pairs, vectors).collect()}
    want = {(1, 2): 0.48, (2, 1): 0.48, (1, 1): 1.0, (1, 3): 0.0, (1, 4): 0.0, (1, 5): 0.0, (1, 9): None, (None, 1): None}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    assert score_pairs(pairs, vectors).columns == ["doc1", "doc2", "note", "similarity"]


def test_every_pair_at_a_threshold_of_zero(spark, small_model):
    _, m = small_model
    zero = spark.createDataFrame([(10**6, [], []), (10**6 + 1, [], [])],
                                 "doc_id long, term_ids array<int>, weights array<double>")
    vectors = m.vectors.unionByName(zero)
    ids, mat = dense_vectors(m)
    ids, mat = np.concatenate([ids, [10**6, 10**6 + 1]]), np.vstack([mat, np.zeros((2, mat.shape[1]))])
    want = brute_pairs(ids, mat, 0.0)
    got = {(r["doc1"], r["doc2"]): r["similarity"] for r in
           similar_pairs(vectors, m.vocabulary, 0.0, block_rows=64).collect()}
    assert set(got) == set(want) and len(want) == len(ids) * (len(ids) - 1) // 2
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    q = m.vectors.select("doc_id").orderBy("doc_id").limit(3)
    hits = similar_documents_tfidf(vectors, m.vocabulary, -1.0, 10**6, query_ids=q).collect()
    assert len(hits) == 3 * (len(ids) - 1) and all(r["query_document_id"] != r["id"] for r in hits)


def heavy_term(spark, n=3000):
    """Vectors of two terms: term 0 is in all but every tenth of them, the other one is one of n / 5."""
    rows = [(i, [0, 1 + i % (n // 5)], [0.6, 0.8]) if i % 10 else (i, [1 + i % (n // 5)], [1.0]) for i in range(n)]
    vectors = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")
    # the common term is ranked first, as an order from another corpus may do: it is in every prefix
    order = spark.range(1 + n // 5).selectExpr("int(id) as term_id", "int(id) as order_rank")
    return rows, vectors, order


@pytest.mark.parametrize("self_join", [True, False])
def test_a_term_in_most_documents_is_cut_into_sub_lists(spark, self_join):
    from doppel.operators import simjoin as sj
    rows, vectors, order = heavy_term(spark)
    args = dict(dense_ratio=1e9, list_rows=100)
    if self_join:
        got = threshold_join(vectors, None, order, 0.7, **args).collect()
    else:
        got = threshold_join(vectors.where("doc_id < 500"), vectors, order, 0.7, **args).collect()
    dense = np.zeros((len(rows), 1 + len(rows) // 5))
    for i, t, w in rows:
        dense[i, t] = w
    sims = dense @ dense.T
    want = {(i, j) for i, j in zip(*np.nonzero(sims >= 0.7)) if (i < j if self_join else i < 500 and i != j)}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    # no key of the join holds more than a little over list_rows postings on a side
    post = sj.prefix_postings(vectors.withColumn("blk", F.lit(0)), order, 0.5, "doc_id", ["blk"], 601)
    assert post.where("term_id = 0").count() == 2700
    counts = sj._term_counts(post.withColumnRenamed("doc_id", "doc"), None, ["term_id"])
    cut = counts.where("n_l > 100").selectExpr("int(ceil(n_l / 100)) as s").first()["s"]
    biggest = post.where("term_id = 0").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(cut))).count().agg(F.max("count"))
    assert biggest.first()[0] < 150


def test_the_join_of_postings_is_in_the_plan_once(spark, small_model):
    from doppel.operators import simjoin as sj
    _, m = small_model
    vec = sj._with_blocks(m.vectors, "doc_id", None, m.n_docs, 64).withColumnRenamed("doc_id", "doc")
    post = sj.prefix_postings(vec, m.vocabulary, 0.7, "doc", ["blk"], m.vocab_size).checkpoint()
    met = sj.meetings(post, None, sj._term_counts(post, None, ["term_id"]).checkpoint(), 0.7, [], True, 4)
    plan = met.distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
    ids, mat = dense_vectors(m)
    found = {(r["a"], r["b"]) for r in met.select("a", "b").distinct().collect()}
    assert set(brute_pairs(ids, mat, 0.7)) <= found


def test_identical_vectors_of_a_cluster_are_one(spark):
    from doppel.operators.simjoin import collapse_copies
    rows = [(i, i % 2, [1, 2], [0.6, 0.8]) for i in range(6)] + [(9, 0, [1, 2], [0.8, 0.6]), (10, 0, [], [])]
    vec = spark.createDataFrame(rows, "doc_id long, cluster_id int, term_ids array<int>, weights array<double>")
    reps, members = collapse_copies(vec, "doc_id", ["cluster_id"])
    assert sorted(r["doc_id"] for r in reps.collect()) == [0, 1, 9]
    assert sorted((r["rep"], r["member"]) for r in members.collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5), (9, 9)]
