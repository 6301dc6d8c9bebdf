"""Joins of packed blocks: no vector is shuffled for every block it meets, and nothing is lost."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doppel.operators import blocks as B
from doppel.operators.embeddings import embedding_hits, embedding_threshold_join
from doppel.operators.search import mirror, rank_hits
from doppel.operators.simjoin import threshold_join


def texts(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        terms = np.unique(rng.zipf(1.3, size=rng.integers(1, 40)) % 400)
        if i % 5 == 4:
            terms = np.unique(np.concatenate((rows[-1][1], terms[:2])))
        w = rng.uniform(0.5, 1.5, len(terms)) if i % 5 != 4 else np.ones(len(terms))
        rows.append((i, terms.tolist(), (w / np.sqrt((w * w).sum())).tolist()))
    rows.append((n, [], []))
    mat = np.zeros((len(rows), 400))
    for i, t, w in rows:
        mat[i, t] = w
    return rows, mat


@pytest.mark.parametrize("t", [-1.0, 0.0, 0.2, 0.7])
@pytest.mark.parametrize("slices", [512, 7])
def test_products_of_sparse_blocks_equal_brute_force(monkeypatch, t, slices):
    monkeypatch.setattr(B, "SLICE", slices)
    monkeypatch.setattr(B, "GATHER", 200)
    rows, mat = texts()
    frame = pd.DataFrame(rows, columns=["doc", "term_ids", "weights"])
    sims = mat @ mat.T
    parts = {c: x.tobytes() for c, x in B.flat_vectors(frame).items()}
    one, some = B.flat_from_bytes(parts), B.flat_vectors(frame[:40])
    got = [(i, j, s) for x in B.near_sparse(some, one, False, t) for i, j, s in zip(*x)]
    assert {(i, j) for i, j, _ in got} == {(i, j) for i, j in zip(*np.nonzero(sims[:40] >= t))} and \
        max(abs(sims[i, j] - s) for i, j, s in got) < 1e-12
    got = [(i, j) for x in B.near_sparse(one, one, True, t) for i, j, _ in zip(*x)]
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(sims >= t)) if i < j} and len(set(got)) == len(got)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("t", [0.0, 0.4123])
def test_texts_of_many_blocks_are_not_copied_for_each(spark, monkeypatch, t):
    from doppel.operators import simjoin as sj
    monkeypatch.setattr(sj, "LEAST_ROWS", 60)
    monkeypatch.setattr(sj, "BLOCKS_TOGETHER", 2)
    rows, mat = texts()
    vectors = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, weights array<double>")
    order = spark.range(400).selectExpr("int(id) as term_id", "int(id) as order_rank")
    sims = np.clip(mat @ mat.T, 0, 1)
    pairs = threshold_join(vectors, None, order, t, block_rows=64, dense_ratio=0.0)
    assert "explode" not in plan_of(pairs)  # before: every vector once for each block
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    nonzero = mat.any(1) | (t <= 0)
    want = {(i, j) for i, j in zip(*np.nonzero((sims >= t) & nonzero[:, None] & nonzero)) if i < j}
    assert set(got) == want and len(got) == len(want)
    names = vectors.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    some = names.where("doc_id in ('d1', 'd2', 'd30', 'd99')")
    for best in (None, 1, 3):
        hits = threshold_join(some, names, order, t, block_rows=64, dense_ratio=0.0, best=best)
        limit = best or 1000
        want = set()
        for i in (1, 2, 30, 99):
            own = sorted((-round(sims[i, j], 4), f"d{j}") for j in range(len(rows)) if j != i and sims[i, j] >= t and nonzero[j])
            want |= {(f"d{i}", d) for _, d in own[:limit]}
        ranked = rank_hits(hits.selectExpr("a as query_document_id", "b as id", "similarity"), limit)
        assert {(r["query_document_id"], r["id"]) for r in ranked.collect()} == want


@pytest.mark.parametrize("t", [0.0, 0.4123])
def test_large_keys_are_not_copied_for_each_of_their_blocks(spark, monkeypatch, t):
    from doppel.operators import simjoin as sj
    monkeypatch.setattr(sj, "BUNDLES", 2)
    rows, mat = texts()
    of = np.array([[0, 0, 0, 1, 2, 3][i * 7 % 6] for i in range(len(rows))])  # of several blocks, but for the last ones
    vectors = spark.createDataFrame([(*r, int(c)) for r, c in zip(rows, of)],
                                    "doc_id long, term_ids array<int>, weights array<double>, c int")
    order = spark.range(400).selectExpr("int(id) as term_id", "int(id) as order_rank")
    ok = (np.clip(mat @ mat.T, 0, 1) >= t) & (of[:, None] == of) & ((mat.any(1) | (t <= 0))[:, None] & (mat.any(1) | (t <= 0)))
    pairs = threshold_join(vectors, None, order, t, block_key="c", block_rows=40, dense_ratio=0.0)
    assert "explode" not in plan_of(pairs)  # before: every vector once for each block of its key
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(ok)) if i < j} and len(got) == len(set(got))
    some = vectors.where("doc_id % 3 = 0 and c <> 3")
    got = [(r["a"], r["b"]) for r in threshold_join(some, vectors, order, t, block_key="c", block_rows=40,
                                                    dense_ratio=0.0).collect()]
    want = {(i, j) for i, j in zip(*np.nonzero(ok)) if i != j and i % 3 == 0 and of[i] != 3}
    assert set(got) == want and len(got) == len(want)


def test_vectors_of_many_blocks_are_not_copied_for_each(spark, monkeypatch):
    from doppel.operators import embeddings as E
    monkeypatch.setattr(E, "CELLS_PER_BLOCK", 2)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 12))
    v[100:120] = v[7]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
    pairs = embedding_threshold_join(emb, None, 0.3, "doc_id", cell_rows=20)
    assert "explode" not in plan_of(pairs)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    want = {(i, j) for i, j in zip(*np.nonzero(sims >= 0.3)) if i < j}
    assert set(got) == want and len(got) == len(want)


def test_only_the_best_hits_of_a_task_are_passed_on(spark):
    rng = np.random.default_rng(8)
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(900, 6)))],
                                "doc_id long, embedding array<double>")
    every, few = (embedding_hits(emb, emb, 0.1, best=b) for b in (None, 4))
    want, got = ({tuple(r) for r in rank_hits(x, 4).collect()} for x in (every, few))
    assert got == want and every.count() > 200_000 and few.count() < 5 * 900  # before: all of them


def test_best_hits_keep_ties_by_id_and_uncertain_ones():
    ia = np.array([0, 0, 0, 0, 1])
    ids = np.array(["c", "b", "a", "z", "q"], object)
    s = np.array([0.50001, 0.50002, 0.49999, 0.40005, 0.3])
    assert sorted(ids[B.best_hits(ia, ids, s, 2)]) == ["a", "b", "q", "z"]  # z may be rounded either way


def test_pairs_are_made_once_for_both_directions(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5)], "doc1 long, doc2 long, similarity double")
    both = mirror(pairs)
    assert {tuple(r) for r in both.collect()} == {(1, 2, 0.5), (2, 1, 0.5)} and "Union" not in plan_of(both)


def test_a_task_keeps_the_best_hits_on_the_way(spark, monkeypatch):
    from doppel.operators import embeddings as E
    monkeypatch.setattr(E, "SLICE_PAIRS", 300)
    monkeypatch.setattr(E, "CELLS_PER_BLOCK", 2)
    rng = np.random.default_rng(5)
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 4)))],
                                "doc_id long, embedding array<double>")
    pairs, may = E._block_pairs(emb, emb, 0.1, "doc_id", "embedding", None, 50, 3)
    monkeypatch.setattr(B, "HELD_ROWS", 10)
    few = B.scored_pairs(pairs, E._vector_blocks_from_bytes, lambda x, y, same, least: (
        w[:3] for w in E._near_vectors(x, y, same, 0.1, may.value, least)), emb.schema["doc_id"].dataType, "ne", 3)
    got = rank_hits(few.selectExpr("a as query_document_id", "b as id", "similarity"), 3)
    want = rank_hits(embedding_hits(emb, emb, 0.1), 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
