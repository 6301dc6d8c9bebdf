"""Per-document similarity search and top-k.

The reference answers one query document at a time; here a whole set of query documents is
answered in one job.  Asking for every document reuses the triangular self-join (each pair is
scored once) and mirrors it; a set of query ids runs the left/right form of the same join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.operators.simjoin import collapse_copies, similar_pairs, threshold_join
from doppel.session import keep

METHODS = ("tfidf", "embedding")


def check_request(method: str, threshold: float, limit: int) -> None:
    """Argument checks made before any planning."""
    if method not in METHODS:
        raise ValueError("Method must be 'tfidf' or 'embedding'")
    if limit < 0:
        raise ValueError("limit must be >= 0")


def mirror(pairs: DataFrame, a: str = "doc1", b: str = "doc2",
           score: str = "similarity") -> DataFrame:
    """Unordered pairs -> (query_document_id, id, score) in both directions."""
    ways = [F.struct(F.col(x).alias("query_document_id"), F.col(y).alias("id")) for x, y in ((a, b), (b, a))]
    both = pairs.select(F.explode(F.array(*ways)).alias("_way"), F.col(score))  # the pairs are made once
    return both.select("_way.query_document_id", "_way.id", F.col(score))


def rank_hits(hits: DataFrame, limit: int, score: str = "similarity",
              method: str | None = None) -> DataFrame:
    """T2 + P8: round to 4 places, order by rounded score desc then id, keep ``limit`` per query.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the shuffle, so a
    query document with a huge number of hits never ships more than k rows per map task.
    """
    ranked = hits.withColumn("similarity_score", F.round(F.col(score), 4))
    w = Window.partitionBy("query_document_id").orderBy(F.desc("similarity_score"), F.asc("id"))
    out = (ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(limit))
           .select("query_document_id", "id", "similarity_score", "rank"))
    if method is not None:
        out = out.withColumn("method", F.lit(method))
    return out


def tfidf_hits(vectors: DataFrame, order: DataFrame, threshold: float,
               query_ids: DataFrame | None = None, clusters: DataFrame | None = None,
               id_col: str = "doc_id", cluster_col: str = "cluster_id",
               n_docs: int | None = None) -> DataFrame:
    """Unranked hits (query_document_id, id, similarity) for J7 (no clusters) or J8 (clusters)."""
    if query_ids is None:
        hits = mirror(similar_pairs(vectors, order, threshold, id_col, clusters, cluster_col,
                                    n_docs=n_docs, sort=False))
        if clusters is None:
            return hits
        # J8 fallback: a query without a cluster is compared with every document.
        lonely = vectors.join(clusters.select(id_col), id_col, "left_anti")
        if lonely.isEmpty():
            return hits
        extra = threshold_join(lonely, vectors, order, threshold, id_col)
        return hits.unionByName(extra.select(F.col("a").alias("query_document_id"),
                                             F.col("b").alias("id"), "similarity"))
    queries = vectors.join(query_ids.select(id_col).distinct(), id_col, "left_semi")
    if clusters is None:
        hits = threshold_join(queries, vectors, order, threshold, id_col)
    else:
        cl = clusters.select(id_col, cluster_col)
        hits = threshold_join(queries.join(cl, id_col), vectors.join(cl, id_col), order,
                              threshold, id_col, block_key=cluster_col)
        lonely = queries.join(cl, id_col, "left_anti")
        if not lonely.isEmpty():
            hits = hits.unionByName(threshold_join(lonely, vectors, order, threshold, id_col))
    return hits.select(F.col("a").alias("query_document_id"), F.col("b").alias("id"), "similarity")


def _opened(groups: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """Ranked hits that are groups (by their first id) -> the best ``limit`` hits that are documents.

    All members of a group score alike, so only its ``limit`` first ids can be among the best.
    """
    first = Window.partitionBy("rep").orderBy("member")
    ids = (members.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
           .select(F.col("rep").alias("id"), F.col("member").alias("hit")))
    return rank_hits(groups.join(ids, "id").select("query_document_id", F.col("hit").alias("id"),
                                                   "similarity_score"), limit, "similarity_score")


def _for_members(best: DataFrame, members: DataFrame, limit: int, exclude_same_id: bool) -> DataFrame:
    """The best hits of a group of queries for each of its members."""
    out = best.withColumnRenamed("query_document_id", "rep").join(members.select("rep", "member"), "rep")
    out = out.where("member <> id") if exclude_same_id else out
    return rank_hits(out.withColumnRenamed("member", "query_document_id"), limit, "similarity_score")


def top_embedding_hits(queries: DataFrame, corpus: DataFrame, threshold: float, limit: int, id_col: str = "doc_id",
                       vec_col: str = "embedding", exclude_same_id: bool = True) -> DataFrame:
    """T2 over J10, equal vectors searched once: (query_document_id, id, similarity_score, rank).

    Ids are unique on each side.  Equal vectors of either side are one group, as in ``top_tfidf_hits``.
    """
    from doppel.operators.embeddings import collapse_equal, embedding_hits, same_id_type
    queries, corpus = same_id_type(queries, corpus, id_col)
    asked, members = (keep(x) for x in collapse_equal(queries, id_col, vec_col))
    given, found_as = (keep(x) for x in collapse_equal(corpus, id_col, vec_col))
    groups = rank_hits(embedding_hits(asked, given, threshold, id_col, vec_col, exclude_same_id=False,
                                      best=limit + 1), limit + 1)
    return _for_members(_opened(groups, found_as, limit + 1), members, limit, exclude_same_id)


def top_tfidf_hits(vectors: DataFrame, order: DataFrame, threshold: float, limit: int,
                   query_ids: DataFrame | None = None, clusters: DataFrame | None = None,
                   id_col: str = "doc_id", cluster_col: str = "cluster_id",
                   n_docs: int | None = None) -> DataFrame:
    """T2 over J7 or J8, copies searched once: (query_document_id, id, similarity_score, rank).

    Documents of one vector (and cluster) have the same hits but for themselves.  So the best
    ``limit + 1`` hits are found for one of them and handed to all, each without itself, and a group of
    copies costs rows in its size, not in its square.  Where every document is asked for, hits are
    groups too: of a group only the ``limit + 1`` first ids can be among the best, and only the
    ``limit + 1`` best groups of a query are opened.
    """
    if threshold <= 0:  # zero vectors take part, and nothing is collapsed
        return rank_hits(tfidf_hits(vectors, order, threshold, query_ids, clusters, id_col, cluster_col, n_docs), limit)
    more = limit + 1
    cl = None if clusters is None else clusters.select(id_col, cluster_col)
    key = [] if cl is None else [cluster_col]
    block_key = None if cl is None else cluster_col
    vecs = vectors if cl is None else vectors.join(cl, id_col)
    if query_ids is None:
        asked = vectors
        reps, members = collapse_copies(vecs, id_col, key)
        reps, members = keep(reps) if key else reps, keep(members)
        pairs = threshold_join(reps, None, order, threshold, id_col, block_key, n_left=n_docs, n_right=n_docs)
        own = (members.where("rep = member")
               .select(F.col("rep").alias("query_document_id"), F.col("rep").alias("id"),
                       F.least(F.greatest("self_sim", F.lit(0.0)), F.lit(1.0)).alias("similarity"))
               .where(F.col("similarity") >= F.lit(threshold)))
        groups = rank_hits(mirror(pairs, "a", "b").unionByName(own), more)
        best = _opened(groups, members, more)
    else:
        asked = vectors.join(query_ids.select(id_col).distinct(), id_col, "left_semi")
        reps, members = (keep(x) for x in collapse_copies(asked if cl is None else asked.join(cl, id_col), id_col, key))
        found = threshold_join(reps, vecs, order, threshold, id_col, block_key, exclude_same_id=False, best=more)
        best = rank_hits(found.select(F.col("a").alias("query_document_id"), F.col("b").alias("id"),
                                      "similarity"), more)
    out = _for_members(best, members, limit, True)
    if cl is not None:  # J8 fallback: a query without a cluster is compared with every document
        lonely = asked.join(cl, id_col, "left_anti")
        if not lonely.isEmpty():
            out = out.unionByName(top_tfidf_hits(vectors, order, threshold, limit, lonely, None, id_col, n_docs=n_docs))
    return out


def score_pairs(pairs: DataFrame, vectors: DataFrame, a: str = "doc1", b: str = "doc2",
                id_col: str = "doc_id") -> DataFrame:
    """P6 for given pairs of ids: ``pairs`` with ``similarity``, the clamped cosine of their sparse vectors.

    A zero vector scores 0.0; a pair with an id that has no vector scores null.
    """
    one = vectors.select(F.col(id_col).alias(a), F.struct("term_ids", "weights").alias("_a"))
    two = vectors.select(F.col(id_col).alias(b), F.struct("term_ids", "weights").alias("_b"))

    @F.pandas_udf("double")
    def cosine(ids_a: pd.Series, w_a: pd.Series, ids_b: pd.Series, w_b: pd.Series) -> pd.Series:
        out = np.full(len(ids_a), np.nan)
        for i, (ia, wa, ib, wb) in enumerate(zip(ids_a, w_a, ids_b, w_b)):
            if ia is None or ib is None:
                continue
            norm = np.sqrt((wa * wa).sum() * (wb * wb).sum())
            _, at, bt = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
            out[i] = min(max((wa[at] * wb[bt]).sum() / norm, 0.0), 1.0) if norm else 0.0
        return pd.Series(out)

    scored = pairs.join(one, a, "left").join(two, b, "left")
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return scored.select(*pairs.columns, F.when(known, cosine(
        "_a.term_ids", "_a.weights", "_b.term_ids", "_b.weights")).alias("similarity"))


def similar_documents_tfidf(vectors: DataFrame, order: DataFrame, threshold: float = 0.7,
                            limit: int = 10, query_ids: DataFrame | None = None,
                            clusters: DataFrame | None = None, id_col: str = "doc_id",
                            n_docs: int | None = None) -> DataFrame:
    """Top ``limit`` documents with TF-IDF cosine >= threshold for each query document.

    A query id without a vector gets no rows (F8); the query itself is never a hit (F4).
    """
    check_request("tfidf", threshold, limit)
    hits = top_tfidf_hits(vectors, order, threshold, limit, query_ids, clusters, id_col, n_docs=n_docs)
    return hits.withColumn("method", F.lit("tfidf"))
