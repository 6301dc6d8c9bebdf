"""Exact cosine threshold joins over L2-normalised sparse vectors.

Plan
----
1. **Prefix filter** (AllPairs, Bayardo et al. 2007).  Terms are put in one global order, rare
   first.  In every vector the trailing run of common terms whose squared norm stays below
   ``t**2`` is left out of the index; the rest is the *prefix*.  Two vectors whose prefixes share no
   term have cosine < t.  A posting carries the norm of its vector from its term on: where two vectors
   meet first, the product of these norms bounds their cosine, so a meeting whose product is below
   ``t`` is dropped at once (a pair that can qualify is found by its first shared term).
2. **Dense or sparse.**  ``sum(df_left * df_right)`` over the prefix terms is the number of meetings,
   known from term counts alone, before any pair is made.  If it is a good part of all pairs (per
   blocking key), candidates cannot pay: the vectors are cut into hash blocks of at most about
   ``block_rows`` and every pair of blocks is one float32 matrix product, whose entries near ``t`` are
   recomputed in float64.  A self-join forms each unordered pair of blocks once.  Blocking keys of at
   most ``block_rows`` vectors need no counts: they are binned by a hash to about as many rows a group,
   and a group scores one key after another, each vector shipped once.
3. **Split posting lists.**  Else postings meet on ``term_id``.  A term with more than ``list_rows``
   postings is cut into sub-lists by a hash of the id, and sub-lists meet pairwise on
   ``(term_id, i, j)``, so no key of the join has more than about ``list_rows`` rows on a side, however
   common a term is.  The join is in the plan once; its pairs are made distinct per pair of blocks and
   verified there: the vectors a group needs are shipped once per group, not once per candidate.
4. Exact copies (identical vectors) are collapsed to one representative before the join and
   expanded afterwards, so a hot group of copies costs one vector in the join.

At ``t <= 0`` nothing can be left out: every pair of blocks is scored, zero vectors included.
Scores are clamped to [0, 1] like the reference's TF-IDF cosine; zero vectors score 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.operators.blocks import (flat_from_bytes, flat_vectors, near_sparse, packed, packed_by_key, pairs_of_blocks,
                                     pairs_within_keys, scored_pairs)
from doppel.session import keep, scratch_path


PREFIX_EPS = 1e-9  # keep a little more of each prefix than needed, to absorb rounding
ORDER_LOOKUP_ROWS = 2_000_000  # term ids up to which the term order is broadcast: 4 bytes each
BLOCK_ROWS = 8192  # vectors of a block
PACKED_ROWS = 2048  # vectors of a packed block: one row of some 5 MB, which a task holds several times over
LEAST_ROWS, LEAST_BLOCKS = 1024, 16  # a small side is cut to so many blocks, but to none of fewer rows
BLOCKS_TOGETHER = 4  # blocks that one task compares with a block of queries or, of many, with as many blocks
FEW_BLOCKS = 64  # blocks of a self-join up to which each is a partition of its own
BUNDLES = 32  # sets of blocking keys with more than one block, each joined on its own
LIST_ROWS = 1024  # postings of a term beyond which its list is cut
REPS_ROWS = 2_000_000  # numeric ids of representatives up to which they are broadcast: 8 bytes each
SPLIT_TERMS_ROWS = 500_000  # cut terms (16 bytes each) up to which they are broadcast


def _block(col: str, n_blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n_blocks)).cast("int")


def _with_blocks(vecs: DataFrame, id_col: str, block_key: str | None, n: int | None,
                 block_rows: int) -> DataFrame:
    """Add ``blk``: a hash block of at most about ``block_rows`` vectors.

    Without a blocking key the block count is ``ceil(n / block_rows)``; with one (a cluster id)
    every key gets ``ceil(size / block_rows)`` blocks of its own, so a hot cluster holding a
    third of the corpus is split as finely as the corpus itself.
    """
    if block_key is None:
        n = n if n is not None else vecs.count()
        return vecs.withColumn("blk", _block(id_col, max(1, math.ceil(n / block_rows))))
    per_key = (vecs.groupBy(block_key).agg(F.count(F.lit(1)).alias("_n"))
               .select(block_key, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows)))
                       .cast("int").alias("_nb")))
    return (vecs.join(per_key, block_key)
            .withColumn("blk", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int"))
            .drop("_nb"))


def prefix_postings(vectors: DataFrame, order: DataFrame, threshold: float,
                    id_col: str, extra_cols: list[str] | None = None,
                    order_rows: int | None = None) -> DataFrame:
    """Postings of each vector's indexed prefix: (id, *extra_cols, term_id, norm).

    ``norm`` is that of the vector's weights from this term on, in the order rare to common.  The order
    is looked up inside the tasks where it is small (checked); an uncapped vocabulary is joined.
    """
    cols = [id_col, *(extra_cols or [])]
    least = threshold * threshold - PREFIX_EPS
    if order_rows is not None and order_rows <= ORDER_LOOKUP_ROWS:
        known = order.select("term_id", "order_rank").toPandas()  # within the bound
        rank_of = np.zeros(int(known["term_id"].max()) + 1 if len(known) else 1, np.int32)
        rank_of[known["term_id"].to_numpy()] = known["order_rank"].to_numpy()
        shared = vectors.sparkSession.sparkContext.broadcast(rank_of)

        @F.pandas_udf("terms array<int>, norms array<double>")
        def cut(term_ids: pd.Series, weights: pd.Series) -> pd.DataFrame:
            ranks = shared.value
            out = {"terms": [], "norms": []}
            for ids, w in zip(term_ids, weights):
                ids, w = np.asarray(ids, np.int64), np.asarray(w, np.float64)
                common_first = np.argsort(-ranks[ids], kind="stable")
                tail = np.cumsum(w[common_first] ** 2)
                kept = tail >= least
                out["terms"].append(ids[common_first][kept].astype(np.int32))
                out["norms"].append(np.sqrt(tail[kept]))
            return pd.DataFrame(out)

        lists = vectors.select(*cols, cut("term_ids", "weights").alias("p"))
        return (lists.select(*cols, F.explode(F.arrays_zip("p.terms", "p.norms")).alias("q"))
                .select(*cols, F.col("q.terms").alias("term_id"), F.col("q.norms").alias("norm")))
    long = (vectors.select(*cols, F.explode(F.arrays_zip("term_ids", "weights")).alias("p"))
            .select(*cols, F.col("p.term_ids").alias("term_id"), F.col("p.weights").alias("weight")))
    ranked = long.join(order.select("term_id", "order_rank"), "term_id")
    suffix = Window.partitionBy(id_col).orderBy(F.desc("order_rank")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (ranked.withColumn("tail", F.sum(F.col("weight") * F.col("weight")).over(suffix))
            .where(F.col("tail") >= F.lit(least))
            .select(*cols, "term_id", F.sqrt("tail").alias("norm")))


def _term_counts(left: DataFrame, right: DataFrame | None, keys: list[str]) -> DataFrame:
    """(term_id, *extra, n_l, n_r): postings of each term on both sides (the same side twice if one)."""
    n_l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_l"))
    if right is None:
        return n_l.withColumn("n_r", F.col("n_l"))
    return n_l.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_r")), keys)


def meetings(pl: DataFrame, pr: DataFrame | None, counts: DataFrame, threshold: float,
             extra: list[str], exclude_same_id: bool, list_rows: int = LIST_ROWS) -> DataFrame:
    """(ba, bb, *extra, a, b) for each meeting of two postings that can be a qualifying pair's first.

    ``pl`` and ``pr`` are (doc, blk, *extra, term_id, norm); ``pr=None`` is a self-join, a < b.
    """
    key = ["term_id", *extra]
    cut = counts.where((F.col("n_l") > list_rows) | (F.col("n_r") > list_rows)).select(
        *key, *[F.ceil(F.col(c) / list_rows).cast("int").alias(f"s_{c}") for c in ("n_l", "n_r")])
    cut = keep(cut)
    cut = F.broadcast(cut) if cut.count() <= SPLIT_TERMS_ROWS else cut

    def dealt(side: DataFrame, n_own: str, own: str, other: str, last) -> DataFrame:
        """Every posting in its own sub-list, once for each sub-list of the other side it meets."""
        out = side.join(cut, key, "left")
        out = out.withColumn(own, F.pmod(F.xxhash64("doc"), F.coalesce(F.col(n_own), F.lit(1))).cast("int"))
        return out.withColumn(other, F.explode(last)).drop("s_n_l", "s_n_r")

    one = F.lit(1)
    self_join = pr is None
    if self_join:  # sub-list i meets sub-list j for i <= j
        x = dealt(pl, "s_n_l", "i", "j", F.sequence("i", F.coalesce("s_n_l", one) - 1))
        y = dealt(pl, "s_n_l", "j", "i", F.sequence(F.lit(0), F.col("j")))
    else:
        x = dealt(pl, "s_n_l", "i", "j", F.sequence(F.lit(0), F.coalesce("s_n_r", one) - 1))
        y = dealt(pr, "s_n_r", "j", "i", F.sequence(F.lit(0), F.coalesce("s_n_l", one) - 1))
    x = x.select(*key, "i", "j", F.col("doc").alias("a"), F.col("blk").alias("ba"), F.col("norm").alias("na"))
    y = y.select(*key, "i", "j", F.col("doc").alias("b"), F.col("blk").alias("bb"), F.col("norm").alias("nb"))
    met = x.join(y, [*key, "i", "j"]).where(F.col("na") * F.col("nb") >= threshold - PREFIX_EPS)
    if self_join:
        met = met.where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))).where("a <> b")
        swap = F.col("a") > F.col("b")
        met = met.select(*extra, *[F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p)
                                   for p, q in (("ba", "bb"), ("bb", "ba"), ("a", "b"), ("b", "a"))])
    elif exclude_same_id:
        met = met.where("a <> b")
    return met.select("ba", "bb", *extra, "a", "b")


def _verify_groups(cands: DataFrame | None, routed: DataFrame, threshold: float,
                   id_type: T.DataType, clamp: bool, keys: list[str], pair_rule: str,
                   within: str | None = None) -> DataFrame:
    """cands (ba, bb, a, b); routed (ba, bb, side, doc, blk, term_ids, weights) -> (a, b, similarity).

    With ``within`` there are no candidates: every pair of a group that agrees in that column is scored,
    one value after another (a self-join has one side only).

    Per block pair: the right-side vectors become one dense matrix over the columns they use;
    the left-side vectors stay sparse (CSR).  Candidate scores are then one vectorised gather and
    segment sum, chunked so memory stays bounded.
    """
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type),
                           T.StructField("similarity", T.DoubleType())])
    t = float(threshold)

    def _gather_scores(dense: np.ndarray, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray,
                       ia: np.ndarray, ib: np.ndarray, chunk: int = 4_000_000) -> np.ndarray:
        """Dot products of left rows ``ia`` (CSR) with dense right rows ``ib``, chunked."""
        out = np.empty(len(ia), dtype=np.float64)
        lens = indptr[ia + 1] - indptr[ia]
        start = 0
        while start < len(ia):
            # take as many candidates as fit in one chunk of gathered elements
            csum = np.cumsum(lens[start:])
            stop = start + max(1, int(np.searchsorted(csum, chunk, side="right")))
            sub_a, sub_b, sub_l = ia[start:stop], ib[start:stop], lens[start:stop]
            total = int(sub_l.sum())
            if total == 0:
                out[start:stop] = 0.0
                start = stop
                continue
            seg = np.repeat(np.arange(len(sub_a)), sub_l)
            first = np.repeat(indptr[sub_a] - np.concatenate([[0], np.cumsum(sub_l)[:-1]]), sub_l)
            elem = np.arange(total) + first
            prod = vals[elem] * dense[sub_b[seg], cols[elem]]
            res = np.zeros(len(sub_a))
            nz = sub_l > 0
            if nz.any():
                starts = np.concatenate([[0], np.cumsum(sub_l)[:-1]])[nz]
                res[nz] = np.add.reduceat(prod, starts)
            out[start:stop] = res
            start = stop
        return out

    def empty() -> pd.DataFrame:
        return pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object),
                             "similarity": pd.Series([], dtype="float64")})

    def whole_block_pair(left: pd.DataFrame, right: pd.DataFrame):
        """Every pair of two sets of rows, a slice at a time; a self-join has the same rows on both sides once."""
        one = right is left or (pair_rule == "lt" and left["blk"].iloc[0] == right["blk"].iloc[0])
        right = left if one and pair_rule == "lt" else right
        x = flat_vectors(left)
        a_ids, b_ids = left["doc"].to_numpy(), right["doc"].to_numpy()
        for ia, ib, scores in near_sparse(x, x if right is left else flat_vectors(right), one and pair_rule == "lt", t):
            a, b = a_ids[ia], b_ids[ib]
            kept = np.ones(len(a), bool) if pair_rule == "all" else a != b
            if pair_rule == "lt":
                a, b = np.where(a < b, a, b), np.where(a < b, b, a)
            yield pd.DataFrame({"a": a[kept], "b": b[kept],
                                "similarity": (np.clip(scores, 0.0, 1.0) if clamp else scores)[kept]})

    def verify(pairs: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        if vecs.empty:
            return empty()
        right = vecs[vecs["side"] == 1]
        left = vecs[vecs["side"] == 0]
        if left.empty or right.empty:
            return empty()
        if pairs.empty:
            return empty()
        r_ids = [np.asarray(x, dtype=np.int64) for x in right["term_ids"]]
        r_w = [np.asarray(x, dtype=np.float64) for x in right["weights"]]
        r_len = np.fromiter((len(x) for x in r_ids), dtype=np.int64, count=len(r_ids))
        all_r = np.concatenate(r_ids) if len(r_ids) else np.zeros(0, np.int64)
        cols = np.unique(all_r)
        dense = np.zeros((len(right), len(cols)), dtype=np.float64)
        dense[np.repeat(np.arange(len(right)), r_len), np.searchsorted(cols, all_r)] = \
            np.concatenate(r_w) if len(r_w) else np.zeros(0)
        # left side as CSR over the same columns; terms the right side lacks contribute 0
        l_ids = [np.asarray(x, dtype=np.int64) for x in left["term_ids"]]
        l_w = [np.asarray(x, dtype=np.float64) for x in left["weights"]]
        all_l = np.concatenate(l_ids) if len(l_ids) else np.zeros(0, np.int64)
        all_lw = np.concatenate(l_w) if len(l_w) else np.zeros(0)
        pos = np.searchsorted(cols, all_l)
        pos_c = np.minimum(pos, max(len(cols) - 1, 0))
        hit = (pos < len(cols)) & (cols[pos_c] == all_l) if len(cols) else np.zeros(len(all_l), bool)
        row_of = np.repeat(np.arange(len(left)), [len(x) for x in l_ids])
        keep_rows = row_of[hit]
        indptr = np.concatenate([[0], np.cumsum(np.bincount(keep_rows, minlength=len(left)))])
        l_cols = pos_c[hit]
        l_vals = all_lw[hit]
        l_index = pd.Index(left["doc"].to_numpy())
        r_index = pd.Index(right["doc"].to_numpy())
        ia = l_index.get_indexer(pairs["a"].to_numpy())
        ib = r_index.get_indexer(pairs["b"].to_numpy())
        ok = (ia >= 0) & (ib >= 0)
        ia, ib = ia[ok], ib[ok]
        scores = _gather_scores(dense, indptr, l_cols, l_vals, ia, ib)
        if clamp:
            scores = np.clip(scores, 0.0, 1.0)
        keep = scores >= t
        if not keep.any():
            return empty()
        return pd.DataFrame({"a": left["doc"].to_numpy()[ia[keep]],
                             "b": right["doc"].to_numpy()[ib[keep]],
                             "similarity": scores[keep]})

    def score_within(vecs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in vecs.groupby(within, sort=False):
            left = own[own["side"] == 0]
            right = left if pair_rule == "lt" else own[own["side"] == 1]
            if len(left) and len(right):
                out += whole_block_pair(left, right)
        return pd.concat(out) if out else empty()

    if within is not None:
        return routed.groupBy(*keys).applyInPandas(score_within, schema)
    return (cands.groupBy(*keys)
            .cogroup(routed.groupBy(*keys))
            .applyInPandas(verify, schema))


def threshold_join(left: DataFrame, right: DataFrame | None, order: DataFrame,
                   threshold: float, id_col: str = "doc_id", block_key: str | None = None,
                   n_left: int | None = None, n_right: int | None = None,
                   block_rows: int = BLOCK_ROWS, exclude_same_id: bool = True,
                   clamp: bool = True, dense_ratio: float = 0.1,
                   order_rows: int | None = None, list_rows: int = LIST_ROWS, best: int | None = None) -> DataFrame:
    """All pairs with cosine >= threshold between array-form vectors.

    ``right=None`` is a self-join returning each unordered pair once as ``a < b``.  Otherwise every
    (left, right) pair is returned, except equal ids when ``exclude_same_id``.  ``block_key`` is an
    extra equality key (cluster id) both sides must share.  At ``threshold <= 0`` zero vectors, which
    score 0, take part like all others.  With ``best`` (two sides), hits that cannot be among the best so
    many of a left row may be left out.  Output: (a, b, similarity).
    """
    self_join = right is None
    extra = [block_key] if block_key else []
    id_type = left.schema[id_col].dataType
    if not self_join and right.schema[id_col].dataType != id_type:  # ids of two kinds meet as what holds both
        texts = T.StringType() in (id_type, right.schema[id_col].dataType)
        id_type = T.StringType() if texts else T.LongType()
        left, right = (x.withColumn(id_col, F.col(id_col).cast(id_type)) for x in (left, right))

    def prepared(side: DataFrame, n: int | None) -> DataFrame:
        side = side if threshold <= 0 else side.where(F.size("term_ids") > 0)
        return _with_blocks(side, id_col, block_key, n, block_rows).select(
            F.col(id_col).alias("doc"), *extra, "blk", "term_ids", "weights")

    lv = prepared(left, n_left)
    rv = lv if self_join else prepared(right, n_right)
    if not extra:
        sizes = [lv.count() if n_left is None else n_left]
        if not self_join:
            sizes.append(rv.count() if n_right is None else n_right)

        def whole() -> DataFrame:
            return _packed_blocks(lv, None if self_join else rv, threshold, id_type, clamp, exclude_same_id, sizes,
                                  block_rows, best)

        if threshold <= 0:
            return whole()
        return _counted(lv, None if self_join else rv, order, threshold, extra, id_type, clamp, exclude_same_id,
                        dense_ratio, order_rows, list_rows, whole)
    # keys that fit in one block are scored whole, several of them in a group: no postings, no copies
    sizes = keep(lv.groupBy(block_key).agg(F.count(F.lit(1)).alias("v_l"))
                 .join(rv.groupBy(block_key).agg(F.count(F.lit(1)).alias("v_r")), block_key))
    small = (F.col("v_l") <= block_rows) & (F.col("v_r") <= block_rows)
    rows, large = sizes.agg(F.sum(F.when(small, F.col("v_l") + (0 if self_join else F.col("v_r")))),
                            F.count(F.when(~small, 1))).first()

    def of_size(df, which):
        return df.join(sizes.where(which).select(block_key), block_key, "left_semi")

    parts = []
    if rows:
        sides = [of_size(lv, small).withColumn("side", F.lit(0))]
        if not self_join:
            sides.append(of_size(rv, small).withColumn("side", F.lit(1)))
        both = sides[0] if self_join else sides[0].unionByName(sides[1])
        both = both.withColumn("bin", _block(block_key, math.ceil(rows / block_rows)))
        rule = "lt" if self_join else "ne" if exclude_same_id else "all"
        parts.append(_verify_groups(None, both, threshold, id_type, clamp, ["bin"], rule, block_key))
    if large:
        big, other = of_size(lv, ~small), None if self_join else of_size(rv, ~small)
        if threshold <= 0:
            parts.append(_blocks_of_keys(big, other, threshold, block_key, id_type, clamp, exclude_same_id))
        else:
            parts.append(_counted(big, other, order, threshold, extra, id_type, clamp, exclude_same_id, dense_ratio,
                                  order_rows, list_rows))
    if not parts:
        return left.sparkSession.createDataFrame([], _pair_schema(id_type))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _counted(lv: DataFrame, rv: DataFrame | None, order: DataFrame, threshold: float, extra: list[str],
             id_type: T.DataType, clamp: bool, exclude_same_id: bool, dense_ratio: float,
             order_rows: int | None, list_rows: int, whole=None) -> DataFrame:
    """By blocks or by candidates, whichever the counts of prefix terms say, for each blocking key."""
    self_join = rv is None
    rv = lv if self_join else rv
    order_rows = order_rows if order_rows is not None else order.count()
    # the postings are only counted here, and kept where candidates are made of them
    pl = prefix_postings(lv, order, threshold, "doc", [*extra, "blk"], order_rows)
    pr = None if self_join else prefix_postings(rv, order, threshold, "doc", [*extra, "blk"], order_rows)
    counts = keep(_term_counts(pl, pr, ["term_id", *extra]))

    # meetings against pairs, for the whole join or for each blocking key, from counts alone
    size_l = lv.groupBy(*extra).agg(F.count(F.lit(1)).alias("v_l"))
    size_r = rv.groupBy(*extra).agg(F.count(F.lit(1)).alias("v_r"))
    met = counts.groupBy(*extra).agg(F.sum(F.col("n_l").cast("double") * F.col("n_r")).alias("met"))
    sizes = size_l.join(size_r, extra) if extra else size_l.crossJoin(size_r)  # one row each without a key
    rate = met.join(sizes, extra) if extra else met.crossJoin(sizes)
    dense = F.col("met") >= F.lit(dense_ratio) * F.col("v_l") * F.col("v_r")
    if not extra:
        row = rate.select(dense.alias("dense")).first()
        if row["dense"] is None:  # no posting at all
            return lv.sparkSession.createDataFrame([], _pair_schema(id_type))
        if row["dense"]:
            return whole()
        return _by_candidates(lv, rv, keep(pl), pr if pr is None else keep(pr), counts, threshold, extra, id_type, clamp, exclude_same_id, list_rows)
    kinds = keep(rate.select(*extra, dense.alias("dense")))
    of = {r["dense"]: r["n"] for r in kinds.groupBy("dense").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for kind in (True, False):
        if not of.get(kind):
            continue
        own = kinds.where(F.col("dense") == kind).select(*extra)

        def of_kind(df):
            return None if df is None else df if len(of) == 1 else df.join(own, extra, "left_semi")

        if kind:
            parts.append(_blocks_of_keys(of_kind(lv), None if self_join else of_kind(rv), threshold, extra[0],
                                         id_type, clamp, exclude_same_id))
        else:
            parts.append(_by_candidates(of_kind(lv), of_kind(rv), of_kind(pl), of_kind(pr), of_kind(counts),
                                        threshold, extra, id_type, clamp, exclude_same_id, list_rows))
    if not parts:
        return lv.sparkSession.createDataFrame([], _pair_schema(id_type))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _pair_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("a", id_type), T.StructField("b", id_type),
                         T.StructField("similarity", T.DoubleType())])


def _by_candidates(lv: DataFrame, rv: DataFrame, pl: DataFrame, pr: DataFrame | None, counts: DataFrame,
                   threshold: float, extra: list[str], id_type: T.DataType, clamp: bool,
                   exclude_same_id: bool, list_rows: int) -> DataFrame:
    """Sparse case: meetings made distinct per pair of blocks, then verified there."""
    keys = ["ba", "bb", *extra]
    cands = keep(meetings(pl, pr, counts, threshold, extra, exclude_same_id, list_rows).distinct())
    need_l = cands.select(*keys, F.col("a").alias("doc")).distinct()
    need_r = cands.select(*keys, F.col("b").alias("doc")).distinct()
    routed = (need_l.join(lv, ["doc", *extra]).withColumn("side", F.lit(0))
              .unionByName(need_r.join(rv, ["doc", *extra]).withColumn("side", F.lit(1)))
              .select(*keys, "side", "doc", "blk", "term_ids", "weights"))
    routed = routed.toDF(*routed.columns)  # columns of its own, as it descends from the candidates
    return _verify_groups(cands.toDF(*keys, "a", "b"), routed, threshold, id_type, clamp, keys, "all")


def _packed_blocks(lv: DataFrame, rv: DataFrame | None, threshold: float, id_type: T.DataType, clamp: bool,
                   exclude_same_id: bool, sizes: list[int], block_rows: int, best: int | None) -> DataFrame:
    """Dense case without a blocking key: every pair of packed blocks, each vector shuffled once."""
    def rows(n: int) -> int:
        """At most ``block_rows``, and fewer where that gives too few blocks to work on."""
        return min(block_rows, PACKED_ROWS, max(LEAST_ROWS, math.ceil(n / LEAST_BLOCKS)))

    t, cols = float(threshold), ["doc", "term_ids", "weights"]
    together = BLOCKS_TOGETHER if rv is None and sizes[0] > FEW_BLOCKS * rows(sizes[0]) else 1
    one = packed(lv.select(*cols), "doc", sizes[0], rows(sizes[0]), flat_vectors, together)
    two = None if rv is None else packed(rv.select(*cols), "doc", sizes[1], rows(sizes[1]), flat_vectors,
                                         1 if best is None else BLOCKS_TOGETHER)

    def score(x: dict, y: dict, same: bool, least: np.ndarray | None):
        for ia, ib, s in near_sparse(x, y, same, t, least):
            yield ia, ib, np.clip(s, 0.0, 1.0) if clamp else s

    rule = "lt" if rv is None else "ne" if exclude_same_id else "all"
    pairs = pairs_of_blocks(one, two, sizes[0] <= rows(sizes[0]))
    return scored_pairs(pairs, flat_from_bytes, score, id_type, rule, None if rv is None else best)


def _blocks_of_keys(lv: DataFrame, rv: DataFrame | None, threshold: float, key: str, id_type: T.DataType,
                    clamp: bool, exclude_same_id: bool) -> DataFrame:
    """Dense case of a blocking key: every pair of its packed blocks, each vector shuffled and written once.

    Keys of like size go round ``BUNDLES`` bundles; a bundle is joined with itself, and its keys are told apart there.
    """
    spark, t = lv.sparkSession, float(threshold)
    sizes = lv.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if rv is not None:
        sizes = sizes.join(rv.select(key).distinct(), key, "left_semi")
    keys = [r[key] for r in sizes.orderBy(F.desc("_n"), key).select(key).collect()]  # one for each large key
    if not keys:
        return spark.createDataFrame([], _pair_schema(id_type))
    dealt = F.broadcast(spark.createDataFrame([(k, i % BUNDLES) for i, k in enumerate(keys)], T.StructType(
        [T.StructField(key, lv.schema[key].dataType), T.StructField("bundle", T.IntegerType())])))

    def packed_side(side: DataFrame, name: str) -> DataFrame:
        own = side.join(dealt, key).select(key, "bundle", "blk", "doc", "term_ids", "weights")
        return packed_by_key(own, "doc", key, scratch_path(spark, name), flat_vectors)

    one = packed_side(lv, "blocks-left")
    two = None if rv is None else packed_side(rv, "blocks-right")

    def score(x: dict, y: dict, same: bool, least: np.ndarray | None):
        for ia, ib, s in near_sparse(x, y, same, t, least):
            yield ia, ib, np.clip(s, 0.0, 1.0) if clamp else s

    rule = "lt" if rv is None else "ne" if exclude_same_id else "all"
    pairs = pairs_within_keys(one, two, key, list(range(min(BUNDLES, len(keys)))))
    return scored_pairs(pairs, flat_from_bytes, score, id_type, rule)


def collapse_copies(vectors: DataFrame, id_col: str = "doc_id",
                    key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Group identical non-zero vectors (of one ``key``): (representatives, members(rep, member)).

    Identical vectors have identical similarities to everything, so the join runs on one
    representative (the smallest id) per group.  A group's first id comes from a map-side combined
    aggregate over 128 bits of two hashes, joined back, so no task holds a group of copies.
    """
    key = key or []
    nz = vectors.where(F.size("term_ids") > 0)
    same = [*key, "_h", "_g"]
    tagged = keep(nz.select(id_col, *key, F.xxhash64("term_ids", "weights").alias("_h"),
                            F.xxhash64(F.lit("again"), F.reverse("weights"), "term_ids").alias("_g"),
                            F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x * x).alias("self_sim")))
    first = keep(tagged.groupBy(*same).agg(F.min(id_col).alias("rep")))
    members = tagged.join(first, same).select("rep", F.col(id_col).alias("member"), "self_sim")
    ids = first.select(F.col("rep").alias(id_col))
    if isinstance(ids.schema[id_col].dataType, T.NumericType) and first.count() <= REPS_ROWS:
        ids = F.broadcast(ids)  # else both readers of ``reps`` shuffle every vector to look up its id
    return nz.join(ids, id_col, "left_semi"), members


def similar_pairs(vectors: DataFrame, order: DataFrame, threshold: float = 0.7,
                  id_col: str = "doc_id", clusters: DataFrame | None = None,
                  cluster_col: str = "cluster_id", block_rows: int = BLOCK_ROWS,
                  n_docs: int | None = None, collapse: bool = True, sort: bool = True) -> DataFrame:
    """All document pairs with TF-IDF cosine >= threshold (J1), within clusters if given.

    Output (doc1, doc2, similarity) with doc1 < doc2, sorted by similarity desc, doc1, doc2 (T1).
    """
    vecs = vectors
    if clusters is not None:
        # only clustered documents that have vectors take part.
        vecs = vecs.join(clusters.select(id_col, cluster_col), id_col)
    block_key = cluster_col if clusters is not None else None
    members = None
    reps = vecs
    if collapse and threshold > 0:
        # copies in different clusters are not merged: the cluster is part of the identity
        reps, members = collapse_copies(vecs, id_col, [block_key] if block_key else None)
    reps = keep(reps) if block_key else reps
    if members is not None:
        members = keep(members)
    pairs = threshold_join(reps, None, order, threshold, id_col, block_key,
                           n_left=n_docs, n_right=n_docs, block_rows=block_rows)
    if members is not None:
        ma = members.select(F.col("rep").alias("a"), F.col("member").alias("x"))
        mb = members.select(F.col("rep").alias("b"), F.col("member").alias("y"))
        across = (pairs.join(ma, "a").join(mb, "b")
                  .select(F.least("x", "y").alias("doc1"), F.greatest("x", "y").alias("doc2"),
                          "similarity"))
        m1 = members.select("rep", F.col("member").alias("doc1"), "self_sim")
        m2 = members.select("rep", F.col("member").alias("doc2"))
        within = (m1.join(m2, "rep").where(F.col("doc1") < F.col("doc2"))
                  .select("doc1", "doc2", F.least(F.greatest("self_sim", F.lit(0.0)), F.lit(1.0))
                          .alias("similarity"))
                  .where(F.col("similarity") >= F.lit(threshold)))
        out = across.unionByName(within)
    else:
        out = pairs.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), "similarity")
    if not sort:
        return out
    # The verified pairs are few; materialise them so the range partitioner's sampling pass
    # reads them instead of re-running the verification.
    return keep(out).orderBy(F.desc("similarity"), "doc1", "doc2")


def refreshed_pairs(pairs: DataFrame, new_vectors: DataFrame, vectors: DataFrame, order: DataFrame,
                    threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """A pair table (doc1, doc2, similarity) brought up to date after an upsert.

    ``new_vectors`` were added to or replaced in ``vectors`` (which holds them).  Pairs of their ids go,
    pairs of the others are kept as they are, and only the new vectors are joined with all.
    """
    ids = new_vectors.select(id_col).distinct()
    kept = (pairs.join(ids.withColumnRenamed(id_col, "doc1"), "doc1", "left_anti")
                 .join(ids.withColumnRenamed(id_col, "doc2"), "doc2", "left_anti"))
    found = threshold_join(new_vectors, vectors, order, threshold, id_col)
    both = ids.withColumnRenamed(id_col, "b")  # a pair of two new ones is found from either side
    found = found.join(both.withColumn("_new", F.lit(True)), "b", "left").where("_new is null or a < b")
    return kept.select("doc1", "doc2", "similarity").unionByName(found.select(
        F.least("a", "b").alias("doc1"), F.greatest("a", "b").alias("doc2"), "similarity"))
