"""Joins of packed blocks: every pair of blocks is scored, and no vector is shuffled more than once.

A side is dealt evenly to blocks of at most about ``rows`` vectors, and a block is one row: its ids and
its numbers as bytes.  A nested-loop join of the two sides then hands a task one pair of partitions, which
it reads where they are, so what is written grows with the input though every two blocks meet.  Where
only the best hits of a row count, a partition of the right side holds several blocks and a task
passes on the best of all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.session import keep

OUT_ROWS = 1 << 18     # rows of a batch that a task hands on
BLOCKS_PER_PART = 8    # blocks of the right side that one task compares, where only the best hits count
HELD_ROWS = 1 << 18    # new hits, beside as many as it has, after which a task keeps the best of them
ROUND_SLACK = 1e-4     # scores are ranked by four decimals


def packed(df: DataFrame, id_col: str, n: int, rows: int, encode, per_part: int = 1,
           together: list | None = None) -> DataFrame:
    """(blk, ids, *binary columns): the rows of ``df`` in blocks of at most about ``rows``.

    ``encode``: function of a pandas frame that returns {column: numpy array}; its keys are asked of an
    empty frame.  Rows are dealt out evenly, or in the order of ``together`` (the first of them a column).
    """
    names = list(encode(None))
    schema = T.StructType([T.StructField("blk", T.LongType()),
                           T.StructField("ids", T.ArrayType(df.schema[id_col].dataType))]
                          + [T.StructField(c, T.BinaryType()) for c in names])
    blocks = max(1, math.ceil(n / rows))
    first = together[0] if together else None

    def pack(batches):
        from pyspark import TaskContext
        part, held, size, at = TaskContext.get().partitionId(), [], 0, 0

        def block(frame):
            frame = frame.sort_values(first, kind="stable") if first else frame
            numbers = encode(frame)
            return pd.DataFrame({"blk": [(part << 20) + at], "ids": [frame[id_col].to_numpy()],
                                 **{c: [np.ascontiguousarray(numbers[c]).tobytes()] for c in names}})

        for pdf in batches:
            while per_part > 1 and size + len(pdf) > rows:
                cut = rows - size
                held.append(pdf.iloc[:cut])
                pdf = pdf.iloc[cut:]
                yield block(pd.concat(held, ignore_index=True))
                held, size, at = [], 0, at + 1
            if len(pdf):
                held.append(pdf)
                size += len(pdf)
        if size:
            yield block(pd.concat(held, ignore_index=True))

    parts = math.ceil(blocks / per_part)
    dealt = df.repartition(parts) if together is None else df.repartitionByRange(parts, *together)
    return keep(dealt.mapInPandas(pack, schema))


def packed_by_key(df: DataFrame, id_col: str, key: str, path: str, encode) -> DataFrame:
    """(key, blk, ids, *binary columns) of ``df`` (id, key, bundle, blk, ...), one row for each key and ``blk``.

    The blocks are written to ``path``, a file each, by ``bundle``, so that a bundle is read without the others.
    """
    names = list(encode(None))
    fields = [T.StructField(c, df.schema[c].dataType) for c in (key, "bundle", "blk")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(df.schema[id_col].dataType))]
                          + [T.StructField(c, T.BinaryType()) for c in names])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, one = encode(frame), frame.iloc[:1]
        return pd.DataFrame({key: one[key], "bundle": one["bundle"], "blk": one["blk"], "ids": [frame[id_col].to_numpy()],
                             **{c: [np.ascontiguousarray(numbers[c]).tobytes()] for c in names}})

    # dealt by block, or the rows of a key would stay in the one task that an earlier join put them in
    blocks = df.repartition(key, "blk").groupBy(key, "bundle", "blk").applyInPandas(pack, schema)
    blocks.write.option("maxRecordsPerFile", 1).partitionBy("bundle").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def pairs_within_keys(left: DataFrame, right: DataFrame | None, key: str, bundles: list[int]) -> DataFrame:
    """``pairs_of_blocks`` of the blocks that agree in ``key``, from ``packed_by_key``: one join for each bundle."""
    out = None
    for bundle in bundles:
        a, b = ((left if x is None else x).where(F.col("bundle") == bundle).drop("bundle") for x in (left, right))
        a = a.toDF(*[f"a_{c}" for c in a.columns])
        b = b.toDF(*[f"b_{c}" for c in b.columns]).hint("shuffle_replicate_nl")
        same = F.col(f"a_{key}") == F.col(f"b_{key}")
        pairs = a.join(b, same & (F.col("a_blk") <= F.col("b_blk")) if right is None else same)
        pairs = pairs.drop(f"a_{key}", f"b_{key}")
        out = pairs if out is None else out.unionAll(pairs)
    return out


def pairs_of_blocks(left: DataFrame, right: DataFrame | None, single: bool) -> DataFrame:
    """One row for each pair of blocks, columns with ``a_`` and ``b_`` before them.

    A self-join (``right=None``) forms an unordered pair once; ``single``: it has one block, so none is joined.
    """
    a = left.toDF(*[f"a_{c}" for c in left.columns])
    if right is None and single:
        return a.select("*", *[F.col(f"a_{c}").alias(f"b_{c}") for c in left.columns])
    other = left if right is None else right
    b = other.toDF(*[f"b_{c}" for c in other.columns]).hint("shuffle_replicate_nl")
    return a.join(b, F.col("a_blk") <= F.col("b_blk")) if right is None else a.crossJoin(b)


def best_hits(ia: np.ndarray, ids: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """Positions of hits that can be among a row's best ``limit`` by score to four decimals, then id.

    A score next to the middle of two decimals may be rounded either way, so such hits stay and push none out.
    """
    if not len(ia):
        return np.zeros(0, np.int64)
    scaled = scores * 1e4 + 0.5
    points = np.floor(scaled)
    unsure = np.minimum(scaled - points, points + 1 - scaled) < 1e-6
    sure = np.flatnonzero(~unsure)
    own = ids[sure] if ids.dtype != object else pd.factorize(ids[sure], sort=True)[0]
    order = sure[np.lexsort((own, -points[sure], ia[sure]))]
    row = ia[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate((first, [len(row)]))))
    return np.concatenate((order[place < limit], np.flatnonzero(unsure)))


def scored_pairs(pairs: DataFrame, decode, score, id_type: T.DataType, rule: str, best: int | None = None) -> DataFrame:
    """(a, b, similarity) of ``pairs_of_blocks``.

    ``decode(bytes by column) -> block``; ``score(left, right, same, least) -> slices of (rows, rows, scores)``,
    where ``same`` tells that a self-join meets a block with itself and ``least`` is None or the least score that
    still counts, by row of the left block.  ``rule``: "lt" for a self-join, "ne" without equal ids, "all".
    ``best``: only hits that can be among the best so many of a left row need to be returned.
    """
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type),
                           T.StructField("similarity", T.DoubleType())])
    names = [c[2:] for c in pairs.columns if c.startswith("a_") and c not in ("a_blk", "a_ids")]

    def run(batches):
        arrow_type = None
        held, cut, held_blk, held_ids = [], None, None, None
        last_a, last_side = None, None

        def out(a, b, s):
            for at in range(0, len(s), OUT_ROWS):
                cols = [pa.array(x[at:at + OUT_ROWS], kind) for x, kind in ((a, arrow_type), (b, arrow_type), (s, pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "similarity"])

        def flush():
            if held:
                ia, b, s = (np.concatenate(x) for x in zip(*held))
                yield from out(held_ids[ia], b, s)

        def pruned(held, cut):
            """The best hits so far; ``cut`` becomes what a row's next hits must reach."""
            if not held:
                return held
            ia, b, s = (np.concatenate(x) for x in zip(*held))
            top = best_hits(ia, b, s, best)
            ia, b, s = ia[top], b[top], s[top]
            full = np.flatnonzero(np.bincount(ia, minlength=len(cut)) >= max(best, 1))
            least = np.full(len(cut), np.inf)
            np.minimum.at(least, ia, s)
            cut[full] = least[full] - ROUND_SLACK
            return [(ia, b, s)]

        for batch in batches:
            for i in range(batch.num_rows):
                def side(p):
                    ids = batch.column(f"{p}_ids")[i].values
                    return ids, decode({c: batch.column(f"{p}_{c}")[i].as_buffer() for c in names})
                blk_a, blk_b = batch.column("a_blk")[i].as_py(), batch.column("b_blk")[i].as_py()
                if blk_a != last_a:
                    last_a, last_side = blk_a, side("a")
                (ids_a, left), same = last_side, rule == "lt" and blk_a == blk_b
                arrow_type = ids_a.type
                ids_b, right = (ids_a, left) if same else side("b")
                ids_a, ids_b = (x.to_numpy(zero_copy_only=False) for x in (ids_a, ids_b))
                if best is not None and blk_a != held_blk:
                    yield from flush()
                    held, cut, held_blk, held_ids = [], np.full(len(ids_a), -np.inf), blk_a, ids_a
                for ia, ib, s in score(left, right, same, cut):
                    a, b = ids_a[ia], ids_b[ib]
                    if rule == "lt":  # rows of one block come once, in either order
                        a, b = np.where(a < b, a, b), np.where(a < b, b, a)
                    kept = a != b if rule != "all" else slice(None)
                    if best is None:
                        yield from out(a[kept], b[kept], s[kept])
                    else:
                        held.append((ia[kept], b[kept], s[kept]))
                        if sum(len(x[0]) for x in held[1:]) > HELD_ROWS + len(held[0][0]):
                            held = pruned(held, cut)
                if best is not None:
                    held = pruned(held, cut)
        yield from flush()

    return pairs.mapInArrow(run, schema)


# --------------------------------------------------------------------------------- sparse vectors
SKETCH = 1024         # groups of terms whose norms bound a cosine
SKETCH_SLACK = 1e-4   # more than the rounding of their float32 products
SLICE = 512           # rows of the left block at a time
GATHER = 200_000      # numbers gathered at a time
CELLS = 1_000_000     # numbers of a dense part at a time
TERM_TABLE = 1 << 20  # term ids up to which a block's terms are numbered by a table


def flat_vectors(frame: pd.DataFrame | None) -> dict[str, np.ndarray]:
    """Sparse vectors of a frame as three arrays: terms, weights, and where each row starts and the last one ends."""
    if frame is None or not len(frame):
        return {"terms": np.zeros(0, np.int32), "weights": np.zeros(0), "ends": np.zeros(1, np.int64)}
    ends = np.concatenate(([0], np.cumsum([len(x) for x in frame["term_ids"]]))).astype(np.int64)
    return {"terms": np.concatenate(frame["term_ids"].to_numpy()).astype(np.int32),
            "weights": np.concatenate(frame["weights"].to_numpy()).astype(np.float64), "ends": ends}


def flat_from_bytes(parts: dict) -> dict[str, np.ndarray]:
    kinds = {"terms": np.int32, "weights": np.float64, "ends": np.int64}
    return {c: np.frombuffer(parts[c], kinds[c]) for c in kinds}


def _fill(out: np.ndarray, v: dict, cols: np.ndarray, start: int, stop: int, clear: bool = False) -> np.ndarray:
    """Rows ``start`` to ``stop`` put into a dense matrix of zeros, or taken out again; ``cols``: columns of all terms."""
    own = slice(v["ends"][start], v["ends"][stop])
    row = np.repeat(np.arange(stop - start), np.diff(v["ends"][start:stop + 1]))
    out[row, cols[own]] = 0.0 if clear else v["weights"][own]
    return out[:stop - start]


def _sketch(v: dict, start: int, stop: int) -> np.ndarray:
    """Norm of each of these rows within each of ``SKETCH`` groups of terms, a slice of rows at a time."""
    out = np.empty((stop - start, SKETCH), np.float32)
    for at in range(start, stop, SLICE):
        to = min(stop, at + SLICE)
        own = slice(v["ends"][at], v["ends"][to])
        row, w = np.repeat(np.arange(to - at) * SKETCH, np.diff(v["ends"][at:to + 1])), v["weights"][own]
        sums = np.bincount(row + v["terms"][own] % SKETCH, w * w, (to - at) * SKETCH)
        out[at - start:to - start] = np.sqrt(sums).reshape(to - at, SKETCH)
    return out


def _columns(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms of two blocks numbered from 0 without gaps, and how many they are."""
    top = 1 + max((int(v["terms"].max()) for v in (left, right) if len(v["terms"])), default=-1)
    if top > TERM_TABLE:
        terms = np.unique(np.concatenate((left["terms"], right["terms"])))
        return np.searchsorted(terms, left["terms"]), np.searchsorted(terms, right["terms"]), len(terms)
    used = np.zeros(top, bool)
    used[left["terms"]] = used[right["terms"]] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    return place[left["terms"]], place[right["terms"]], int(used.sum())


def _dots(dense: np.ndarray, ia: np.ndarray, right: dict, cols: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Products of rows ``ia`` of a dense matrix with the sparse rows ``ib``."""
    lens, starts = np.diff(right["ends"])[ib], right["ends"][ib]
    out, before = np.zeros(len(ib)), np.concatenate(([0], np.cumsum(lens)))
    at = 0
    while at < len(ib):
        to = max(at + 1, int(np.searchsorted(before, before[at] + GATHER, "right")) - 1)
        n = lens[at:to]
        own = np.arange(before[to] - before[at]) + np.repeat(starts[at:to] - before[at:to] + before[at], n)
        some = np.flatnonzero(n)
        if len(some):
            products = dense.ravel()[np.repeat(ia[at:to] * dense.shape[1], n) + cols[own]] * right["weights"][own]
            out[at + some] = np.add.reduceat(products, (before[at:to] - before[at])[some])
        at = to
    return out


def near_sparse(left: dict, right: dict, same: bool, t: float, least: np.ndarray | None = None):
    """Slices (rows of left, rows of right, cosine) of the pairs of unit vectors with cosine >= t, exactly.

    A cosine is at most the product of the two rows' norms by groups of terms (Cauchy-Schwarz in each
    group): one short matrix product tells which pairs need their own one.  Where that leaves many, a
    product of whole rows does.  ``same``: a block with itself, each pair of rows once.
    """
    na, nb = len(left["ends"]) - 1, len(right["ends"]) - 1
    ca, cb, width = _columns(left, right)
    width = max(1, width)
    bound_by = t > 0
    if bound_by:
        sb = _sketch(right, 0, nb)
        if not same and "sketch" not in left:  # a task meets the same left block several times
            left["sketch"] = _sketch(left, 0, na)
    step = max(1, min(SLICE, CELLS // width))
    dense = np.zeros((min(step, na), width))
    other = None
    for at in range(0, na, SLICE):
        to, first = min(na, at + SLICE), at if same else 0
        many = True
        if bound_by:
            sa = sb[at:to] if same else left["sketch"][at:to]
            flat = np.flatnonzero(sa @ sb[first:].T >= np.float32(t - SKETCH_SLACK))
            ia, ib = np.divmod(flat, nb - first)
            ib += first
            many = len(ia) * 4 > (to - at) * (nb - first)
        for lo in range(at, to, step):
            hi = min(to, lo + step)
            mine = _fill(dense, left, ca, lo, hi)
            if many:
                found = []
                rough = mine.astype(np.float32) if bound_by else mine
                other = np.zeros((min(step, nb), width), rough.dtype) if other is None else other
                for b_lo in range(first, nb, step):
                    b_hi = min(nb, b_lo + step)
                    products = rough @ _fill(other, right, cb, b_lo, b_hi).T
                    _fill(other, right, cb, b_lo, b_hi, clear=True)
                    x, y = np.nonzero(products >= (t - 1e-3 if bound_by else t))
                    found.append((x, y + b_lo, products[x, y]))
                x, y, s = (np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            else:
                inside = slice(*np.searchsorted(ia, (lo - at, hi - at)))
                x, y = ia[inside] - (lo - at), ib[inside]
            if same:
                upper = x + lo < y
                x, y = x[upper], y[upper]
                s = s[upper] if many else None
            if bound_by or not many:
                s = _dots(dense, x, right, cb, y)
            _fill(dense, left, ca, lo, hi, clear=True)
            x = x + lo
            ok = s >= (t if least is None else np.maximum(t, least[x]))
            if ok.any():
                yield x[ok], y[ok], s[ok]
