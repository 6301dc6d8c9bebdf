"""Embedding whitening: exact cross-products from bit planes, centred as integers before ``eigh``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.llm.common import prepare

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Most dimensions: the driver holds one number for each pair of them.
MAX_DIM = 1024
#: Scaled entries beyond this are refused, so that sums of products fit 38 digits.
LIMIT = float(1 << 40)
_ROWS = 4096          # rows whose planes are packed together: 64 words for each plane and dimension
_TILE = 1 << 20       # words that one AND works on


def fixed_point(vectors: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000`` of each entry as int64."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"an entry of {LIMIT / SCALE:g} or more is too large for exact sums")
    return scaled.astype(np.int64) + SHIFT


def _planes(y: np.ndarray, bits: int) -> np.ndarray:
    """(bits, dims, words): bit b of every row's entry, 64 rows to a word."""
    rows, dims = y.shape
    words = -(-rows // 64)
    out = np.zeros((bits, dims, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[b, :, :packed.shape[1]] = packed
    return out.view("<u8")


def scatter(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sums by dimension and the matrix of sums of products (upper triangle counts) of int64 rows.

    Entries are shifted by the least of their dimension, cut into bit planes and packed by row.  The
    product of bit a of one dimension and bit b of another, summed over rows, is the popcount of the
    AND of their words, with weight ``2**(a+b)``.  Everything is integer, so nothing is rounded.
    """
    rows, dims = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    bits = int(y.max()).bit_length()
    kind = np.int64 if 2 * bits + 13 < 62 else object
    planes = _planes(y, bits)
    products = np.zeros((dims, dims), kind)
    sums = np.zeros(dims, object)
    step = max(1, _TILE // max(1, dims * planes.shape[2]))
    for a in range(bits):
        sums += np.bitwise_count(planes[a]).sum(axis=1, dtype=np.int64).astype(object) << a
        for b in range(a, bits):
            met = np.empty((dims, dims), np.int64)
            for at in range(0, dims, step):
                met[at:at + step] = np.bitwise_count(
                    planes[a][at:at + step, None, :] & planes[b][None, :, :]).sum(axis=2, dtype=np.int64)
            both = (met if a == b else met + met.T).astype(kind)
            products += both * (1 << (a + b))
    low = low.astype(object)
    shifted = np.outer(low, sums)
    return list(sums + rows * low), products.astype(object) + shifted + shifted.T + rows * np.outer(low, low)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)


def _gram(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, sums of products) over all rows, exact; dim * (dim + 3) / 2 numbers are collected."""
    upper = np.triu_indices(dim)

    def run(batches):
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for pdf in batches:
            for at in range(0, len(pdf), _ROWS):
                x = fixed_point(np.stack(pdf["v"].iloc[at:at + _ROWS].to_numpy()))
                s, p = scatter(x)
                n, sums, products = n + len(x), sums + np.array(s, object), products + p
        if n:
            i = np.concatenate(([-1], np.full(dim, -1), upper[0]))
            j = np.concatenate(([-1], np.arange(dim), upper[1]))
            v = [n, *sums, *products[upper]]
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": list(map(str, v))})

    parts = rows.select("v").mapInPandas(run, "i int, j int, v string")
    found = (parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
                  .collect())
    n, sums, products = 0, [0] * dim, np.zeros((dim, dim), object)
    for r in found:
        if r["i"] >= 0:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
        elif r["j"] >= 0:
            sums[r["j"]] = int(r["v"])
        else:
            n = int(r["v"])
    return n, sums, products


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates, a row ``(vec_id, component, n, deviation, whitened, explained,
    identity_error)`` for each vector and component, numbered from 1 by falling eigenvalue.

    ``x = floor(1024 * c) + 100000``; the covariance ``V = (n * sum(x x') - S S') / n**2`` is an exact
    integer matrix up to the last division.  ``deviation`` (decimal) is the exact sum over dimensions
    of ``(n * x - S)**2``.  A component's sign makes its entry of largest size (the first of equal
    ones) positive.

    Rows whose vector is null, empty or holds null, NaN or infinite entries take no part, nor do
    vectors whose length is not the table's commonest (of equally common ones the greatest).  A null
    id keeps its row, repeated rows count each; other columns are ignored.  A component without
    variance (all rows alike, or fewer rows than components) has null ``whitened`` and is left out of
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null.  An empty
    table gives an empty result.  Entries of 2**30 or more in size, or over ``MAX_DIM`` dimensions,
    are an error.
    """
    prepare(df.sparkSession)
    rows = _usable(df, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    result = T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    if sizes is None:
        return df.sparkSession.createDataFrame([], result)
    dim = sizes["dim"]
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions; at most {MAX_DIM}")
    rows = rows.where(F.size("v") == dim)
    n, sums, products = _gram(rows, dim)

    total = np.array(sums, object)
    centred = n * products - np.outer(total, total)  # n**2 times the covariance
    cov = np.array([[c / (n * n) for c in line] for line in centred], np.float64)
    trace = sum(centred[i, i] for i in range(dim)) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    most = min(components, dim)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(most)] < 0, -1.0, 1.0)
    alive = values > dim * np.finfo(np.float64).eps * max(values[0], 0.0)

    base = np.array([s // n for s in sums], np.int64)   # whole part of the mean
    rest = [s - n * int(b) for s, b in zip(sums, base)]  # n times its fraction
    rest_sq = sum(t * t for t in rest)
    project = vectors / np.sqrt(np.where(alive, values, 1.0))
    mean = np.array([t / n for t in rest])

    @F.pandas_udf("deviation string, w array<double>")
    def project_rows(vs: pd.Series) -> pd.DataFrame:
        z = fixed_point(np.stack(vs.to_numpy()) if len(vs) else np.zeros((0, dim))) - base
        wide = int(np.abs(z).max(initial=1))
        whole = z if wide * max(wide, n) * dim < 1 << 62 else z.astype(object)
        square = (whole * whole).sum(axis=1).astype(object)
        cross = (whole @ np.array(rest, whole.dtype)).astype(object)
        dev = n * n * square - 2 * n * cross + rest_sq  # sum of (n z - rest)**2
        return pd.DataFrame({"deviation": list(map(str, dev)), "w": list((z - mean) @ project)})

    white = rows.select("vec_id", project_rows("v").alias("p")).select("vec_id", "p.deviation", "p.w")
    used = np.flatnonzero(alive).tolist()
    error = None
    if used:
        at = [(a, b) for a in used for b in used if a <= b]
        got = white.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in at]).first()
        error = max(abs(c - (a == b)) for c, (a, b) in zip(got, at))
    explained = [max(0.0, v) / trace if trace > 0 else None for v in values.tolist()]
    per = F.array(*[F.struct(F.lit(k + 1).alias("component"),
                             (F.col("w")[k] if alive[k] else F.lit(None).cast("double")).alias("whitened"),
                             F.lit(explained[k]).cast("double").alias("explained"))
                    for k in range(most)])
    return (white.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"),
                         F.explode(per).alias("c"))
                 .select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation",
                         "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error")))
