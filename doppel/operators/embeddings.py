"""Dense embeddings: encoder, cosine, threshold joins and search.

Encoder (M4)
------------
The reference runs a sentence-transformer; no model ships here, so the built-in encoder is
*signed feature hashing* of the TF tokens: each term hashes (md5) to one of ``dim`` buckets and
a sign, counts are summed per bucket and the vector is L2-normalised.  A worker hashes a term once;
one numpy ``bincount`` for a part of an Arrow batch assembles the vectors.  ``idf_embeddings`` hashes
TF-IDF weights to 384 buckets instead, and tells texts apart better.  Any other encoder can be
plugged in as a pandas function through ``encode_with``.

Exact threshold join (J4, J10)
------------------------------
Every pair that can qualify is scored once, in pairs of packed blocks (``blocks``), so no vector is
shuffled more than once:

* Pivots drawn from the data (a bounded number) cut the unit sphere into cells, and cells lie together
  in a block.  Angular distance is a metric, so two cells meet only if the angle between their pivots is
  at most ``acos(t)`` plus both cells' radii.  A self-join forms an unordered pair of blocks once.
* Vectors are rotated to the principal axes of the data (products stay the same).  Inside a group
  ``x.y <= lead(x).lead(y) + |rest(x)| |rest(y)|`` (Cauchy-Schwarz on what follows the leading
  coordinates): one short matrix product tells which pairs need the long one.

At ``t <= 0`` every pair is scored, zero vectors included; so is the similarity matrix (J5).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.functions.text import bag_of_words_batched, slices
from doppel.operators.blocks import BLOCKS_PER_PART, packed, pairs_of_blocks, scored_pairs
from doppel.operators.tfidf import LOOKUP_ROWS
from doppel.session import drop_kept, keep

ANGLE_EPS = 1e-9
MAX_PIVOTS = 1024  # and so at most its square of pairs of cells on the driver
MAX_DIM = 1024     # the rotation is a matrix of so many rows and columns
LEAD_SHARE = 4     # a fourth of the coordinates lead
BLOCK_BYTES = 4 << 20   # of the vectors of a block
CELLS_PER_BLOCK = 8     # and at most so many times the rows of a cell
SLICE_PAIRS = 1 << 20   # products at a time
ENCODE_ROWS = 512       # documents that an encoder gets at a time
FULL_DIM = 128          # dimensions up to which a rough product of whole vectors is as cheap as one of leading coordinates
ROUGH = 1e-4            # more than the rounding of a float32 product of unit vectors
TIE = 1e-12             # more than the rounding of a float64 one: a product that is t itself is never lost by it
WHOLE_SHARE = 0.5       # of the pairs of two blocks, beyond which cells are not told apart
QUERY_ROWS, QUERY_BLOCKS = 1024, 16  # queries are cut to so many blocks, but to none of fewer rows


# --------------------------------------------------------------------------------- cosine
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_embedding(a: Column, b: Column) -> Column:
    """Cosine without clamping; 0.0 if either vector is zero; a length mismatch is an error."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")
    na, nb = l2(a), l2(b)
    return (F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding length mismatch")))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(dot(a, b) / (na * nb)))


def cosine_tfidf_dense(a: Column, b: Column) -> Column:
    """P6 on dense arrays: 0.0 on a length mismatch or a zero vector, clamped to [0, 1]."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")
    na, nb = l2(a), l2(b)
    raw = dot(a, b) / (na * nb)
    return (F.when(F.size(a) != F.size(b), F.lit(0.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))))


# --------------------------------------------------------------------------------- encoder (M4)
def _term_hash(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def hash_embeddings(docs: DataFrame, dim: int = 64, id_col: str = "doc_id",
                    text_col: str = "content") -> DataFrame:
    """M4 built-in encoder -> (id, embedding ARRAY<DOUBLE>), unit norm (zero if no tokens)."""
    places = _TermPlaces(dim)

    def encode(bags: pa.StructArray) -> pa.Array:
        terms, lens = bags.field("terms"), np.diff(bags.field("terms").offsets.to_numpy())
        texts = terms.flatten().dictionary_encode()  # a term is a Python object once for each part
        bucket, sign = places.of(texts.dictionary.to_pylist())
        code, row = texts.indices.to_numpy(), np.repeat(np.arange(len(lens)) * dim, lens)
        signed = sign[code] * bags.field("counts").flatten().to_numpy()
        mat = np.bincount(row + bucket[code], signed, len(lens) * dim).astype(np.float64).reshape(len(lens), dim)
        norms = np.sqrt((mat * mat).sum(axis=1))
        mat /= np.where(norms == 0, 1.0, norms)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lens) + 1, dtype=np.int32) * dim), pa.array(mat.ravel()))

    @F.arrow_udf("array<double>")
    def embed(bags: pa.Array) -> pa.Array:
        return pa.concat_arrays([encode(x) for x in slices(bags, ENCODE_ROWS)])

    # the bag goes from one function to the next in one Python worker; not deterministic by name only, as a filter
    # on the vectors would else be pushed below them and encode every text a second time
    return docs.select(id_col, embed.asNondeterministic()(bag_of_words_batched(text_col)).alias("embedding"))


class _TermPlaces:
    """Bucket and sign of terms by md5, as ``_term_hash`` has them; a worker remembers a bounded number."""

    def __init__(self, dim: int, most: int = 100_000):
        self.dim, self.most, self.known = dim, most, {}

    def of(self, terms) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        for t in terms:
            if t not in self.known:
                h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                self.known[t] = h % self.dim, 1 if h // self.dim % 2 == 0 else -1
        both = np.array([self.known[t] for t in terms], np.int64).reshape(len(terms), 2)
        return both[:, 0], both[:, 1]


def _bincount_encoder(dim: int):
    def encode(pdf: pd.DataFrame) -> np.ndarray:
        n = len(pdf)
        lens = pdf["buckets"].map(len).to_numpy()
        if lens.sum() == 0:
            return np.zeros((n, dim))
        b = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["buckets"]])
        v = np.concatenate([np.asarray(x, dtype=np.float64) for x in pdf["signed"]])
        row = np.repeat(np.arange(n), lens)
        mat = np.bincount(row * dim + b, weights=v, minlength=n * dim).reshape(n, dim)
        norms = np.sqrt((mat * mat).sum(axis=1))
        norms[norms == 0] = 1.0
        return mat / norms[:, None]
    return encode


def idf_embeddings(vectors: DataFrame, vocabulary: DataFrame, dim: int = 384, id_col: str = "doc_id") -> DataFrame:
    """M4 with idf: signed feature hashing of TF-IDF weights -> (id, embedding), unit norm (zero if no term).

    Frequent words carry little weight here, so texts on one subject lie closer than texts in one language.
    A term's bucket and sign are looked up in the tasks (checked); those of a larger vocabulary are joined.
    """
    h = _term_hash(F.col("term"))
    places = vocabulary.select("term_id", F.pmod(h, F.lit(dim)).cast("int").alias("bucket"), F.when(
        F.pmod(F.floor(h / F.lit(dim)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"))
    if vocabulary.count() > LOOKUP_ROWS:
        from doppel.operators.tfidf import explode_vectors
        parts = (explode_vectors(vectors, id_col).join(places, "term_id").groupBy(id_col, "bucket")
                 .agg(F.sum(F.col("weight") * F.col("sign")).alias("v")))
        lists = parts.groupBy(id_col).agg(F.collect_list("bucket").alias("buckets"),  # at most dim of them
                                          F.collect_list("v").alias("signed"))
        none = F.array()
        rows = vectors.select(id_col).join(lists, id_col, "left").select(
            id_col, F.coalesce("buckets", none.cast("array<int>")).alias("buckets"),
            F.coalesce("signed", none.cast("array<double>")).alias("signed"))
        return encode_with(rows, _bincount_encoder(dim), id_col)
    known = places.toPandas()  # within the bound
    size = int(known["term_id"].max()) + 1 if len(known) else 1
    bucket, sign = np.zeros(size, np.int32), np.zeros(size)
    bucket[known["term_id"]], sign[known["term_id"]] = known["bucket"], known["sign"]
    shared, add_up = vectors.sparkSession.sparkContext.broadcast((bucket, sign)), _bincount_encoder(dim)

    def encode(pdf: pd.DataFrame) -> np.ndarray:
        bucket, sign = shared.value
        ids = [np.asarray(x, np.int64) for x in pdf["term_ids"]]
        return add_up(pd.DataFrame({"buckets": [bucket[x] for x in ids],
                                    "signed": [sign[x] * w for x, w in zip(ids, pdf["weights"])]}))

    return encode_with(vectors.select(id_col, "term_ids", "weights"), encode, id_col)


def idf_encoder(model, dim: int = 384):
    """``docs (id, content) -> (id, embedding)`` by ``idf_embeddings`` with a fitted model's idf."""
    def encode(docs: DataFrame, id_col: str | None = None) -> DataFrame:
        id_col = id_col or model.id_col
        return idf_embeddings(model.transform(docs, id_col), model.vocabulary, dim, id_col)
    return encode


def encode_with(df: DataFrame, encoder, id_col: str = "doc_id") -> DataFrame:
    """Run ``encoder(pandas batch) -> ndarray (rows x dim)`` over Arrow batches (pluggable M4).

    The encoder gets at most ``ENCODE_ROWS`` rows at a time, so that few of them are Python objects.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type),
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                mat = np.ascontiguousarray(encoder(part.to_pandas()), np.float64)
                ends = pa.array(np.arange(len(mat) + 1, dtype=np.int32) * mat.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.ListArray.from_arrays(ends, pa.array(mat.ravel()))],
                                                 names=[id_col, "embedding"])

    return df.mapInArrow(run, schema)


# --------------------------------------------------------------------------------- joins
def _unit(emb: DataFrame, id_col: str, vec_col: str, zeros: bool = False) -> DataFrame:
    """(id, u): unit vectors; zero vectors are left out or, with ``zeros``, kept as they are."""
    v = F.col(vec_col).cast("array<double>")
    rows = emb.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("n", l2(F.col("v")))
    rows = rows.where(F.col("n").isNotNull()) if zeros else rows.where(F.col("n") > 0)
    return rows.select("id", F.when(F.col("n") > 0, F.transform("v", lambda x: F.try_divide(x, F.col("n"))))
                       .otherwise(F.col("v")).alias("u"))


def _principal_axes(df: DataFrame) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of the vectors ``u``, strongest first."""
    first = df.select("u").first()
    dim = len(first["u"]) if first else 0
    if dim <= FULL_DIM or dim > MAX_DIM:
        return np.eye(dim)

    def moments(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                u = np.stack(pdf["u"].to_numpy())
                total += u.T @ u
        yield pd.DataFrame({"m": [total.ravel()]})

    parts = df.select("u").mapInPandas(moments, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    got = parts.groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # dim * dim numbers
    total = np.zeros(dim * dim)
    total[got["at"].to_numpy()] = got["v"].to_numpy()
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1]


def _place(df: DataFrame, pivots: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, u) -> (id, z, cell, r): rotated vector, cell of the nearest pivot and the angle to it."""
    id_type = df.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("z", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast((pivots, axes))  # both bounded

    def angles(batches):
        piv, rot = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at:at + 1024]
                u = np.stack(some["u"].to_numpy())
                ang = np.arccos(np.clip(u @ piv.T, -1.0, 1.0))
                cell = np.argmin(ang, axis=1)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "z": list(u @ rot), "cell": cell.astype(np.int32),
                                    "r": ang[np.arange(len(u)), cell]})

    return df.select("id", "u").mapInPandas(angles, schema)


def same_id_type(left: DataFrame, right: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ids of one type: texts if either has texts, else long where they differ."""
    kinds = left.schema[id_col].dataType, right.schema[id_col].dataType
    if kinds[0] == kinds[1]:
        return left, right
    kind = T.StringType() if T.StringType() in kinds else T.LongType()
    return tuple(x.withColumn(id_col, F.col(id_col).cast(kind)) for x in (left, right))


def _vector_blocks(frame: pd.DataFrame | None) -> dict[str, np.ndarray]:
    """Placed rows as a matrix and the cell of each row, cells together."""
    if frame is None or not len(frame):
        return {"z": np.zeros(0), "cell": np.zeros(0, np.int32)}
    return {"z": np.stack(frame["z"].to_numpy()), "cell": frame["cell"].to_numpy(np.int32)}


def _vector_blocks_from_bytes(parts: dict) -> tuple[np.ndarray, np.ndarray]:
    cell, z = np.frombuffer(parts["cell"], np.int32), np.frombuffer(parts["z"], np.float64)
    return z.reshape(len(cell), len(z) // max(1, len(cell))), cell


def _block_pairs(left: DataFrame, right: DataFrame | None, threshold: float, id_col: str, vec_col: str,
                 n_pivots: int | None, cell_rows: int, best: int | None = None):
    """Pairs of blocks of placed rows and which cells may meet (a broadcast matrix), None if a side is empty."""
    zeros = threshold <= 0
    # read several times before they are placed, and an encoder's run is most of the work
    lu = keep(_unit(left, id_col, vec_col, zeros))
    ru = lu if right is None else keep(_unit(right, id_col, vec_col, zeros))
    n_right = ru.count()
    n_left = n_right if right is None else lu.count()
    if n_right == 0 or n_left == 0:
        return None
    p = n_pivots or max(1, min(MAX_PIVOTS, math.ceil(n_right / cell_rows)))
    # Pivots: the p vectors with the smallest id hash -- deterministic and bounded (p x dim).
    chosen = ru.select("u", F.xxhash64("id").alias("h")).orderBy("h").limit(p).toPandas()["u"]
    pivots = np.stack(chosen.to_numpy()).astype(np.float64)
    axes = _principal_axes(ru)

    def cells(df: DataFrame):
        """Placed rows and each cell's radius (a row a cell reaches the driver)."""
        df = keep(_place(df, pivots, axes))
        radius = np.full(len(pivots), -1.0)
        for r in df.groupBy("cell").agg(F.max("r").alias("r")).collect():
            radius[r["cell"]] = r["r"]
        return df, radius

    x, rx = cells(lu)
    y, ry = (x, rx) if right is None else cells(ru)
    for done in (lu, ru):
        drop_kept(done)
    may = (rx >= 0)[:, None] & (ry >= 0)[None, :]
    if threshold > 0:  # a zero vector has no angle, and nothing can be left out
        theta = math.acos(max(-1.0, min(1.0, threshold)))
        apart = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
        may &= apart <= theta + rx[:, None] + ry[None, :] + ANGLE_EPS
    rows = max(1, min(CELLS_PER_BLOCK * cell_rows, BLOCK_BYTES // (8 * max(1, pivots.shape[1]))))

    def blocks(df: DataFrame, n: int, per_part: int = 1, rows: int = rows) -> DataFrame:
        return packed(df.select("id", "z", "cell"), "id", n, rows, _vector_blocks, per_part, ["cell", F.xxhash64("id")])

    one = blocks(x, n_left, 1, rows if right is None else min(rows, max(QUERY_ROWS, math.ceil(n_left / QUERY_BLOCKS))))
    two = None if right is None else blocks(y, n_right, 1 if best is None else BLOCKS_PER_PART)
    return pairs_of_blocks(one, two, n_left <= rows), left.sparkSession.sparkContext.broadcast(may)


def _near_vectors(left: tuple, right: tuple, same: bool, t: float, may: np.ndarray, least: np.ndarray | None = None):
    """Slices (rows of left, rows of right, products, pairs that met, products made) of two blocks.

    A cell of the left block meets the right block's rows in the cells that it may reach; where most may be
    reached, the whole blocks meet.
    """
    (za, ca), (zb, cb) = left, right
    starts = np.flatnonzero(np.concatenate(([True], ca[1:] != ca[:-1]))) if len(ca) else np.zeros(0, np.int64)
    ends = np.concatenate((starts[1:], [len(ca)])).astype(np.int64)
    reach = may[ca[starts]] @ np.bincount(cb, minlength=may.shape[1])
    whole = ((ends - starts) * reach).sum() > WHOLE_SHARE * len(ca) * len(cb)
    for at, to in [(0, len(ca))] if whole else zip(starts, ends):
        reached = np.arange(len(cb)) if whole else np.flatnonzero(may[ca[at], cb])
        reached = reached[reached >= at] if same else reached
        if not len(reached):
            continue
        other = zb if whole else zb[reached]
        step = max(1, SLICE_PAIRS // len(reached))
        for lo in range(at, to, step):
            hi = min(to, lo + step)
            low = t if least is None else np.maximum(t, least[lo:hi])
            past = int(np.searchsorted(reached, lo)) if same else 0
            ia, ib, sims, made = scored(za[lo:hi], other[past:], low)
            ia, ib = ia + lo, reached[ib + past]
            if same:  # a block with itself has each pair of rows once
                once = ia < ib
                ia, ib, sims = ia[once], ib[once], sims[once]
            first = np.searchsorted(reached, np.arange(lo, hi), "right") if same else np.zeros(hi - lo, np.int64)
            yield ia, ib, sims, int((len(reached) - first).sum()), made


def scored(za: np.ndarray, zb: np.ndarray, t) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns and products of the pairs with product >= t, and how many exact products were computed.

    ``t``: a number, or one for each row of ``za``.
    """
    t = np.broadcast_to(np.asarray(t, np.float64), len(za))[:, None]
    if len(za) and t.min() > 0:
        if za.shape[1] <= FULL_DIM:  # a float32 product tells which pairs need their own one
            bound = za.astype(np.float32) @ zb.astype(np.float32).T
            near = bound >= (t - ROUGH).astype(np.float32)
        else:
            lead = max(1, za.shape[1] // LEAD_SHARE)
            ta, tb = (np.sqrt((z[:, lead:] ** 2).sum(1)) for z in (za, zb))
            bound = za[:, :lead] @ zb[:, :lead].T
            bound += np.outer(ta, tb)
            near = bound >= t - 1e-9
        ia, ib = np.divmod(np.flatnonzero(near), len(zb)) if len(zb) else (np.zeros(0, np.int64),) * 2
        if len(ia) * 4 < za.shape[0] * zb.shape[0]:
            sims = np.empty(len(ia))
            for at in range(0, len(ia), 16_384):
                sims[at:at + 16_384] = np.einsum("ij,ij->i", za[ia[at:at + 16_384]], zb[ib[at:at + 16_384]])
            ok = sims >= t[ia, 0] - TIE
            return ia[ok], ib[ok], sims[ok], len(ia)
        t = t - TIE
    sims = za @ zb.T
    ia, ib = np.nonzero(sims >= t)
    return ia, ib, sims[ia, ib], sims.size


def embedding_threshold_join(left: DataFrame, right: DataFrame | None, threshold: float,
                             id_col: str = "vec_id", vec_col: str = "embedding",
                             n_pivots: int | None = None, cell_rows: int = 1024,
                             exclude_same_id: bool = True, best: int | None = None) -> DataFrame:
    """Pairs (a, b, similarity) with embedding cosine >= threshold (exact).

    ``best`` (two sides): hits that cannot be among the best so many of a left row may be left out.

    ``right=None``: self-join, each unordered pair once as a < b.  Otherwise (left, right) pairs.
    Zero vectors have cosine 0 with everything, so they qualify at ``threshold <= 0`` and only
    there; as nothing can be left out then, every pair of vectors is scored.
    """
    if right is not None:
        left, right = same_id_type(left, right, id_col)
    found = _block_pairs(left, right, threshold, id_col, vec_col, n_pivots, cell_rows, best)
    if found is None:
        return _empty_pairs(left, id_col)
    pairs, may = found
    t = float(threshold)

    def score(x: tuple, y: tuple, same: bool, least: np.ndarray | None):
        for ia, ib, sims, _, _ in _near_vectors(x, y, same, t, may.value, least):
            yield ia, ib, sims

    rule = "lt" if right is None else "ne" if exclude_same_id else "all"
    return scored_pairs(pairs, _vector_blocks_from_bytes, score, left.schema[id_col].dataType, rule,
                        None if right is None else best)


def scored_share(emb: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding",
                 n_pivots: int | None = None, cell_rows: int = 1024) -> DataFrame:
    """One row (pairs, met, scored): all pairs of a self-join, those whose cells met, those with a full product."""
    n = emb.count()
    found = _block_pairs(emb, None, threshold, id_col, vec_col, n_pivots, cell_rows)
    counts = emb.sparkSession.createDataFrame([], "met long, scored long")
    if found is not None:
        pairs, may = found

        def count(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    x, y = (_vector_blocks_from_bytes({"z": z, "cell": c}) for z, c in ((r.a_z, r.a_cell), (r.b_z, r.b_cell)))
                    work = [w[3:] for w in _near_vectors(x, y, r.a_blk == r.b_blk, threshold, may.value)]
                    yield pd.DataFrame({"met": [sum(m for m, _ in work)], "scored": [sum(s for _, s in work)]})

        counts = pairs.drop("a_ids", "b_ids").mapInPandas(count, "met long, scored long")
    return counts.agg(F.lit(n * (n - 1) // 2).cast("long").alias("pairs"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"),
                      F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


def _empty_pairs(df: DataFrame, id_col: str) -> DataFrame:
    t = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("a", t), T.StructField("b", t),
                           T.StructField("similarity", T.DoubleType())])
    return df.sparkSession.createDataFrame([], schema)


def similar_embedding_pairs(emb: DataFrame, threshold: float = 0.8, id_col: str = "vec_id",
                            vec_col: str = "embedding", cell_rows: int = 1024,
                            sort: bool = True) -> DataFrame:
    """(doc1, doc2, similarity) with doc1 < doc2 and cosine >= threshold, sorted desc."""
    p = embedding_threshold_join(emb, None, threshold, id_col, vec_col, cell_rows=cell_rows)
    out = p.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), "similarity")
    return keep(out).orderBy(F.desc("similarity"), "doc1", "doc2") if sort else out


def similarity_matrix(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                      cell_rows: int = 1024) -> DataFrame:
    """Every (i, j) including the diagonal and both triangles, long form (i, j, similarity).

    The output is quadratic by definition; the work is split into pairs of blocks of at most about
    ``cell_rows`` vectors, one matrix product each.  Zero vectors score 0 against everything.
    """
    p = embedding_threshold_join(emb, emb, -2.0, id_col, vec_col, cell_rows=cell_rows, exclude_same_id=False)
    return p.select(F.col("a").alias("i"), F.col("b").alias("j"), "similarity")


def collapse_equal(emb: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Group equal vectors: (representatives (id, vector) with the smallest id, members (rep, member)).

    Groups are keyed by 128 bits of two hashes and reduced by map-side combined aggregates.
    """
    same = ["_h", "_g"]
    tagged = emb.select(id_col, vec_col, F.xxhash64(vec_col).alias("_h"),
                        F.xxhash64(F.lit("again"), F.reverse(vec_col)).alias("_g"))
    first = keep(tagged.groupBy(*same).agg(F.min(F.struct(id_col, vec_col)).alias("_m")))
    reps = first.select(F.col("_m")[id_col].alias(id_col), F.col("_m")[vec_col].alias(vec_col))
    members = (tagged.drop(vec_col).join(first.select(*same, F.col("_m")[id_col].alias("rep")), same)
               .select("rep", F.col(id_col).alias("member")))
    return reps, members


def embedding_hits(queries: DataFrame, corpus: DataFrame, threshold: float,
                   id_col: str = "doc_id", vec_col: str = "embedding", exclude_same_id: bool = True,
                   best: int | None = None) -> DataFrame:
    """J10 hits (query_document_id, id, similarity) of query vectors against corpus vectors.

    ``best``: hits that cannot be among a query's best so many (by four decimals, then id) may be left out.
    """
    p = embedding_threshold_join(queries, corpus, threshold, id_col, vec_col, exclude_same_id=exclude_same_id, best=best)
    return p.select(F.col("a").alias("query_document_id"), F.col("b").alias("id"), "similarity")
