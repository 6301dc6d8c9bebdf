"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import own_names, prepare, scratch
from doppel.llm.graph import connected_components

SHINGLE = 4
MAX_BITS = 4
BYTES = 8
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of one UTF-8 text, as an unsigned number; 0 if it has no word."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of a very long text
        to = min(n, at + (1 << 16))
        h = np.fromiter((digest(text[s:e], seed) for s, e in zip(starts[at:to], stops[at:to])),
                        np.uint64, to - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << _SHIFTS).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(x, shingle) for x in pdf["data"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return src.mapInPandas(run, f"doc_id {kind}, fp bigint")


def _positions(max_bits: int) -> int:
    """So many of the eight bytes agree at least where ``max_bits`` bits differ."""
    return max(1, BYTES - max_bits)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in 1 to ``max_bits`` bits.

    ``max_bits`` bits touch at most ``max_bits`` of the eight bytes, so a pair shares at least
    ``8 - max_bits`` positional bytes: the guaranteed minimum.  A list of the inverted index holds
    the fingerprints with the same bytes at one set of that many positions, so any pair that can
    pass meets in a list.  For a pair that meets, the shared positional bytes are tallied; it is
    kept where the tally reaches the minimum, this list is the pair's first one (so it comes out
    once) and the bit distance holds.  All of it is the condition of one equi-join.
    """
    if not 0 < max_bits < BYTES:
        raise ValueError("max_bits must be 1 to 7: some byte has to agree")
    need = _positions(max_bits)
    sets = list(combinations(range(BYTES), need))
    first = [0] * 256  # the set a pair is found by: its lowest agreeing positions
    for m in range(256):
        low = [p for p in range(BYTES) if m >> p & 1][:need]
        first[m] = sum(1 << p for p in low) if len(low) == need else -1

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    lists = F.array(*[
        F.struct(F.lit(sum(1 << p for p in s)).alias("at"),
                 F.col("fp").bitwiseAND(F.lit(signed(sum(0xFF << 8 * p for p in s)))).alias("bytes"))
        for s in sets])
    postings = (fps.select("fp").distinct().select("fp", F.explode(lists).alias("k"))
                   .select("fp", "k.at", "k.bytes"))
    # not by broadcast: Spark sizes postings by the fingerprints, which they outnumber by ``len(sets)`` to one
    a, b = postings.hint("merge").alias("x"), postings.hint("merge").alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    same = sum((F.when(diff.bitwiseAND(F.lit(signed(0xFF << 8 * p))) == 0, 1 << p).otherwise(0)
                for p in range(BYTES)), F.lit(0))
    tally = F.bit_count(same)
    found = F.element_at(F.array(*[F.lit(x) for x in first]), same + 1)
    return (a.join(b, (F.col("x.at") == F.col("y.at")) & (F.col("x.bytes") == F.col("y.bytes"))
                   & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(diff) <= max_bits)
                   & (tally >= need) & (found == F.col("x.at")))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Equal fingerprints are one node, so a group of copies costs one entry of the index and its
    size never enters a join key twice.  ``component_id`` is the smallest id whose fingerprint is
    reachable over links of at most ``max_bits`` bits.

    Null and empty texts (and texts without words) have fingerprint zero and are linked like any
    other; a null id keeps its row and is never a component's id unless no other id is in it;
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = connected_components(links(nodes, max_bits))
    comp = comp.withColumnRenamed("node", "fp")
    placed = (nodes.join(comp, "fp", "left")
                   .withColumn("component", F.coalesce("component", "fp")))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(lows, "component").select("fp", "component_id")
    return (fps.join(by_fp, "fp")
               .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last).

    Rows that share the id are told apart by a hash of the text, and one of equal rows stays.  All
    columns of ``docs`` are kept, whatever their names.  Other cases are those of ``simhash_components``.
    """
    spark = prepare(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    fp_, key_, mark, first = own_names(docs.columns, "fp", "key", "mark", "first")
    # written once, so that the texts are hashed once and no Python runs beside the joins
    path = scratch(spark, "fingerprinted")
    docs.withColumn(fp_, fp(F.col(text_col).cast("binary"))).write.parquet(path)
    rows = spark.read.parquet(path)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                   F.xxhash64(text_col).alias("h"))
    nodes = rows.groupBy(F.col(fp_).alias("fp")).agg(F.min(key).alias("key")).checkpoint()  # one row a fingerprint
    comp = connected_components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    placed = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = (placed.groupBy("component").agg(F.min(F.struct("key", "fp")).alias("b"))
                  .select(F.col("b.fp").alias(mark), F.col("b.key").alias(key_), F.col("component").alias(first)))
    out = rows.join(best, F.col(fp_) == F.col(mark)).where(key.eqNullSafe(F.col(key_)))
    return out.dropDuplicates([first]).select(*[F.col(f"`{c}`") for c in docs.columns])
