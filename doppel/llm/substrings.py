"""Removal of long repeated byte strings: anchors, then depth-bounded interval expansion."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm.common import discard, prepare, scratch, shuffle_partitions

LENGTH = 200
#: Bytes of an anchor's string; a window of LENGTH bytes has LENGTH - ANCHOR + 1 of them.
ANCHOR = 32
_CHUNK = 1 << 22   # bytes handled at once
_EXPAND = 1 << 21  # context bytes expanded at once
#: Different contexts of a key that one task expands; those of a key with more are spread.
MOST_CONTEXTS = 8000
_CELL = 24         # anchor offsets of a cell of windows of such a key
_POS = 24
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _anchor_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """64-bit hash of each ``anchor`` bytes (a power of two), built by doubling."""
    h, width, m = _BYTES[data], 1, _MULTIPLIER
    while width < anchor:
        h = h[:-width] * _U(m) + h[width:]
        m, width = m * m % (1 << 64), 2 * width
    h ^= h >> _U(31)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:len(x)] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """Arrays (text, key, extent hash, first window, windows - 1, anchor's offset) of the texts.

    Every window of ``length`` bytes is owned by its smallest anchor hash (the leftmost, if equal):
    a choice that equal windows make alike, wherever they are.  An anchor owns a run of
    consecutive windows; the bytes they span are its extent.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        return
    h = _anchor_hashes(data, anchor)
    at = np.arange(len(h), dtype=np.uint64)
    own = _sliding_min((h >> _U(_POS)) << _U(_POS) | at, length - anchor + 1) & _U((1 << _POS) - 1)
    start = np.arange(len(own))
    text = np.searchsorted(ends, start, side="right")
    idx = np.flatnonzero(start + length <= ends[text])
    if not len(idx):
        return
    own, text = own[idx].astype(np.int64), text[idx]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(idx) - 1]))
    s0, s1, p, text = idx[first], idx[last], own[first], text[first]
    whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    ext = np.fromiter((digest(whole[a:b], o) for a, b, o in zip(s0.tolist(), (s1 + length).tolist(), (p - s0).tolist())),
                      np.uint64, len(s0))
    base = np.concatenate(([0], ends[:-1]))[text]
    yield text, h[p].view(np.int64), ext.view(np.int64), s0 - base, s1 - s0, p - s0


def _pieces(ids, texts, length: int, most: int = _CHUNK):
    """Lists of (id, offset, bytes) of some ``most`` bytes; long texts are cut so that each window
    is in one piece."""
    some, size = [], 0
    for i, t in zip(ids, texts):
        for at in range(0, max(1, len(t) - length + 1), most):
            part = t[at:at + most + length - 1]
            some.append((i, at, part))
            size += len(part)
            if size >= most:
                yield some
                some, size = [], 0
    if some:
        yield some


def expand(data: np.ndarray, length: int) -> np.ndarray:
    """Class of the ``length`` bytes at each position: equal classes, equal strings.

    Breadth-first expansion: all positions with a common prefix of d bytes form an interval.  A
    backward step takes the strings of d bytes that precede an interval's, so that an interval of
    2d bytes is a pair of intervals of d; steps of growing length go on until ``length`` is
    reached and stop there.  Positions alone in their interval can repeat no more and leave.
    """
    n = len(data) - length + 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    cls = np.zeros(len(data), np.uint64)  # the first 8 bytes, as a number
    for k in range(8):
        cls = cls << _U(8) | padded[k:k + len(data)]
    depth = 8
    cls = np.unique(cls, return_inverse=True)[1].astype(np.int64)
    while depth < length:
        step = min(depth, length - depth)
        pair = cls[:len(cls) - step] * (cls.max() + 1) + cls[step:]
        # a position alone in its interval gets a class of its own without being sorted again
        size = np.bincount(cls)
        live = np.flatnonzero(size[cls[:len(pair)]] > 1)
        new = np.unique(pair[live], return_inverse=True)[1]
        top = int(new.max()) + 1 if len(new) else 0
        cls = np.arange(top, top + len(pair))
        cls[live] = new
        depth += step
    return cls[:n]


def _repeated_windows(contexts: list[tuple], length: int):
    """(id, first, last) of runs of windows whose string is at another window of the contexts too.

    A context is (id, offset of its first window, bytes); its windows start at each byte with
    ``length`` bytes after it.
    """
    data = np.frombuffer(b"".join(c[2] for c in contexts), np.uint8)
    size = np.array([len(c[2]) for c in contexts])
    base = np.cumsum(size) - size
    cls = expand(data, length)
    inside = np.zeros(len(cls), bool)
    for b, s in zip(base.tolist(), size.tolist()):
        inside[b:b + s - length + 1] = True
    at = np.flatnonzero(inside)
    often = np.bincount(cls[at])[cls[at]] > 1
    at = at[often]
    if not len(at):
        return
    owner = np.searchsorted(base, at, side="right") - 1
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
    for f, e in zip(first.tolist(), last.tolist()):
        c, o = contexts[owner[f]], int(at[f] - base[owner[f]])
        yield c[0], c[1] + o, c[1] + o + int(at[e] - at[f])


def _index(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for some in _pieces(pdf["a"], pdf["data"], length):
                a = np.array([i for i, _, _ in some], np.int64)
                off = np.array([o for _, o, _ in some], np.int64)
                for t, key, ext, s0, more, o in anchors([x for _, _, x in some], length, anchor):
                    yield pd.DataFrame({"a": a[t], "key": key, "ext": ext,
                                        "pos": (s0 + off[t]) << 20 | more << 10 | o})

    return texts.mapInPandas(run, "a bigint, key bigint, ext bigint, pos bigint")


def _hashed_windows(contexts: DataFrame, spark: SparkSession, length: int, anchor: int) -> DataFrame:
    """``(a, first, last)``, one row a window that repeats, for contexts of any number to a key.

    The expansion of ``expand`` in two levels, spread over all tasks.  Equal windows have the anchor
    at the same offset.  Windows are put into cells by that offset; what all windows of a cell have
    in common is hashed, and a cell whose core no other context of the key shares is closed.  The
    windows of open cells are hashed whole.  Both levels are counts by key and hash, map-side first,
    so contexts of one key never meet in one task.
    """
    path = scratch(spark, "contexts")
    contexts.write.parquet(path)
    held = spark.read.parquet(path)
    digest = xxhash.xxh3_64_intdigest

    def frame(rows, columns):
        out = pd.DataFrame(rows, columns=columns)
        out["hash"] = out["hash"].to_numpy(np.uint64).view(np.int64)
        return out

    def offsets(cell, at, data):
        """Anchor offsets of the cell's windows that are in the context."""
        return range(max(cell * _CELL, at + length - len(data)), min(cell * _CELL + _CELL - 1, at) + 1)

    def cells(batches):
        for pdf in batches:
            rows = []
            for key, a, first, at, data in zip(pdf["key"], pdf["a"], pdf["first"], pdf["at"], pdf["bytes"]):
                for cell in range((at + length - len(data)) // _CELL, at // _CELL + 1):
                    low, high = cell * _CELL, min(cell * _CELL + _CELL - 1, length - anchor)
                    rows.append((key, cell, digest(data[at - low:at - high + length], cell), a, first))
            yield frame(rows, ["key", "cell", "hash", "a", "first"])

    def windows(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                rows, some = [], pdf.iloc[s:s + 256]
                for key, a, first, at, data, own in zip(some["key"], some["a"], some["first"], some["at"],
                                                        some["bytes"], some["cells"]):
                    for w in (at - o for cell in own for o in offsets(int(cell), at, data)):
                        rows.append((key, digest(data[w:w + length], at - w), a, first + w))
                yield frame(rows, ["key", "hash", "a", "first"])

    found = held.mapInPandas(cells, "key bigint, cell int, hash bigint, a bigint, first bigint")
    shared = found.groupBy("key", "cell", "hash").count().where("count > 1").drop("count")
    open_ = (found.join(shared, ["key", "cell", "hash"]).groupBy("a", "first")
                  .agg(F.collect_list("cell").alias("cells")))
    path = scratch(spark, "windows")
    (held.join(open_, ["a", "first"]).select("key", "a", "first", "at", "bytes", "cells")
         .mapInPandas(windows, "key bigint, hash bigint, a bigint, first bigint").write.parquet(path))
    each = spark.read.parquet(path)
    often = each.groupBy("key", "hash").count().where("count > 1").drop("count")
    return each.join(often, ["key", "hash"]).select("a", "first", F.col("first").alias("last"))


def repeated_strings(texts: DataFrame, spark: SparkSession, length: int = LENGTH,
                     anchor: int = ANCHOR, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``(a, spans)``: of each text, runs (first, last) of windows that start elsewhere too.

    ``texts`` has distinct texts ``data`` by id ``a``.
    """
    path = scratch(spark, "anchors")
    _index(texts, length, anchor).write.parquet(path)
    found = spark.read.parquet(path)
    keys = (found.groupBy("key").agg(F.count("*").alias("n"), F.min("ext").alias("lo"), F.max("ext").alias("hi"))
                 .where("n > 1").select("key", (F.col("lo") == F.col("hi")).alias("one")))
    # written, so that the join's two sides are plain shuffles and a hot key's rows can be split
    often = scratch(spark, "keys")
    keys.write.parquet(often)
    shared = scratch(spark, "shared")
    found.join(spark.read.parquet(often), "key").write.parquet(shared)
    shared = spark.read.parquet(shared)
    first, more = F.shiftright("pos", 20), F.shiftright("pos", 10).bitwiseAND(F.lit(1023))
    # extents that repeat as a whole: each of their windows does
    mixed = shared.where(~F.col("one"))
    kinds = mixed.groupBy("key", "ext").agg(F.count("*").alias("n"), F.min(F.struct("a", "pos")).alias("rep"))
    kinds = kinds.checkpoint()
    many = kinds.where("n > 1").select("key", "ext").checkpoint()
    whole = (shared.where("one").select("a", "pos")
                   .union(mixed.join(many, ["key", "ext"]).select("a", "pos"))
                   .select("a", first.alias("first"), (first + more).alias("last")))
    # the rest: one context of each kind of extent of a key, where some kind occurs once
    open_keys = (kinds.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("kinds"))
                      .where("least = 1").select("key", (F.col("kinds") > most_contexts).alias("hot"))).checkpoint()

    def contexts(batches):
        for pdf in batches:
            rows = [(x["key"], a, x["pos"] >> 20, x["pos"] & 1023,
                     data[x["pos"] >> 20:(x["pos"] >> 20) + (x["pos"] >> 10 & 1023) + length])
                    for a, data, need in zip(pdf["a"], pdf["data"], pdf["need"]) for x in need]
            yield pd.DataFrame(rows, columns=["key", "a", "first", "at", "bytes"])

    def around(keys):
        need = (kinds.join(keys.select("key"), "key").groupBy(F.col("rep.a").alias("a"))
                     .agg(F.collect_list(F.struct("key", F.col("rep.pos").alias("pos"))).alias("need")))
        return (texts.join(need, "a").select("a", "data", "need")
                     .mapInPandas(contexts, "key bigint, a bigint, first bigint, at int, bytes binary"))

    def test(batches):
        some, size, last = [], 0, None
        for pdf in batches:
            for key, a, first, data in zip(pdf["key"], pdf["a"], pdf["first"], pdf["bytes"]):
                if size >= _EXPAND and key != last:
                    yield pd.DataFrame(_repeated_windows(some, length), columns=["a", "first", "last"])
                    some, size = [], 0
                some.append((a, first, data))
                size += len(data)
                last = key
        if some:
            yield pd.DataFrame(_repeated_windows(some, length), columns=["a", "first", "last"])

    parts = (around(open_keys.where("not hot")).select("key", "a", "first", "bytes")
             .repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
             .mapInPandas(test, "a bigint, first bigint, last bigint"))
    hot = open_keys.where("hot")
    if not hot.isEmpty():
        parts = parts.union(_hashed_windows(around(hot), spark, length, anchor))
    return whole.union(parts).groupBy("a").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _cut(data: bytes, spans, length: int) -> tuple[int, int, list[bytes]]:
    """(bytes removed, runs removed, parts kept) of one text."""
    removed, runs, kept, at = 0, 0, [], 0
    end = -1
    for first, last in sorted((s["first"], s["last"] + length) for s in spans):
        if first > end:
            if end >= 0:
                removed += end - start
                kept.append(data[at:start])
                at = end
            start, end, runs = first, last, runs + 1
        else:
            end = max(end, last)
    if end >= 0:
        removed += end - start
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return removed, runs, kept


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          length: int = LENGTH, anchor: int = ANCHOR,
                          most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    Each byte covered by a string of ``length`` bytes that starts anywhere else too (same document
    included, overlapping included) is removed; strings are judged on the input.

    Copies of a whole text are found by hash (checked by a second one) and indexed once; their
    windows all repeat.  Of the distinct texts, equal windows share an anchor, so only anchors
    meet in a shuffle: counts by key, map-side first, then a join that adaptive execution may
    split.  Extents that repeat whole need no more.  What is left, around the ends of repeats,
    sends its few bytes to the key's task, where ``expand`` decides exactly.  Memory there is
    about 50 times the contexts of one key, each at most 2 * ``length`` bytes and all different.  A
    key with over ``most_contexts`` of them (the edge of a passage that many texts share) is decided
    by ``_hashed_windows`` instead, with the same result and no task that holds the key.

    A null text is empty; a text shorter than ``length`` keeps all; a null id keeps its row;
    repeated rows are copies of each other, so they lose all their bytes from ``length`` on; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    seed = 0
    while True:  # until no two different texts have the same id; the first seed, but for a freak
        rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
        rows = rows.select("doc_id", "data", F.length("data").cast("long").alias("n_bytes"),
                           F.xxhash64(F.lit(seed), "data").alias("a"))
        longer = rows.where(F.col("n_bytes") >= length)
        copies = (longer.select("a", F.xxhash64(F.lit(~seed), "data").alias("b")).groupBy("a")
                        .agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))).checkpoint()
        if copies.where("lo <> hi").isEmpty():
            break
        seed += 1
    name, path = f"texts_{uuid.uuid4().hex}", scratch(spark, "texts")
    # bucketed by id, so that later joins with a text do not move it again
    (longer.groupBy("a").agg(F.first("data").alias("data")).write.option("path", path)
           .bucketBy(shuffle_partitions(spark), "a").saveAsTable(name))
    texts = spark.table(name)
    spans = repeated_strings(texts, spark, length, anchor, most_contexts)

    def cut(batches):
        for pdf in batches:
            out = {"a": pdf["a"], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for data, n, own in zip(pdf["data"], pdf["n"], pdf["spans"]):
                if n > 1:
                    own = [{"first": 0, "last": len(data) - length}]
                removed, runs, kept = _cut(data, own if own is not None else [], length)
                sha = hashlib.sha256()
                for part in kept:
                    sha.update(part)
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept_sha256"].append(sha.hexdigest())
            yield pd.DataFrame(out)

    done = scratch(spark, "kept")
    (texts.join(spans, "a", "left").join(copies.select("a", "n"), "a").select("a", "data", "n", "spans")
          .mapInPandas(cut, "a bigint, n_removed bigint, n_spans bigint, kept_sha256 string").write.parquet(done))
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    kept = spark.read.parquet(done)
    out = rows.select("doc_id", "n_bytes", "a", F.when(F.col("n_bytes") < length, F.sha2("data", 256)).alias("_own"))
    joined = out.join(kept, "a", "left")
    return joined.select("doc_id", "n_bytes", *[F.when(F.col("_own").isNull(), F.col(c)).otherwise(0).alias(c)
                                                for c in ("n_removed", "n_spans")],
                         F.coalesce("_own", "kept_sha256").alias("kept_sha256"))
