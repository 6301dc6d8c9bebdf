"""Periodic runs of words by difference-cover LCE and a harmonic grid of positions."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.llm.common import prepare

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: A perfect difference set: every difference modulo 31 is that of two members.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Words of documents that are worked on together, and grid points tested at a time.
_WORDS = 1 << 16
_GRID = 1 << 21

# for a difference d of two positions, the member a of the cover for which a + d is one too
_MEMBER = np.array([next(a for a in COVER if (a + d) % MODULUS in COVER) for d in range(MODULUS)])
_IN_COVER = np.isin(np.arange(MODULUS), COVER)


class Lce:
    """Longest common extensions of suffixes of ``s``, whose first and last numbers occur once.

    Only suffixes that start at a position of the cover are sorted: by their first 31 words, then by
    doubling, as a position 31 * 2**k further is in the cover again.  A pair of positions is compared
    word by word up to the offset (under 31) at which both are in the cover; from there the answer
    is the minimum of common prefixes between two neighbours in sorted order, from a sparse table.
    """

    def __init__(self, s: np.ndarray):
        size = len(s)
        self.s = s = np.concatenate((s, np.zeros(MODULUS + 1, s.dtype)))
        at = np.flatnonzero(_IN_COVER[np.arange(size) % MODULUS])
        self.index = np.full(size + MODULUS + 1, -1, np.int64)
        self.index[at] = np.arange(len(at))
        width = max(1, int(s.max()).bit_length())
        pack = max(1, 62 // width)
        keys = []
        for first in range(0, MODULUS, pack):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + pack, MODULUS)):
                key = key << width | s[np.minimum(at + k, size)]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        levels = [self._ranks(order, new)]
        step = MODULUS
        while levels[-1].max(initial=0) + 1 < len(at) and step < size:
            after = at + step
            rank = levels[-1]
            follows = np.where(after < size, rank[self.index[np.minimum(after, size)]] + 1, 0)
            key = rank * (len(at) + 1) + follows
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
            levels.append(self._ranks(order, new))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self.table = [self._neighbours(at[order], levels, size)]
        while 2 << len(self.table) - 1 <= len(at) - 1:
            low, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(low[:-half], low[half:]))

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, sorted_at: np.ndarray, levels: list[np.ndarray], size: int) -> np.ndarray:
        """Common prefix of each sorted suffix and the next: equal ranks by falling level, then words."""
        a, b = sorted_at[:-1].copy(), sorted_at[1:].copy()
        got = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < size) & (b < size))
            same = inside[levels[k][self.index[a[inside]]] == levels[k][self.index[b[inside]]]]
            got[same] += MODULUS << k
            a[same] += MODULUS << k
            b[same] += MODULUS << k
        live = np.arange(len(a))
        for _ in range(MODULUS):
            live = live[(a[live] < size) & (b[live] < size)]
            live = live[self.s[a[live]] == self.s[b[live]]]
            got[live] += 1
            a[live] += 1
            b[live] += 1
        return got

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from ``i`` and ``j`` on, for arrays of different positions."""
        stop = (_MEMBER[(j - i) % MODULUS] - i) % MODULUS
        got = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for d in range(MODULUS):  # a pair leaves at its first difference or its synchronised offset
            live = live[stop[live] > d]
            live = live[self.s[i[live] + d] == self.s[j[live] + d]]
            got[live] += 1
        met = np.flatnonzero(got == stop)
        a, b = self.rank[self.index[i[met] + stop[met]]], self.rank[self.index[j[met] + stop[met]]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            of = level == k
            line = self.table[k]
            got[met[of]] += np.minimum(line[a[of]], line[b[of] - (1 << k)])
        return got


def _grid(starts: np.ndarray, sizes: np.ndarray, min_exponent: int):
    """Positions k * p of every document and every period p it can hold, some millions at a time.

    A run of ``e`` periods or more has a first grid point in its first period, from where ``e - 2``
    periods and a word agree with those a period later.
    """
    most = sizes // min_exponent
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = sizes[doc] // period - (min_exponent - 2)
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _GRID, "right")))
        n = points[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[at:to], n)
        d = np.repeat(doc[at:to], n)
        yield d, starts[d] + k * p, p
        at = to


def find_runs(documents: list[list[bytes]], min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For each document the rows ``(start, length, period)`` of its runs, by start, then period."""
    found = [np.zeros((0, 3), np.int64)] * len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    if not len(sizes) or sizes.max() < min_length:
        return found
    ids, names = pd.factorize(np.array([w for d in documents for w in d] + [None], object)[:-1])
    # a number of its own before each document and after the last one
    stream = np.zeros(len(ids) + len(sizes) + 1, np.int64)
    gaps = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.ones(len(stream), bool)
    words[gaps] = False
    stream[words] = ids
    stream[gaps] = len(names) + np.arange(len(gaps))
    starts = gaps[:-1] + 1

    held = []
    for d, i, p in _grid(starts, sizes, min_exponent):
        for k in range(min(3, min_length - 1)):  # most pairs differ in their first words
            same = stream[np.minimum(i + k, len(stream) - 1)] == stream[np.minimum(i + k + p, len(stream) - 1)]
            d, i, p = d[same], i[same], p[same]
        held.append((d, i, p))
    d, i, p = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
    if not len(d):
        return found
    # suffixes are sorted for documents with such a pair only
    docs = np.unique(d)
    cut = np.concatenate([np.arange(gaps[x], gaps[x + 1]) for x in docs.tolist()] + [gaps[-1:]])
    part = stream[cut]
    new_start = np.zeros(len(sizes), np.int64)
    new_start[docs] = np.cumsum(sizes[docs] + 1) - sizes[docs]
    i = i - starts[d] + new_start[d]
    forward = Lce(part)(i, i + p)
    keep = forward > (min_exponent - 2) * p
    d, i, p, forward = d[keep], i[keep], p[keep], forward[keep]
    if not len(d):
        return found
    back = Lce(part[::-1].copy())(len(part) - i - p, len(part) - i)
    keep = (back < p) & (back + forward + p >= np.maximum(min_length, min_exponent * p))
    d, i, p, length = d[keep], i[keep], p[keep], (back + forward + p)[keep]
    start = i - back[keep] - new_start[d]
    order = np.lexsort((p, length, start, d))
    d, start, length, p = d[order], start[order], length[order], p[order]
    first = np.ones(len(d), bool)  # a multiple of the smallest period has the same ends
    first[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start, length, p], axis=1)[first]
    d = d[first]
    order = np.lexsort((rows[:, 2], rows[:, 0], d))
    rows, d = rows[order], d[order]
    for x in np.unique(d).tolist():
        found[x] = rows[np.searchsorted(d, x):np.searchsorted(d, x, "right")]
    return found


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def strongest(runs: np.ndarray) -> dict | None:
    """The run of the greatest length / period (exact); ties: smallest start, then period."""
    best = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return best and dict(zip(("start", "length", "period"), best))


_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_PA_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, best, collapsed)``, one row per row of ``docs``.

    Words are cut at ASCII white space and numbered from 0.  A run is a stretch with smallest period
    ``q`` and at least ``max(min_length, min_exponent * q)`` words that cannot be longer; ``runs``
    holds ``(start, length, period)`` by start, then period, ``best`` is the one of the greatest
    length / period.  ``collapsed`` is the text without the words that a run holds after its first
    period.

    A null or empty text has no words: no runs, null ``best``, empty ``collapsed``.  A null id keeps
    its row, repeated rows give repeated results, other columns are ignored and an empty table gives
    an empty result.  Documents are worked on some ``2**16`` words at a time; a longer one on its own,
    whole, in memory in proportion to its words.
    """
    if min_exponent < 3 or min_length < 3:
        raise ValueError("min_exponent and min_length must be 3 or more")
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                           T.StructField("best", _RUN), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            counts, runs, best, texts = [], [], [], []
            group, size = [], 0

            def flush():
                for words, rows in zip(group, find_runs(group, min_length, min_exponent)):
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in rows.tolist()])
                    best.append(strongest(rows))
                    texts.append(collapse(words, rows))
                group.clear()

            for data in batch.column("data"):
                group.append((data.as_py() or b"").split())
                size += len(group[-1])
                if size >= _WORDS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_PA_RUN)),
                 pa.array(best, _PA_RUN), pa.array(texts, pa.binary()).cast(pa.string())],
                names=schema.names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return src.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a run planted into a tenth of the texts, chosen and shaped by a hash of the id.

    With ``h`` the CRC-32 of the decimal id, ``g = h div 10`` and ``n`` words, a text of ``h % 10 = 0``
    repeats from word ``a = g % n`` on its words ``a .. a + p - 1``, ``p = 1 + (n - a) div (3 + g % 8)``.
    Other texts, those without words and those of a null id stay as they are.
    """
    names = set(docs.columns)
    own = {x: next(f"{x}{'_' * k}" for k in range(len(names) + 1) if f"{x}{'_' * k}" not in names)
           for x in ("plant_words", "plant_g")}
    words, g = own["plant_words"], own["plant_g"]
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    cut = F.array_remove(F.split(text_col, r"[\x20\x09-\x0D]+"), "")
    out = docs.withColumn(words, F.when(h % 10 == 0, cut)).withColumn(g, F.floor(h / 10).cast("long"))
    planted = F.expr(f"""
        transform(array(struct({g} % size({words}) AS a)), x ->
          transform(array(struct(x.a AS a, 1 + (size({words}) - x.a) div (3 + {g} % 8) AS p)), y ->
            array_join(concat(slice({words}, 1, int(y.a)),
                              slice(flatten(array_repeat(slice({words}, int(y.a) + 1, int(y.p)),
                                                         int((size({words}) - y.a) div y.p) + 1)),
                                    1, int(size({words}) - y.a))), ' '))[0])[0]""")
    return out.withColumn(text_col, F.when(F.size(words) > 0, planted).otherwise(F.col(text_col))).drop(words, g)
