"""Jaccard links of word-shingle sets by a size-aware heavy-light join."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm.common import bounded_batches, discard, prepare, scratch
from doppel.llm.graph import connected_components

SHINGLE = 3
PERCENT = 90
#: Sets that hold a shingle beyond which it comes last in the order, and most such shingles.
FREQUENT = 64
MOST_FREQUENT = 1 << 20
#: Most ids (of eight bytes) that a filter broadcasts; beyond it Spark chooses the join.
MOST_IDS = 1 << 22
#: What looking at a pair costs, in postings, where the boundary of small sets is chosen.
PAIR_COST = 4
#: Sets of a list that are compared with all others before components are formed.
LEADS = 6
_TEXT_BYTES = 1 << 20
#: Bytes of texts or of sets that a task hands to its worker at a time.
BATCH_BYTES = 1 << 20
_SIZE_CLASSES = 4  # classes of set sizes for each doubling


# ------------------------------------------------------------------------------------ the sets
def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ASCII letters lower-cased, ASCII space cut.

    A text of fewer words is one shingle of them all; one without words has none.
    """
    words = [(t or b"").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    out = [np.zeros(0, np.int64)] * len(texts)
    if not sum(sizes):
        return out
    ids, names = pd.factorize(np.array([w for x in words for w in x] + [None], object)[:-1])
    word = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in names), np.uint64, len(names))[ids]
    rolled = np.zeros(max(0, len(word) - shingle + 1), np.uint64)
    for k in range(shingle):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + word[k:k + len(rolled)]
    rolled = _mixed(rolled).view(np.int64)
    at = 0
    for x, n in enumerate(sizes):
        if n >= shingle:
            out[x] = np.unique(rolled[at:at + n - shingle + 1])
        elif n:
            whole = xxhash.xxh64_intdigest(b" ".join(words[x]), 2 + n)
            out[x] = np.array([whole], np.uint64).view(np.int64)
        at += n
    return out


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit map of ``bits`` parities as int64 words; of half as many bits, it is this one's halves XORed."""
    odd = (np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, uid, n, sid, check, b0, b1, map, hashes)``: a set's size, 128 bits that name it, bit maps
    of 128 parities and of at least as many as it has shingles (a power of two), and its hashes.

    Each shingle flips the bit that its hash names, so the maps of two sets differ in no more bits than
    the sets differ in shingles.
    """

    @F.pandas_udf("n long, sid long, check long, b0 long, b1 long, map array<long>, hashes array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets, group, size = [], [], 0
        for k, text in enumerate(texts, 1):  # some of them at a time, as words are large objects
            group.append(text)
            size += len(text or b"")
            if size >= _TEXT_BYTES or k == len(texts):
                sets += shingle_hashes(group, shingle)
                group, size = [], 0
        names = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets),
                              np.int64).reshape(-1, 2)
        maps = [parities(s, max(128, 1 << (len(s) - 1).bit_length())) for s in sets]
        short = np.array([parities(s, 128) for s in sets], np.int64).reshape(-1, 2)
        return pd.DataFrame({"n": [len(s) for s in sets], "sid": names[:, 0], "check": names[:, 1],
                             "b0": short[:, 0], "b1": short[:, 1], "map": maps, "hashes": sets})

    src = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                      F.col(text_col).cast("binary").alias("data"))
    return src.select("doc_id", "uid", run("data").alias("s")).select("doc_id", "uid", "s.*")


# ---------------------------------------------------------------------------------- candidates
def _least(n: Column, percent: int) -> Column:
    """Shingles that a set of ``n`` shares with any set it links to, at least."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (a written table); broadcast if it is small."""
    return df.join(F.broadcast(keys) if keys.count() <= MOST_IDS else keys, on, "left_semi")


def _frequent(reps: DataFrame, percent: int) -> tuple[np.ndarray, dict[int, float]]:
    """(frequent shingles, looked-at pairs of the others by size class).

    Counted are the lowest hashes of every set, half as many again as its prefix holds: so all that can
    be in a prefix as long as no more than a third of them are frequent.  Which shingles come last only
    moves work, never a result.  If over ``MOST_FREQUENT`` shingles pass, those of the highest counts
    are taken, by powers of two.
    """
    span = (F.floor((F.col("n") - _least(F.col("n"), percent) + 2) * 3 / 2)).cast("int")
    low = reps.select("n", F.explode(F.slice("hashes", F.lit(1), span)).alias("key"))
    counts = (low.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c > 1")
                 .checkpoint())
    power = F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)).cast("double"))).cast("int")
    by_power = {r["p"]: r["k"] for r in counts.where(F.col("c") > FREQUENT).groupBy(power.alias("p"))
                .agg(F.count("*").alias("k")).collect()}
    bound, held = FREQUENT, 0
    for p in sorted(by_power, reverse=True):
        held += by_power[p]
        if held > MOST_FREQUENT:
            bound = max(bound, (2 << p) - 1)
            break
    pairs = {r["k"]: float(r["pairs"]) for r in counts.where(F.col("c") <= bound)
             .groupBy(_size_class(F.col("n")).alias("k"))
             .agg(F.sum(F.col("c") * (F.col("c") - 1) / 4).alias("pairs")).collect()}
    found = counts.where(F.col("c") > bound).select("key").toPandas()["key"].to_numpy(np.int64)
    return np.sort(found), pairs


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * _SIZE_CLASSES).cast("int")


def _boundary(classes: DataFrame, pairs: dict[int, float], percent: int) -> int:
    """Greatest size of a small set, 0 if none: where postings and looked-at pairs cost least.

    A small set posts every pair of shingles of its prefix (one longer) and then meets few others; a
    large one posts its single shingles and meets what is in their lists.
    """
    k = F.col("n") - _least(F.col("n"), percent) + 1
    by_class = sorted((r["k"], r["top"], float(r["single"]), float(r["double"])) for r in classes
                      .groupBy(_size_class(F.col("n")).alias("k"))
                      .agg(F.max("n").alias("top"), F.sum(k).alias("single"),
                           F.sum(k * (k + 1) / 2).alias("double")).collect())
    rest = sum(single + PAIR_COST * pairs.get(c, 0) for c, _, single, _ in by_class)
    best, bound, spent = rest, 0, 0.0
    for c, top, single, double in by_class:
        rest -= single + PAIR_COST * pairs.get(c, 0)
        spent += double
        # sets near the boundary post both ways
        if spent + rest + single < best:
            best, bound = spent + rest + single, int(top)
    return bound


def _postings(reps: DataFrame, frequent: np.ndarray, bound: int, percent: int) -> DataFrame:
    """``(key, sid, n, pos, held, b0, b1, prev)``: ``held`` shingles of the set's prefix, the last one at ``pos``.

    A set's order is by hash, frequent shingles last.  Sets above the boundary, and those that can
    link to one, post single shingles; sets up to it post pairs.  ``prev``: the shingle before a single
    one in the set's order, null for its first one and for pairs.
    """
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches):
        last = shared.value
        for batch in batches:
            lists = batch.column("hashes")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(h), bool)
            if len(last):
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
            first = np.repeat(np.cumsum(n) - n, n)
            early = np.concatenate(([0], np.cumsum(~late)))
            before = early[:-1] - early[first]          # earlier shingles of the set that are not frequent
            light = (early[np.cumsum(n)] - early[np.cumsum(n) - n])[doc]
            pos = np.where(late, light + np.arange(len(h)) - first - before, before)
            prefix = n - (percent * n + 99) // 100 + 1
            pick = np.flatnonzero((pos < prefix[doc]) & ((n > bound) | (100 * n >= percent * (bound + 1)))[doc])
            order = np.empty(len(h), np.int64)
            order[first + pos] = np.arange(len(h))
            prev = h[order[np.maximum(first[pick] + pos[pick] - 1, 0)]]
            out = [(h[pick], doc[pick], pos[pick] + 1, np.ones(len(pick), np.int64), prev, pos[pick] == 0)]
            pick = np.flatnonzero((pos < prefix[doc] + 1) & (n <= bound)[doc])
            pick = pick[np.lexsort((pos[pick], doc[pick]))]
            members = np.bincount(doc[pick], minlength=len(n))
            starts = np.cumsum(members) - members
            for size in np.unique(members[members > 1]).tolist():  # all sets of a prefix length at once
                rows = np.flatnonzero(members == size)
                a, b = np.triu_indices(size, 1)
                left, right = h[pick[starts[rows, None] + a]], h[pick[starts[rows, None] + b]]
                key = _mixed(left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(right.view(np.uint64)))
                out.append((key.view(np.int64).ravel(), np.repeat(rows, len(a)), np.tile(b + 1, len(rows)),
                            np.full(len(rows) * len(a), 2), np.zeros(len(rows) * len(a), np.int64),
                            np.ones(len(rows) * len(a), bool)))
            key, row, pos, held, prev, none = (np.concatenate(c) for c in zip(*out))
            own = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("sid", "b0", "b1")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *map(pa.array, own)] + [pa.array(c.astype(np.int32)) for c in (n[row], pos, held)]
                + [pa.array(prev, mask=none)], names=["key", "sid", "b0", "b1", "n", "pos", "held", "prev"])

    return (reps.select("sid", "b0", "b1", "hashes")
                .mapInArrow(run, "key long, sid long, b0 long, b1 long, n int, pos int, held int, prev long"))


def _can_link(a: str, b: str, percent: int) -> str:
    """Whether two sets that first meet at these positions can share enough shingles.

    They share those that meet and no more than either has after them; they differ in at least as many
    as their bit maps do.
    """
    enough = f"(({percent}L * ({a}n + {b}n) + {99 + percent}) div {100 + percent})"
    return (f"{a}held + least({a}n - {a}pos, {b}n - {b}pos) >= {enough} and "
            f"bit_count({a}b0 ^ {b}b0) + bit_count({a}b1 ^ {b}b1) <= {a}n + {b}n - 2 * {enough}")


def _met_first(a: str, b: str) -> Column:
    """Whether two postings of a list don't stand right after the same shingle, in whose list their sets meet too."""
    return ~F.coalesce(F.col(f"{a}.prev") == F.col(f"{b}.prev"), F.lit(False))


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of every set with some sets of its list and size band (``LEADS`` of them).

    Bands are as wide as the sizes of sets that can link.  One lead is the set whose posting stands
    first in its order, as it has the fewest shingles of its own; the others are any, by a hash.
    """
    width = float(np.log(100 / percent)) if percent < 100 else 1.0
    list_key = ["key", "held", "band"]
    banded = posts.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    own = ["sid", "n", "pos", "b0", "b1"]
    orders = [F.col("pos")] + [F.xxhash64("sid", F.lit(k)) for k in range(1, LEADS)]
    leads = [F.min(F.struct(o.alias("first"), *[F.col(c).alias(f"p_{c}") for c in own])) for o in orders]
    found = (banded.groupBy(*list_key).agg(F.array_distinct(F.transform(
        F.array(*leads), lambda x: x.dropFields("first"))).alias("leads"), F.count("*").alias("m"))
        .where("m > 1").drop("m").checkpoint())
    met = banded.join(found, list_key).withColumn("lead", F.explode("leads")).select("*", "lead.*")
    met = met.withColumn("p_held", F.col("held")).where("sid <> p_sid").where(_can_link("", "p_", percent))
    return met.select(F.least("sid", "p_sid").alias("a"), F.greatest("sid", "p_sid").alias("b"))


def _halved(words: Column) -> Column:
    half = (F.size(words) / 2).cast("int")
    return F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _linked(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose sets' intersection is at least ``percent`` % of their union.

    The sets' bit maps, a 64th of their size, go first; sets are shipped for what these leave.  Sizes of
    sets that can link are within a factor of 1.5, so their maps within one of two.
    """
    def beside(pairs: DataFrame, *what: str) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().checkpoint()
        sets = _semi(named, needed, "sid").select("sid", *what)
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("sid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in what]), end)
        return pairs

    pairs = beside(pairs.distinct().checkpoint(), "n", "map")
    x, y = (F.when(F.size(p) > F.size(q), _halved(F.col(p))).otherwise(F.col(p))
            for p, q in (("map_a", "map_b"), ("map_b", "map_a")))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    pairs = (pairs.withColumn("x", x).withColumn("y", y)
                  .where(differ <= F.expr(f"n_a + n_b - 2 * (({percent}L * (n_a + n_b) + {99 + percent}) div {100 + percent})"))
                  .select("a", "b").checkpoint())
    both = beside(pairs, "hashes").select(
        "a", "b", F.size(F.array_intersect("hashes_a", "hashes_b")).alias("met"),
        (F.size("hashes_a") + F.size("hashes_b")).alias("all"))
    return both.where(f"{100 + percent}L * met >= {percent}L * all").select("a", "b").checkpoint()


def links(spark: SparkSession, reps: DataFrame, named: DataFrame, classes: DataFrame, percent: int,
          paths: list[str]) -> DataFrame:
    """Edges ``(a, b)`` between sets of ``reps`` whose components are those of all links.

    ``named`` is the written table of which ``reps`` are some rows; sets of pairs are fetched from it by
    their name alone, since only names of ``reps`` are in pairs.

    In every list, some sets of each band of sizes are compared with all others of the band.  Lists
    whose sets are then in one component are done; in the rest, every set outside the list's largest
    component is compared with every set of another component, so each pair that can link is either
    compared or connected already.  Two sets with the same shingle before this one meet in that one's
    list too, with at least as many shingles to come, so a pair is formed once in a run of shared shingles.
    """
    frequent, pairs = _frequent(reps, percent)
    bound = _boundary(classes, pairs, percent)

    def written(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    # most lists hold one set: only keys cross the shuffle that finds the others, and the postings are
    # made twice rather than written whole
    posts = _postings(reps, frequent, bound, percent)
    shared = posts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key").checkpoint()
    posts = written(_semi(posts, shared, "key"), "jaccard-postings")
    first = _linked(_stars(posts, percent), named, percent)

    comp = connected_components(first).withColumnRenamed("node", "sid").checkpoint()
    placed = posts.join(comp, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    largest = (placed.groupBy("key", "held", "component").agg(F.count("*").alias("m"))
                     .groupBy("key", "held").agg(F.count("*").alias("k"),
                                                 F.max(F.struct("m", "component")).alias("top"))
                     .where("k > 1").select("key", "held", F.col("top.component").alias("top")).checkpoint())
    rest = written(placed.join(largest, ["key", "held"]), "jaccard-rest")
    o, m = rest.where("component <> top").alias("o"), rest.alias("m")
    met_again = (F.col("o.key") == F.col("m.key")) & (F.col("o.held") == F.col("m.held")) \
        & (F.col("o.component") != F.col("m.component")) \
        & ((F.col("m.component") == F.col("m.top")) | (F.col("o.sid") < F.col("m.sid"))) \
        & F.expr(_can_link("o.", "m.", percent)) & _met_first("o", "m")
    more = o.join(m, met_again).select(F.least("o.sid", "m.sid").alias("a"), F.greatest("o.sid", "m.sid").alias("b"))
    second = _linked(more, named, percent)
    return comp.where("sid <> component").select(F.col("sid").alias("a"), F.col("component").alias("b")) \
        .union(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    A document's set is that of its distinct ``shingle``-word shingles, as 64-bit hashes (sets are
    compared by them, whole); two documents link where the intersection is at least ``percent`` % of
    the union.  ``component_id`` is the smallest id reachable.  Equal sets are one class, so a group
    of copies costs one set.

    A null or empty text, or one without words, has no set: ``n_shingles`` 0, linked with nothing,
    its own id as component.  A null id keeps its row and names a component only where no other id is
    in it; repeated rows stay; other columns are ignored; an empty table gives an empty result.  Two
    different sets whose 64-bit names are equal are an error.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be 67 to 100")
    spark = prepare(docs.sparkSession)
    with bounded_batches(spark, BATCH_BYTES):
        return _components(spark, docs, id_col, text_col, shingle, percent)


def _components(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, shingle: int,
                percent: int) -> DataFrame:
    path = scratch(spark, "jaccard-sets")
    shingle_sets(docs, id_col, text_col, shingle).write.parquet(path)
    sets = spark.read.parquet(path)
    classes = (sets.where("n > 0").groupBy("sid")
                   .agg(F.min("uid").alias("uid"), F.max("n").alias("n"), F.min("doc_id").alias("low"),
                        (F.min("check") != F.max("check")).alias("clash")).checkpoint())
    if not classes.where("clash").isEmpty():
        raise RuntimeError("two different sets have the same 64-bit name")
    # a smaller set has no other set that is close enough
    able = classes.where(f"100 * n >= {percent} * (n + 1)")
    # from here a class goes by the row of its first set, so that asking for a row never gets a copy too
    named = sets.select(F.col("uid").alias("sid"), "n", "b0", "b1", "map", "hashes")
    reps = _semi(named, able.select(F.col("uid").alias("sid")).checkpoint(), "sid")
    paths = [path]
    edges = links(spark, reps, named, able, percent, paths)
    comp = connected_components(edges).withColumnRenamed("node", "uid")
    placed = classes.join(comp, "uid", "left").withColumn("component", F.coalesce("component", "uid")).checkpoint()
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id")).checkpoint()
    of_set = placed.join(lows, "component").select("sid", "component_id").checkpoint()
    out = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(of_set, "sid", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"),
                     F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.checkpoint()
    for p in paths:
        discard(spark, p)
    return out
