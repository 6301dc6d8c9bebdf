"""Nearest neighbours by inner product: hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doppel.llm.common import prepare

#: The tree is fitted on at most so many distinct vectors; its leaves are bounded by that too.
FIT_ROWS = 20_000
BRANCH = 8
LEAF_ROWS = 64      # of the fitting sample
#: Queries that calibrate the number of leaf visits, and the recall to reach on them.
CALIBRATION = 128
TARGET = 0.97
K = 20
#: Vectors of a block, queries scored by one matrix product and queries sent to one task.
BLOCK, QUERIES, CHUNK = 8192, 2048, 16_384


@dataclass
class Tree:
    """Nodes in arrays; leaves are numbered 0 to n - 1.  ``radius`` bounds a node's members."""

    centers: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    n_leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest child."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centers[kids]
            best = ((c * c).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)
            stack += [(k, own) for i, k in enumerate(kids) if len(own := rows[best == i])]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of a best-bin-first traversal.

        A priority queue holds the open branches by inner product with their centre; the best one
        is opened next, wherever it hangs in the tree.
        """
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                continue
            for s, k in zip((self.centers[kids] @ q).tolist(), kids):
                heapq.heappush(heap, (-s, k))
        return out


def fit_tree(sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 5) -> Tree:
    """Split the sample by k-means again and again until a node has ``leaf_rows`` or fewer."""
    rng = np.random.default_rng(seed)
    centers, children, leaf, n = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1], 0
    stack = [(0, sample)]
    while stack:
        node, x = stack.pop()
        label = _kmeans(x, branch, rng) if len(x) > leaf_rows else None
        if label is None or len(np.unique(label)) < 2:
            leaf[node], n = n, n + 1
            continue
        for i in np.unique(label):
            own = x[label == i]
            centers.append(own.mean(0))
            children.append([])
            leaf.append(-1)
            children[node].append(len(centers) - 1)
            stack.append((len(centers) - 1, own))
    return Tree(np.array(centers), children, leaf, n)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        c = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(len(c))])
    return label


def usable(v: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _top(q: np.ndarray, x: np.ndarray, classes: np.ndarray, allowed: np.ndarray | None, k: int):
    """Per query the best ``k`` rows of ``x`` by exact inner product: (class ids, scores).

    The matrix product only picks the rows that can be among the best k, given the rounding of
    both sums, however many tie there; these are scored one by one, in a way that does not depend
    on a row's place in the block, so equal products tie.
    """
    s = q @ x.T
    if allowed is not None:
        s[~allowed] = -np.inf
    at = max(0, len(x) - k)
    # each of the two sums is off by eps * (length + 2) * |q| * |x| at most
    slack = 8 * np.finfo(float).eps * (x.shape[1] + 2) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    least = np.partition(s, at, axis=1)[:, at] - slack
    least[np.isnan(least)] = -np.inf
    for i in range(len(q)):
        own = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
        exact = (x[own] * q[i]).sum(1)
        order = np.lexsort((classes[own], -exact))[:k]
        yield classes[own][order], exact[order]


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = K, target: float = TARGET, fit_rows: int = FIT_ROWS, branch: int = BRANCH,
            leaf_rows: int = LEAF_ROWS, calibration: int = CALIBRATION) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query row.

    Equal vectors are one class in the index, with its k + 1 smallest ids: no more of them can be
    among anyone's k nearest, as ties go to the smaller id.  So a vector that a third of all rows
    share is one entry, and it is searched for once.  The tree is fitted on a bounded sample; every
    class is placed in a leaf.  A leaf's classes are scored in blocks against the queries whose
    best-bin-first traversal visits it.  The number of visits is the least that finds ``target``
    of the true neighbours of a bounded set of calibration queries, which are compared with all
    rows; it widens up to all leaves, where the search is exact.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do those
    whose length is not the commonest one; null ids take no part; repeated rows of one id and
    vector count once; with fewer candidates than ``k`` all are returned; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"]).select("id", "v", "q", F.xxhash64("v").alias("h"),
                                                        F.xxhash64(F.lit(1), "v").alias("g"))
    rows = rows.dropDuplicates(["id", "h", "g"])

    # classes of equal vectors: at most k + 1 ids each, cut before the shuffle
    by_class = Window.partitionBy("h", "g").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    classes = (few.groupBy("h", "g").agg(F.min(F.when(F.col("r") == 1, F.struct("id", "v"))).alias("one"),
                                         F.array_sort(F.collect_list("id")).alias("ids"))
                  .select("h", "g", F.col("one.id").alias("cls"), F.col("one.v").alias("v"), "ids"))
    asked = rows.where("q").groupBy("h", "g").agg(F.count("*").alias("n")).select("h", "g")
    classes = classes.join(asked.withColumn("asked", F.lit(True)), ["h", "g"], "left").checkpoint()

    n = classes.count()
    sample = _draw(classes, n, fit_rows, 11).select("v").toPandas()
    tree = fit_tree(_matrix(sample["v"]), branch, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * fit_rows / leaf_rows * branch centres
    place = F.pandas_udf(lambda v: pd.Series(shared.value.place(_matrix(v))), "bigint")
    index = classes.withColumn("leaf", place("v")).checkpoint()

    queries = index.where("asked")
    visits = _calibrate(index, queries, tree, shared, k, target, calibration)
    found = _search(index, queries, shared, visits, k, kind)

    # the classes found, opened into ids; each query row leaves itself out
    opened = found.join(index.select("cls", "ids"), "cls").select("qh", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qh").orderBy(F.desc("score"), "vec_id")
    opened = opened.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = opened.groupBy("qh").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    who = rows.where("q").join(queries.select("h", "g", F.col("cls").alias("qh")), ["h", "g"])
    out = who.join(lists, "qh").select(F.col("id").alias("query_id"), F.slice(
        F.filter("list", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("list"))
    return out.select("query_id", F.posexplode("list").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"))


def _draw(classes: DataFrame, n: int, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` classes by seeded hash; those above a hash limit are not ordered at all."""
    h = F.xxhash64(F.lit(seed), "h")
    part = min(1.0, (2 * rows + 50) / max(n, 1))
    return classes.where(h <= int(part * (2 ** 64 - 2048)) - 2 ** 63).orderBy(h).limit(rows)


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, shared, k: int, target: float,
               calibration: int) -> int:
    """The least number of leaf visits that finds ``target`` of the true neighbours.

    The calibration queries meet every class once; the true neighbours come back with their leaf,
    and a neighbour is found by so many visits as its leaf's place in the query's traversal.
    """
    some = _draw(queries, queries.count(), calibration, 13).select("v").toPandas()
    if not len(some):
        return tree.n_leaves
    q = _matrix(some["v"])
    # one more per class list: copies of the query itself are neighbours too
    def truth(batches):
        for pdf in batches:
            x, leaf = _matrix(pdf["v"]), pdf["leaf"].to_numpy()
            spots = np.arange(len(x))
            for i, (own, s) in enumerate(_top(q, x, spots, None, k + 1)):
                yield pd.DataFrame({"i": i, "leaf": leaf[own], "score": s})

    near = index.select("v", "leaf").mapInPandas(truth, "i int, leaf bigint, score double")
    w = Window.partitionBy("i").orderBy(F.desc("score"))
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("i", "leaf").toPandas()
    places = []
    for i, own in near.groupby("i")["leaf"]:
        order = {leaf: n for n, leaf in enumerate(tree.best_bins(q[i], tree.n_leaves), 1)}
        places += [order[x] for x in own]
    places = np.sort(places)
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)])


def _search(index: DataFrame, queries: DataFrame, shared, visits: int, k: int, kind: str) -> DataFrame:
    """``(qh, cls, score)``: per query class the best k + 1 classes among the leaves it visits.

    Leaves are dealt to groups of neighbouring leaves of about ``BLOCK`` classes.  A group's classes
    are cut into blocks and the queries that visit it into chunks, both by hash, and each block
    meets each chunk in one task, which so holds some ``BLOCK`` classes and ``CHUNK`` queries
    whatever the table's size.  A query goes there with the leaves it wants.
    """
    spark = index.sparkSession
    sizes = {r[0]: r[1] for r in index.groupBy("leaf").count().collect()}  # as many as leaves
    group, blocks, g, held = {}, {}, 0, 0
    for leaf in range(max(sizes) + 1):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK:
            g, held = g + 1, 0
        group[leaf] = g
        held += n
        blocks[g] = -(-held // BLOCK) or 1
    plan = spark.sparkContext.broadcast(group)

    def send(batches):
        for pdf in batches:
            cols = {c: [] for c in ("qh", "v", "leaves", "g", "s")}
            for qh, v, h in zip(pdf["cls"], pdf["v"], pdf["h"]):
                wanted: dict[int, list[int]] = {}
                for leaf in shared.value.best_bins(np.asarray(v), visits):
                    if leaf in plan.value:
                        wanted.setdefault(plan.value[leaf], []).append(leaf)
                for g, leaves in wanted.items():
                    for c, x in zip(cols, (qh, v, leaves, g, h)):
                        cols[c].append(x)
            yield pd.DataFrame(cols)

    asks = queries.select("cls", "v", "h").mapInPandas(
        send, f"qh {kind}, v array<double>, leaves array<bigint>, g bigint, s bigint").checkpoint()
    chunks = {r[0]: -(-r[1] // CHUNK) for r in asks.groupBy("g").count().collect()}  # as many as groups
    # these two tables have a row for each leaf and group at most
    of_leaf = F.broadcast(spark.createDataFrame(list(group.items()), "leaf bigint, g bigint"))
    cuts = F.broadcast(spark.createDataFrame([(g, blocks[g], n) for g, n in chunks.items()],
                                             "g bigint, blocks bigint, chunks bigint"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    vecs = index.drop("g").join(of_leaf, "leaf").join(cuts, "g").select(
        "cls", "v", "leaf", "g", F.pmod("h", "blocks").alias("b"), each("chunks").alias("c"))
    asks = asks.join(cuts, "g").select(
        "qh", "v", "leaves", "g", each("blocks").alias("b"), F.pmod("s", "chunks").alias("c"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qh": [], "cls": [], "score": []}
        if len(left) and len(right):
            x, cls, leaf = _matrix(left["v"]), left["cls"].to_numpy(), left["leaf"].to_numpy()
            for at in range(0, len(right), QUERIES):
                some = right.iloc[at:at + QUERIES]
                allowed = np.stack([np.isin(leaf, own) for own in some["leaves"]])
                for qh, (own, s) in zip(some["qh"], _top(_matrix(some["v"]), x, cls, allowed, k + 1)):
                    for name, part in zip(out, (np.repeat(qh, len(own)), own, s)):
                        out[name].append(part)
        return pd.DataFrame({name: np.concatenate(v) if v else [] for name, v in out.items()})

    hits = (vecs.groupBy("g", "b", "c").cogroup(asks.groupBy("g", "b", "c"))
                .applyInPandas(score, f"qh {kind}, cls {kind}, score double"))
    w = Window.partitionBy("qh").orderBy(F.desc("score"), "cls")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
