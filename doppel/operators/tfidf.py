"""TF-IDF fit and transform.

Weights follow the reference's vectorizer settings: unigram tokens of 2+ letters, raw counts,
sublinear tf ``1 + ln(tf)``, smooth idf ``ln((1 + N) / (1 + df)) + 1``, L2 row normalisation;
vocabulary limited to terms with ``min_df <= df <= max_df`` and then to the ``max_features``
terms of highest corpus frequency (ties: term ascending); term ids follow alphabetical order.

Physical shape
--------------
* term counts are computed inside each document row (``bag_of_words``) -> no shuffle;
* document/corpus frequencies: one ``groupBy(term)`` with map-side partial aggregation;
* weights and norms: where the vocabulary is small in rows and bytes (checked), every task looks the
  terms of its documents up and no posting is shuffled; beyond that, one join and one
  ``groupBy(doc)`` whose partial aggregation packs each document's postings map-side;
* the cut to ``max_features`` first drops the terms below a power of two of the corpus frequency
  that the cut cannot reach; term ids of an uncapped vocabulary come from a sort and counts of its
  ranges, so no task holds it.
"""

from __future__ import annotations

import numbers
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.functions.text import SLICE_TEXTS, bag_of_words, bag_of_words_batched, run_lengths, slices, tokens
from doppel.session import cached, keep

# A vocabulary of at most so many terms and UTF-8 bytes is looked up inside the tasks.
LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 16 << 20


def term_bags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content",
              engine: str = "python") -> DataFrame:
    """(id, terms ARRAY<STRING>, counts ARRAY<INT>) per document, computed without a shuffle.

    ``engine='python'``: Arrow-batched ``re.findall`` + ``Counter`` (the faster path, measured);
    ``engine='jvm'``: regexp_extract_all, sort_array and run lengths in SQL expressions.
    """
    if engine == "python":
        return (docs.select(F.col(id_col), bag_of_words_batched(text_col).alias("bag"))
                .select(id_col, F.col("bag.terms").alias("terms"), F.col("bag.counts").alias("counts")))
    # Three projections on purpose: each lambda below reads the column materialised by the one
    # before it instead of re-evaluating the regex and the sort per array element.
    return (docs.select(F.col(id_col), F.sort_array(tokens(text_col)).alias("_sorted"))
            .select(id_col, "_sorted", bag_of_words("_sorted").alias("_runs"))
            .select(id_col, run_lengths("_runs", "_sorted").alias("bag"))
            .select(id_col, F.col("bag.terms").alias("terms"), F.col("bag.counts").alias("counts")))


def term_frequencies(bags: DataFrame, id_col: str = "doc_id", keep_empty: bool = False) -> DataFrame:
    """Long form (id, term, tf) (A2).  ``keep_empty`` keeps token-less documents as a null row."""
    explode = F.explode_outer if keep_empty else F.explode
    return (bags.select(id_col, explode(F.arrays_zip("terms", "counts")).alias("p"))
            .select(id_col, F.col("p.terms").alias("term"), F.col("p.counts").alias("tf")))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df, cf): documents containing the term and its total count (A3)."""
    return (tf.where(F.col("term").isNotNull()).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))


def _doc_count_bound(value, n_docs: int) -> float:
    return float(value) if isinstance(value, numbers.Integral) else float(value) * n_docs


@dataclass
class TfidfModel:
    """A fitted vectorizer plus the corpus vectors it produced.

    ``vocabulary``: (term, term_id, df, cf, idf, order_rank); ``order_rank`` orders terms from
    rare to common and drives the prefix filter of the similarity join.
    ``vectors``: array form (id, term_ids ARRAY<INT>, weights ARRAY<DOUBLE>), one row per
    document, zero vectors included as empty arrays.
    """

    vocabulary: DataFrame
    vectors: DataFrame
    n_docs: int
    vocab_size: int
    id_col: str = "doc_id"
    max_features: int | None = 10000
    min_df: float = 2
    max_df: float = 0.8

    # -- views ---------------------------------------------------------------------------
    def long_form(self, with_term: bool = False) -> DataFrame:
        """(id, term_id, weight) postings; zero vectors have no rows (P5)."""
        out = explode_vectors(self.vectors, self.id_col)
        if with_term:
            out = out.join(self.vocabulary.select("term_id", "term"), "term_id")
        return out

    # -- J11 -----------------------------------------------------------------------------
    def transform(self, docs: DataFrame, id_col: str | None = None,
                  text_col: str = "content") -> DataFrame:
        """Vectorise new documents with the frozen vocabulary, idf and N (unknown terms ignored)."""
        id_col = id_col or self.id_col
        # the bag stays one column, so that one Python worker counts and weighs
        return weigh(docs.select(id_col, bag_of_words_batched(text_col).alias("_bag")), self.vocabulary, id_col)


def weigh(bags: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """L2-normalised array-form vectors, by lookup in the tasks or, beyond its bound, by a join.

    ``bags``: (id, terms, counts), or (id, _bag) with both in a struct.
    """
    packed = "_bag" in bags.columns
    rows, size = vocab.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if rows > LOOKUP_ROWS or (size or 0) > LOOKUP_BYTES:
        return _weigh_by_join(bags.select(id_col, "_bag.*") if packed else bags, vocab, id_col)
    known = vocab.orderBy("term_id").select("term", "term_id", "idf").toPandas()  # within the bound
    shared = bags.sparkSession.sparkContext.broadcast(
        (dict(zip(known["term"], range(len(known)))), known["term_id"].to_numpy(np.int32),
         known["idf"].to_numpy(np.float64)))

    @F.arrow_udf("term_ids array<int>, weights array<double>")
    def look_up(bags: pa.Array) -> pa.Array:
        place, ids, idf = shared.value

        def weighed(own: pa.Array, n: pa.Array) -> pa.Array:
            texts = own.flatten().dictionary_encode()  # a term is a Python object once for each part
            places = np.fromiter((place.get(t, -1) for t in texts.dictionary.to_pylist()), np.int64, len(texts.dictionary))
            at = places[texts.indices.to_numpy()] if len(texts) else np.zeros(0, np.int64)
            tf, inside = n.flatten().to_numpy().astype(np.float64), at >= 0
            row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))[inside]
            at = at[inside]  # terms ascend in a bag, as term ids do
            w = (1.0 + np.log(tf[inside])) * idf[at]
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            for lo, hi in zip(ends[:-1], ends[1:]):
                w[lo:hi] /= np.sqrt((w[lo:hi] * w[lo:hi]).sum())
            offsets = pa.array(ends.astype(np.int32))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(ids[at], pa.int32())),
                                               pa.ListArray.from_arrays(offsets, pa.array(w, pa.float64()))],
                                              ["term_ids", "weights"])

        return pa.concat_arrays([weighed(x.field("terms"), x.field("counts")) for x in slices(bags, SLICE_TEXTS)])

    bag = F.col("_bag") if packed else F.struct("terms", "counts")
    return (bags.select(id_col, look_up(bag).alias("v"))
                .select(id_col, "v.term_ids", "v.weights"))


def _weigh_by_join(bags: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    tf = term_frequencies(bags, id_col, keep_empty=True)
    joined = tf.join(vocab.select("term", "term_id", "idf"), "term", "left")
    w = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    packed = (joined.groupBy(id_col).agg(
        F.sort_array(F.collect_list(
            F.when(F.col("term_id").isNotNull(), F.struct(F.col("term_id"), w.alias("w"))))
        ).alias("entries"),
        F.sum(F.when(F.col("term_id").isNotNull(), w * w)).alias("ss")))
    norm = F.sqrt(F.col("ss"))
    return packed.select(
        id_col,
        F.transform("entries", lambda e: e["term_id"]).alias("term_ids"),
        F.transform("entries", lambda e: e["w"] / norm).alias("weights"))


def explode_vectors(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Array form -> long form (id, term_id, weight); a narrow projection."""
    return (vectors.select(id_col, F.explode(F.arrays_zip("term_ids", "weights")).alias("p"))
            .select(id_col, F.col("p.term_ids").alias("term_id"), F.col("p.weights").alias("weight")))


def _reachable(terms: DataFrame, most: int) -> DataFrame:
    """The terms at or above the greatest power of two of ``cf`` that ``most`` terms reach.

    The cut by corpus frequency keeps none below it, so every task hands a fraction to the sort.
    """
    power = F.floor(F.log2("cf")).cast("int")
    counts = terms.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect()  # 64 rows at most
    total = 0
    for r in counts:
        total += r["count"]
        if total >= most:
            return terms.where(power >= r["p"])
    return terms


def number_rows(df: DataFrame, order: list[str], name: str, kind: str = "int") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the total order ``order``, without a single-task window.

    A global sort cuts the rows into ranges; a row's number is its place in its range plus the
    sizes of the ranges before.  The ranges are checkpointed, as their numbers must not change.
    """
    ranges = df.orderBy(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    before, start = 0, {}
    for at, n in sizes:  # one entry per range
        start[at], before = before, before + n
    if not start:
        return ranges.drop("_range").withColumn(name, F.lit(0).cast(kind))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn(name, (place + offset).cast(kind)).drop("_range")


def fit_tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content",
              max_features: int | None = 10000, min_df: float = 2, max_df: float = 0.8,
              persist: bool = True) -> TfidfModel:
    """Fit the vocabulary on ``docs`` (already normalised) and vectorise them (M1)."""
    bags = term_bags(docs, id_col, text_col)
    if persist:
        bags = cached(bags)
    n_docs = bags.count()
    if n_docs == 0:
        raise ValueError("empty corpus: nothing to fit")
    high = _doc_count_bound(max_df, n_docs)
    low = _doc_count_bound(min_df, n_docs)
    if high < low:
        raise ValueError("max_df corresponds to < documents than min_df")

    stats = document_frequencies(term_frequencies(bags, id_col))
    kept = stats.where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
    kept = keep(kept) if persist else kept
    if max_features is not None:
        kept = _reachable(kept, max_features).orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
        # both windows run over at most max_features rows
        kept = (kept.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
                    .withColumn("order_rank", (F.row_number().over(Window.orderBy("df", "term")) - 1).cast("int")))
    else:
        kept = number_rows(number_rows(kept, ["term"], "term_id"), ["df", "term"], "order_rank")
    vocab = (kept.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)
             .select("term", "term_id", "df", "cf", "idf", "order_rank"))
    if persist:
        vocab = cached(vocab)
    vocab_size = vocab.count()
    if vocab_size == 0:
        raise ValueError("After pruning, no terms remain. Try a lower min_df or a higher max_df.")
    model = TfidfModel(vocab, None, n_docs, vocab_size, id_col, max_features, min_df, max_df)  # type: ignore[arg-type]
    vectors = weigh(bags, vocab, id_col)
    if persist:
        vectors = cached(vectors)
        vectors.count()  # materialise once; every later job reads the cached vectors
        bags.unpersist()
    model.vectors = vectors
    return model
