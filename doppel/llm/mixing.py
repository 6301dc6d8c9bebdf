"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doppel.llm.common import WORD_RE, beside, discard, ordered_index, own_names, prepare, scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 42
#: Hash ranges a source is summed by; only the documents of one range are ordered one by one.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def water_filling(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: ``total`` by ``weight``, none above ``max_epochs * source_size``.

    The level is the target per unit of weight.  A source whose share is above its cap is clamped
    there and what it gives up raises the level of the others; this repeats until none is above.
    Clamped sources stay clamped, as the level only rises, so the loop ends.  Only four sums per
    round reach the driver.  If all caps together hold less than ``total``, all end at their caps.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        full = cap <= F.col("weight") * level
        r = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n")).first()
        if not r["free"]:
            return sources.withColumn("target", cap.cast("double"))
        new = (total - r["held"]) / r["free"]
        if new <= level:
            break
        level = new
    share = (F.col("weight") * level).cast("double")
    return sources.withColumn("target", F.least(cap.cast("double"), share))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)``; ``weights`` repeat over the sources in code
    point order, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_index(sums, F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.select("source", "source_size",
                           F.get(w, (F.col("idx") % len(weights)).cast("int")).alias("weight"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    return water_filling(ranked, share * total, max_epochs)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_taken`` (words the mix takes).

    A source's rate is target / size.  Each document is taken whole as often as the rate has whole
    units; the rest is drawn in an order by seeded hash until the target is reached.  The one
    document on the boundary is taken in part, so the source's words meet the target to within a
    word.  Nothing depends on partitioning, so reruns agree.

    The draw needs running sums over a source, and a source may hold a third of all rows: sizes
    are summed by source and hash range (map-side first), and only the documents of the range
    where the target falls are ordered one by one.  That is done on sizes and hashes, which are
    computed once and written; the texts stay where they are read, as the plan (a row a source) and
    the shares of the ordered documents are sent to them while they are small (measured).

    Sizes count words ``[^\\x20\\x09-\\x0D]+``.  A null, empty or word-free text has size 0 and is
    taken 0 times; a null source is a source of its own, the last one; null ids and repeated rows
    are rows like any (rows equal in id and text are interchangeable); an empty table gives an
    empty result.  Columns of ``docs`` named ``mix_size``, ``mix_source_size``, ``mix_target`` or
    ``mix_taken`` are replaced, others are kept, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_taken")
    size, hash_, source, own, own_hash, whole, edge, before, rest, held, upto = own_names(
        docs.columns, "size", "hash", "of", "own", "own_hash", "whole", "edge", "before", "rest", "held", "upto")
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.withColumn(size, word_count(F.col(text_col))).withColumn(hash_, h)
    range_ = F.pmod(F.shiftright(hash_, 20), F.lit(RANGES))
    path = scratch(spark, "mix-sizes")
    rows.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(hash_).alias("hash"),
                range_.alias("range")).write.parquet(path)
    sized = spark.read.parquet(path)
    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("size")).checkpoint()
    targets = source_targets(by_range, weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (targets.withColumn("whole", F.floor(rate))
               .withColumn("rest", F.greatest(F.lit(0), F.round(
                   F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")))
    # the range where the rest falls, and what the ranges before it hold
    w = Window.partitionBy("source").orderBy("range")
    run = by_range.withColumn("upto", F.sum("size").over(w))
    same = targets["source"].eqNullSafe(run["source"])
    edges = (run.join(targets.select("source", "rest"), same)
                .where((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
                .select(run["source"].alias("source"), F.col("range").alias("edge"),
                        (F.col("upto") - F.col("size")).alias("edge_before")))
    plan = beside(targets.alias("t").join(edges.alias("e"), F.expr("t.source <=> e.source"), "left")
                  .select(F.col("t.source").alias(source), F.col("source_size").alias("mix_source_size"),
                          F.col("target").alias("mix_target"), F.col("whole").alias(whole), F.col("rest").alias(rest),
                          F.coalesce("edge", F.lit(-1)).alias(edge), F.coalesce("edge_before", F.lit(0)).alias(before)))
    # what each hash in a range on the edge adds, and what its source holds before it
    on_edge = (sized.join(plan, sized["source"].eqNullSafe(plan[source]) & (sized["range"] == plan[edge]))
                    .groupBy(source, F.col("hash").alias(own_hash)).agg(F.sum("size").alias(held)))
    order = Window.partitionBy(source).orderBy(own_hash).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = beside(on_edge.withColumn(upto, F.sum(held).over(order) - F.col(held)).withColumnRenamed(source, own))
    discard(spark, path)
    joined = rows.join(plan, rows[source_col].eqNullSafe(plan[source]))
    joined = joined.join(starts, F.col(source).eqNullSafe(F.col(own)) & (F.col(hash_) == F.col(own_hash))
                         & (range_ == F.col(edge)), "left")
    left = F.least(F.col(held), F.greatest(F.lit(0), F.col(rest) - F.col(before) - F.col(upto)))
    # rows of one hash are alike and share what it takes
    part = (F.when(range_ < F.col(edge), F.col(size)).when(F.col(held) > 0, F.floor(F.col(size) * left / F.col(held)))
             .otherwise(0))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size).alias("mix_size"), "mix_source_size",
                         "mix_target", (F.col(whole) * F.col(size) + part).cast("long").alias("mix_taken"))


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per repetition the mix takes; the last one of a document may be part of its words.

    Only the document on a source's boundary has such a part: its text ends after as many words.
    """
    whole = F.col("mix_taken") / F.greatest(F.col("mix_size"), F.lit(1))
    n = F.ceil(whole).cast("int")
    rep, = own_names(mixed.columns, "rep")
    rows = mixed.where("mix_taken > 0").withColumn(rep, F.explode(F.sequence(F.lit(1), n)))
    words = F.least(F.col("mix_size"), F.col("mix_taken") - (F.col(rep) - 1) * F.col("mix_size"))
    parts = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
                    F.lit(1), words.cast("int"))
    text = F.when(words == F.col("mix_size"), F.col(text_col)).otherwise(F.concat_ws("", parts))
    return rows.withColumn(text_col, text).drop(rep, "mix_size", "mix_source_size", "mix_target",
                                                "mix_taken")
