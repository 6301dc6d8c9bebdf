"""Order MinHash fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doppel.llm.common import prepare, shuffle_partitions

#: Words of a k-mer, tuples of a signature (as a power of two), k-mers of a tuple.
KMER = 3
TUPLE_BITS = 6
PICK = 2
_POS = 28  # bits of a position in a text, in words
_LOW = (1 << _POS) - 1
_WHITE = " \t\n\x0b\f\r"


def _top(x: Column) -> Column:
    return F.shiftrightunsigned(x, _POS)


def add_signature(df: DataFrame, text_col: str, name: str, kmer: int = KMER,
                  tuple_bits: int = TUPLE_BITS, pick: int = PICK) -> DataFrame:
    """``df`` with ``name``: the Order MinHash entries of a text, ``tuple number << 16 | hash``.

    Repeated k-mers are told apart by their occurrence number: in the sorted list of (k-mer,
    position) a k-mer's occurrences form a run, and the number is the place in the run.  One hash
    of (k-mer, number) names a tuple by its first bits and a rank in it by the others.  Each tuple
    takes its ``pick`` lowest ranks, puts them back in text order and hashes them in that order:
    moved text changes it, equal text does not.  One hash split over the tuples stands for one
    hash function per tuple.  A tuple of fewer than ``pick`` k-mers takes the next ones by hash, round
    to the first, so that in short texts too every tuple has an order.  A text of fewer than ``kmer``
    words is one k-mer, and one without words has no entry.  All steps run inside the row; the sorts
    make it n log n.
    """
    text = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WHITE))
    own = [c for c in df.columns if c != name]
    df = df.withColumn("_w", F.when(text == "", F.array().cast("array<string>"))
                       .otherwise(F.split(text, r"[\x20\x09-\x0D]+")))
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - kmer),
                         lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(kmer)]))
    hashes = F.when(n >= kmer, hashes).when(n > 0, F.array(F.xxhash64("_w"))) \
              .otherwise(F.array().cast("array<bigint>"))
    # upper bits of the k-mer's hash, then its position
    df = df.withColumn("_s", F.array_sort(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_LOW))
                                                      .bitwiseOR(i.cast("long")))))
    at = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_b", F.filter(at, lambda i: (i == 0) | (_top(F.get("_s", i)) != _top(F.get("_s", i - 1)))))

    def numbered(first, j):
        run = F.slice("_s", first + 1, F.coalesce(F.get("_b", j + 1), F.size("_s")) - first)
        return F.transform(run, lambda x, o: F.xxhash64(_top(x), o).bitwiseAND(F.lit(~_LOW))
                           .bitwiseOR(x.bitwiseAND(F.lit(_LOW))))

    df = df.withColumn("_o", F.array_sort(F.flatten(F.transform("_b", numbered))))

    def tuple_of(x):
        return F.shiftrightunsigned(x, 64 - tuple_bits)

    df = df.withColumn("_c", F.filter("_o", lambda x, i: (i < pick)
                                      | (tuple_of(x) != tuple_of(F.get("_o", i - pick)))))
    at = F.when(F.size("_c") > 0, F.sequence(F.lit(0), F.size("_c") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_t", F.filter(at, lambda i: (i == 0) | (tuple_of(F.get("_c", i))
                                                                 != tuple_of(F.get("_c", i - 1)))))

    # the first ones again after the last, for tuples that are filled up from there
    df = df.withColumn("_r", F.concat("_c", F.slice("_c", 1, F.greatest(F.lit(0), F.least(
        F.lit(pick - 1), F.size("_c") - pick + 1)))))
    half = 1 << (tuple_bits - 1)

    def signed(x):  # tuple numbers in the order of the sorted hashes, which are signed
        return F.shiftright(x, 64 - tuple_bits).cast("int")

    def kmers_hash(first):
        # position first, so that sorting restores text order
        order = F.array_sort(F.transform(F.slice("_r", first + 1, pick), lambda x: F.shiftleft(
            x.bitwiseAND(F.lit(_LOW)), 64 - _POS).bitwiseOR(_top(x))))
        kmers = F.transform(order, lambda x: x.bitwiseAND(F.lit((1 << (64 - _POS)) - 1)))
        return F.shiftrightunsigned(F.xxhash64(kmers), 48)

    def entries(low, high, h):
        return F.transform(F.sequence(low, high), lambda t: F.shiftleft(
            t.bitwiseAND(F.lit((1 << tuple_bits) - 1)), 16).bitwiseOR(h.cast("int")))

    # tuples after the one before and up to this one start with the same k-mer; so do the last ones
    # and the first
    df = df.withColumn("_h", F.transform("_t", kmers_hash))
    last = signed(F.element_at("_c", -1))
    out = F.flatten(F.transform("_t", lambda first, j: entries(
        F.when(j == 0, F.lit(-half)).otherwise(signed(F.get("_c", first - 1)) + 1), signed(F.get("_c", first)),
        F.get("_h", j))))
    rest = F.when(last < half - 1, entries(last + 1, F.lit(half - 1), F.get("_h", F.lit(0))))
    none = F.array().cast("array<int>")
    out = F.when(F.size("_c") > 0, F.concat(out, F.coalesce(rest, none))).otherwise(none)
    return df.withColumn(name, out).select(*own, name)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the tuples that either signature has; 1 if neither has one."""
    def numbers(s):
        return F.transform(s, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(signature: Column) -> Column:
    """A signature as a string: six hex digits per tuple, two of its number and four of its hash."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def with_next(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``docs`` with ``next``, a struct of ``cols`` of the next row by descending id, ties by text.

    After the last row comes the first.  Ids are cut into ranges at approximate quantiles, one
    range per shuffle partition; within a range the next row is a window's ``lead``, and the last
    row of a range takes the first of the range below.  Only the cuts and one id per range reach
    the driver.  Null ids come last.
    """
    parts = shuffle_partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(id_col, [(i + 1) / parts for i in range(max(1, parts - 1))], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    limits = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col(id_col).isNull(), 0).otherwise(
        F.size(F.filter(limits, lambda c: c <= F.col(id_col))))
    rows = docs.withColumn("_part", part)
    heads = sorted((r[0], r[1]) for r in docs.select(part.alias("p"), id_col).groupBy("p")
                   .agg(F.max(id_col)).collect())
    value = F.struct(*cols)
    order = (F.col(id_col).desc_nulls_last(), F.col(cols[0]).desc_nulls_last())
    w = Window.partitionBy("_part").orderBy(*order)
    ranks = [p for p, _ in heads]
    above = {p: ranks[(i + 1) % len(ranks)] for i, p in enumerate(ranks)}  # the range it follows
    ids = [h for _, h in heads if h is not None]
    first = F.col(id_col).isin(ids)
    if len(ids) < len(heads):
        first = first | F.col(id_col).isNull()
    top = rows.where(first)
    to = F.create_map(*[F.lit(x) for kv in above.items() for x in kv]) if above else F.lit(None)
    top = top.select("_part", value.alias("_head"), F.row_number().over(w).alias("_r")).where("_r = 1")
    top = top.select((F.element_at(to, F.col("_part")) if above else F.lit(0)).alias("_to"), "_head")
    rows = rows.withColumn("_lead", F.lead(value).over(w))
    out = rows.join(top, rows["_part"] == top["_to"], "left")
    return out.withColumn("next", F.coalesce("_lead", "_head")).drop("_part", "_lead", "_head", "_to")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      kmer: int = KMER, tuple_bits: int = TUPLE_BITS, pick: int = PICK) -> DataFrame:
    """One row per row of ``docs``: its signature, that of its edited text and their likeness.

    Columns ``doc_id, n_chars, edited_text, signature, edited_signature, near_edited, near_next``.
    The edited text has the last third (rounded down, in code points) replaced by as many of the
    first characters of the next document by descending id, or all it has.  A null text counts as
    empty; a null id comes last in the order; rows equal in id are ordered by text; repeated rows
    stay; the only document of a table follows itself; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    rows = add_signature(rows, "text", "signature", kmer, tuple_bits, pick)
    rows = with_next(rows, "doc_id", "text", "signature")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third),
                      F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "signature",
                       edited.alias("edited_text"), F.col("next.signature").alias("next_signature"))
    rows = add_signature(rows, "edited_text", "edited_signature", kmer, tuple_bits, pick)
    return rows.select("doc_id", "n_chars", "edited_text", "signature", "edited_signature",
                       likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                       likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
