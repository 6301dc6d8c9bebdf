"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import beside, own_names, prepare

#: A line on more than this share of its host's pages is boilerplate.
MAX_RATIO = 0.05
#: ... if it is on so many pages at least: two or three pages of a small host are no evidence.
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """128 bits of a line without its outer blanks; null for a blank line."""
    t = F.trim(line)
    return F.when(t == "", None).otherwise(F.struct(F.xxhash64(t).alias("a"),
                                                    F.xxhash64(F.lit(1), t).alias("b")))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, bad)``: the keys of each host's boilerplate lines.

    A page counts once for a line, however often it has it, and exact copies of a page on a host
    are one page: a text posted a hundred times is not boilerplate of itself.  Counts are
    aggregated map-side, and page or line is part of the key, so a host with a third of all pages
    is spread over all tasks.
    """
    text = F.col(text_col)
    keys = F.array_distinct(F.transform(F.split(text, "\n"), _key))
    once = (pages.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("p"),
                         F.xxhash64(F.lit(1), text).alias("q"), keys.alias("keys"))
                 .dropDuplicates(["host", "p", "q"]))
    totals = (pages.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("p"),
                           F.xxhash64(F.lit(1), text).alias("q")).distinct()
                   .groupBy("host").agg(F.count("*").alias("pages")))
    counts = (once.select("host", F.explode("keys").alias("k")).where("k is not null")
                  .select("host", "k.a", "k.b").groupBy("host", "a", "b")
                  .agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    c, t = counts.alias("c"), totals.alias("t")
    return (c.join(t, F.expr("c.host <=> t.host"))
             .where(F.col("n") > F.col("pages") * max_ratio)
             .groupBy(F.col("c.host").alias("host"))
             .agg(F.collect_list(F.struct("a", "b")).alias("bad")))


def drop_boilerplate_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text",
                           max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines of each host taken out of ``text_col``, and
    ``n_lines``, ``n_dropped``.

    For each host, the pages that contain a line are divided by the host's pages, copies of a page
    counting once; lines above ``max_ratio`` (and on ``min_pages`` pages or more) go.  Lines are compared without outer
    blanks; kept lines stay as they are, in order.  A host's list of such lines is short: a page
    has few lines, so at most (lines per page) / ``max_ratio`` can pass.  The lists are written first:
    while they are small (measured) they go to the pages, which are read and cleaned where they are;
    beyond that they are joined by host, and adaptive execution splits a hot one.

    Blank lines are kept and never counted.  A null text stays null with 0 lines; null hosts are
    one host; repeated rows are cleaned alike and count as one page; an empty table gives an empty result;
    columns named ``n_lines`` or ``n_dropped`` are replaced, others are kept, whatever their names.
    """
    prepare(pages.sparkSession)
    rows = pages.drop("n_lines", "n_dropped")
    host, bad, lines, kept = own_names(pages.columns, "host", "bad", "lines", "kept")
    lists = beside(boilerplate(pages, host_col, text_col, max_ratio, min_pages).toDF(host, bad))
    text = F.col(text_col)
    rows = rows.join(lists, rows[host_col].eqNullSafe(lists[host]), "left").drop(host)
    rows = rows.withColumn(lines, F.split(text, "\n"))
    rows = rows.withColumn(kept, F.when(F.col(bad).isNull(), F.col(lines)).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _key(x)), F.lit(False)))))
    dropped = F.size(lines) - F.size(kept)
    cleaned = F.when(text.isNull() | (dropped == 0), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns
                         if c.lower() not in ("n_lines", "n_dropped")],
                       F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                       F.when(text.isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"))
