"""Secret scan: key patterns and sliding-window Shannon entropy, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import prepare

# The patterns of the contract.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more
ASSIGN_MIN = 6

#: Candidate strings of the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the first that holds a window's string: (name, pattern, least entropy in
#: bits a character).  A random window of 20 has about 3.5 bits in hex and 4.1 in base 64.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.7),
           ("base64", "^[A-Za-z0-9+/_=-]+$", 3.9))
#: A placeholder is no part of a secret; what stands before and after it is judged by itself.
PLACEHOLDER = r"(?i)(example|placeholder|x{6,}|0{8,})"
#: A run that matches one of these is no secret: one case of letters only (words and headings),
#: words joined by - or _ or /, numbers and dates, uuids, placeholders.
ALLOW = (r"^[A-Z]?[a-z]+$", r"^[A-Z]+$", r"^[A-Za-z]*[-_/+=][-A-Za-z_/+=]*$", r"^[0-9][0-9_/+=-]*$",
         r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", PLACEHOLDER)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, value) of the leftmost non-overlapping matches; positions in code points.

    The text between matches is what ``split`` leaves, so a match starts after all earlier gaps
    and matches.  The running sum is kept in an ``aggregate`` over the few matches of a text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "struct<at:int,out:array<struct<start:int,value:string>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    pairs = F.transform(found, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), v.alias("v")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["v"])).alias("at"),
                        F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["v"].alias("value"))))
                        .alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, zero.cast(kind), step, lambda a: a["out"])) \
            .otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def _assign(text: Column) -> Column:
    """Matches of ASSIGN whose value has six characters or more."""
    all_ = _matches(text, ASSIGN)
    return F.filter(all_, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_MIN)


def _term(c: Column) -> Column:
    """c log2 c of a count, from a table of the window's few possible counts."""
    table = F.array(*[F.lit(0.0 if k == 0 else k * math.log2(k)) for k in range(WINDOW + 1)])
    return F.get(table, c)


def _top_entropy(value: Column) -> Column:
    """The highest entropy of any window of ``value``, in bits a character.

    With n characters of which c equal x, the entropy is log2 n - (sum of c log2 c) / n.  Moving
    the window by one changes two counts, so two terms of the sum are replaced.
    """
    code = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    code = F.filter(code, lambda c: c >= 0)
    zeros = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(zeros.alias("n"), F.lit(0.0).alias("s"), F.lit(float(WINDOW * 10)).alias("low"))
    steps = F.sequence(F.lit(0), F.size(code) - 1)

    def step(acc, i):
        new, old = F.get(code, i), F.get(code, i - WINDOW)
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == new, 1).otherwise(0)
                        - F.when(k == F.coalesce(old, F.lit(-1)), 1).otherwise(0))
        a, b = F.get(acc["n"], new), F.get(acc["n"], F.coalesce(old, F.lit(0)))
        change = F.when(old.isNull(), _term(a + 1) - _term(a)).when(old == new, F.lit(0.0)) \
            .otherwise(_term(a + 1) - _term(a) + _term(b - 1) - _term(b))
        s = acc["s"] + change
        low = F.when(i >= WINDOW - 1, F.least(acc["low"], s)).otherwise(acc["low"])
        return F.struct(n.alias("n"), s.alias("s"), low.alias("low"))

    return F.aggregate(steps, start, step, lambda a: F.lit(math.log2(WINDOW)) - a["low"] / WINDOW)


def _class_runs(value: Column) -> Column:
    """Structs (run, least): per class the longest stretches of ``value`` in it that hold a window.

    A window's class is the first that holds it, and that has the least entropy, so the windows of
    a run can all be judged by the run's class: those of an earlier class are in its runs too.
    """
    pieces = F.split(value, PLACEHOLDER, -1)

    def runs(pattern, least):
        own = F.flatten(F.transform(pieces, lambda x: F.regexp_extract_all(
            x, F.lit(f"{pattern.strip('^+$')}{{{WINDOW},}}"), F.lit(0))))
        return F.transform(own, lambda r: F.struct(r.alias("run"), F.lit(least).alias("least")))

    return F.concat(*[runs(pattern, least) for _name, pattern, least in CLASSES])


def _entropy(text: Column) -> Column:
    """Candidates with a run of one class that no allow-list entry matches and whose best window
    passes that class."""
    def passes(r):
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | r["run"].rlike(pattern)
        return ~allowed & (_top_entropy(r["run"]) >= r["least"])

    return F.filter(_matches(text, CANDIDATE), lambda m: F.exists(_class_runs(m["value"]), passes))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, rank, kind, end, value), in order.

    ``assign``, ``access`` and ``hex`` are the matches of the fixed patterns, leftmost and not
    overlapping per kind.  ``entropy`` adds candidate strings (``CANDIDATE``) in which some window
    of ``WINDOW`` characters reaches the entropy set for its own character class, unless the allow
    list names the run of that class around it.  So what a key is joined to does not hide it.  Positions count code points, ends are exclusive.  Every document is scanned
    whole in the task that reads it; nothing is shuffled.

    A null or empty text has an empty array; null ids and repeated rows are rows like any; an
    empty table gives an empty result; a column named ``secrets`` is replaced.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    finds = (_assign(text), _matches(text, ACCESS), _matches(text, HEX), _entropy(text))

    def spans(found, rank):
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"),
            (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))

    return docs.withColumn("secrets", F.array_sort(F.concat(*[spans(f, i) for i, f in enumerate(finds)])))


def digest(found: Column, kinds=KINDS) -> Column:
    """kind:start:end, comma-joined, of the spans of some kinds."""
    some = F.filter(found, lambda m: m["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def number(found: Column, kind: str) -> Column:
    """How many spans of one kind."""
    return F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long")
