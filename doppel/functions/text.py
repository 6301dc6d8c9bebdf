"""Text normalisation and tokenisation as JVM-side column expressions."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Whitespace: every character Python's ``str`` regex ``\s`` matches, spelled out so that the
# Java (Spark) and RE2 (DuckDB oracle) engines use the very same set:
#   \t \n \x0B \f \r \x1C-\x1F space \x85 \xA0 U+1680 U+2000-U+200A U+2028 U+2029 U+202F U+205F U+3000
# Kept characters after lower-casing: ASCII letters, digits, whitespace and . , ! ?
# Token pattern: alphabetic runs of two or more letters between word boundaries.
# ---------------------------------------------------------------------------
WHITESPACE_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WHITESPACE_RUN = "[" + WHITESPACE_CHARS + "]+"
NOT_WHITESPACE = "[^" + WHITESPACE_CHARS + "]"
DROPPED_CHARS = r"[^a-zA-Z0-9\s.,!?]"
TOKEN_PATTERN = r"\b[a-zA-Z]{2,}\b"


def normalize_text(text: Column | str) -> Column:
    """lower -> collapse whitespace runs to one space -> drop other characters -> strip.

    The order matters: deleting characters after the collapse can leave double spaces
    (``"a - b"`` -> ``"a  b"``), exactly as the reference does.
    """
    col = F.col(text) if isinstance(text, str) else text
    collapsed = F.regexp_replace(F.lower(col), WHITESPACE_RUN, " ")
    return F.trim(F.regexp_replace(collapsed, DROPPED_CHARS, ""))


def normalize_text_batched(text: Column | str) -> Column:
    """``normalize_text`` as an Arrow-batched UDF using Python's own ``re``.

    Same result as the JVM expression (the checks compare both), measured about 5x faster on the
    sf0.1 corpus (0.9 s against 4.5 s on 8 cores): Java's ``lower`` and ``regexp_replace`` convert
    every non-ASCII string, while CPython's ``re`` scans ``str`` directly.
    """
    col = F.col(text) if isinstance(text, str) else text
    return _normalize_udf()(col)


_UDF_CACHE: dict = {}

#: Texts that are Python objects at a time; the rest of a batch stays in Arrow's buffers.
SLICE_TEXTS = 256


def slices(batch: pa.Array, rows: int):
    """``batch`` in parts of ``rows``, one empty part if it has none."""
    return (batch.slice(at, rows) for at in range(0, max(len(batch), 1), rows))


def _normalize_udf():
    if "norm" not in _UDF_CACHE:
        @F.arrow_udf("string")
        def normalize(batch: pa.Array) -> pa.Array:
            import re
            ws = re.compile(r"\s+")
            drop = re.compile(r"[^a-zA-Z0-9\s.,!?]")
            return pa.concat_arrays([pa.array(
                [None if t is None else drop.sub("", ws.sub(" ", t.lower())).strip() for t in part.to_pylist()],
                pa.string()) for part in slices(batch, SLICE_TEXTS)])

        _UDF_CACHE["norm"] = normalize
    return _UDF_CACHE["norm"]


def bag_of_words_batched(content: Column | str) -> Column:
    """Term counts per document as ``struct<terms, counts>`` from an Arrow-batched UDF.

    Same output as ``bag_of_words`` over ``tokens`` (terms ascending), measured several times
    faster: CPython's ``re.findall`` and ``Counter`` against interpreted array lambdas.
    """
    col = F.col(content) if isinstance(content, str) else content
    return _bag_udf()(col)


def count_words(texts: pa.Array) -> pa.Array:
    """Terms in ascending order and their counts for each text, as an array of structs of two lists."""
    import re
    pattern = re.compile(r"\b[a-zA-Z]{2,}\b")
    terms, counts, ends = [], [], [0]
    for text in texts.to_pylist():
        c = Counter(pattern.findall(text)) if text is not None else Counter()
        keys = sorted(c)
        terms += keys
        counts += [c[k] for k in keys]
        ends.append(len(terms))
    offsets = pa.array(ends, pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())),
                                       pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["terms", "counts"])


def _bag_udf():
    if "bag" not in _UDF_CACHE:
        @F.arrow_udf("terms array<string>, counts array<int>")
        def bag(batch: pa.Array) -> pa.Array:
            return pa.concat_arrays([count_words(part) for part in slices(batch, SLICE_TEXTS)])

        _UDF_CACHE["bag"] = bag
    return _UDF_CACHE["bag"]


def is_non_blank(text: Column | str) -> Column:
    """True when the raw text has a non-whitespace character (the corpus keeps only those)."""
    col = F.col(text) if isinstance(text, str) else text
    return col.isNotNull() & col.rlike(NOT_WHITESPACE)


def tokens(content: Column | str) -> Column:
    """Alphabetic tokens of two or more letters, in document order (unigrams, no stop words)."""
    col = F.col(content) if isinstance(content, str) else content
    return F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0)


def word_count(content: Column | str) -> Column:
    """Number of whitespace-separated words (``len(text.split())`` on normalised text)."""
    col = F.col(content) if isinstance(content, str) else content
    return F.size(F.filter(F.split(col, " "), lambda w: w != ""))


def bag_of_words(sorted_tokens: Column | str) -> Column:
    """Per-document term counts computed inside the row: ``struct<terms: array, counts: array>``.

    ``sorted_tokens`` must be an *already materialised* sorted token column (see
    ``doppel.operators.tfidf.term_bags``): the lambdas below reference it many times and a
    lambda re-evaluates an inlined expression for every element.  Measuring run lengths of the
    sorted array keeps the term-frequency step free of any shuffle: every document is counted in
    the task that read it.
    """
    s = F.col(sorted_tokens) if isinstance(sorted_tokens, str) else sorted_tokens
    n = F.size(s)
    empty = F.array().cast("array<int>")
    starts = F.when(n > 0, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1)))).otherwise(empty)
    return F.struct(starts.alias("starts"), n.alias("n"))


def run_lengths(runs: Column | str, sorted_tokens: Column | str) -> Column:
    """Second half of ``bag_of_words``: (starts, n) -> struct<terms, counts>."""
    r = F.col(runs) if isinstance(runs, str) else runs
    s = F.col(sorted_tokens) if isinstance(sorted_tokens, str) else sorted_tokens
    starts, n = r["starts"], r["n"]
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
    terms = F.transform(starts, lambda i: F.element_at(s, i))
    counts = F.when(n > 0, F.zip_with(starts, ends, lambda a, b: b - a)) \
        .otherwise(F.array().cast("array<int>"))
    return F.struct(terms.alias("terms"), counts.alias("counts"))
