"""The registered queries of the training-data operators, one per operator.

Each callable takes ``(spark, sf_dir)``, applies its operator with the parameters set here to the
whole table and derives the returned columns from the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import (ann, extract, jaccard, langid, lines, minhash, mixing, packing, runs, secrets, simhash,
                        substrings, whitening)
from doppel.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = minhash.edit_fingerprints(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                    minhash.as_text(F.col("signature")).alias("fingerprint"),
                    minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
                    "near_edited", "near_next")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines.drop_boilerplate_lines(table(spark, sf_dir, "documents"), "source", "text")
    return r.select("doc_id", "source", "n_lines", "n_dropped",
                    F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                        max_tokens=4096, eos_id=2, keep_ids=False, cache=(250_000, 1_500_000))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return r.select("doc_id", "source", F.col("mix_size").alias("size"),
                    F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                    F.col("mix_taken").alias("taken"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("secrets")
    r = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.KINDS[:3]
    return r.select("doc_id", *[secrets.number(found, k).alias(f"n_{k}") for k in secrets.KINDS],
                    F.sha2(secrets.digest(found, base).cast("binary"), 256).alias("base_sha256"),
                    secrets.digest(found).alias("spans"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_strings(table(spark, sf_dir, "documents"), length=200)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    r = langid.identify(docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out")), model)
    return r.select("doc_id", "held_out", "lang_pred", "score", "lang_ambiguous")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = runs.periodic_runs(docs)
    line = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    return r.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_order_minhash, op3_nearest, op4_line_dedup, op5_packing,
                                    op6_mixing, op7_html, op8_secrets, op9_substrings, op10_langid,
                                    op11_runs, op12_jaccard, op13_whitening)}


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS l
           FROM documents),
x AS (SELECT rid, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
pages AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY source),
n AS (SELECT d.source, trim(x.line) AS k, count(DISTINCT d.text) AS c
      FROM x JOIN d USING (rid) GROUP BY 1, 2),
bad AS (SELECT n.source, k FROM n JOIN pages ON n.source IS NOT DISTINCT FROM pages.source
        WHERE k <> '' AND c >= {lines.MIN_PAGES} AND c > pages * {lines.MAX_RATIO}),
y AS (SELECT x.rid, x.i, x.line, bad.k IS NOT NULL AS gone
      FROM x LEFT JOIN bad ON x.source IS NOT DISTINCT FROM bad.source AND trim(x.line) = bad.k),
z AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
      FROM y GROUP BY rid)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM d LEFT JOIN z USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """Only line dedup is SQL: the others hash, tokenise, learn or search (see tests/llm)."""
    return {"op4_line_dedup": OP4_SQL}
