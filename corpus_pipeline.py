"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import langid, lines, mixing, packing, simhash
from doppel.llm.common import scratch, table
from doppel.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and not ambiguous."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    known = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED)
                                               & ~F.col("lang_ambiguous"))
    return known.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; a document that was nothing else goes with them."""
    cleaned = lines.drop_boilerplate_lines(docs, "source", "text")
    cleaned = cleaned.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes."""
    mixed = mixing.repeated(mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), max_tokens=4096, eos_id=2)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("mixing sources", mix_sources), ("packing", pack)]

#: Hashing, learning and tokenizing are not SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
