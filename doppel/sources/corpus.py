"""Corpus sources (S1, S2, F1): a table of texts or a folder of ``*.txt`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions.text import NOT_WHITESPACE, is_non_blank, normalize_text, normalize_text_batched

# U+FFFD is what a cast from invalid UTF-8 bytes produces; dropping it equals decoding
# with errors='ignore'.
REPLACEMENT_CHAR = "�"


def from_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               out_id: str = "doc_id", engine: str = "python", keep: tuple[str, ...] = (),
               drop_blank: bool = True) -> DataFrame:
    """Normalised corpus ``(doc_id, content)`` from any table; blank texts are dropped.

    Incoming documents keep blank texts (``drop_blank=False``; their content is empty), as each
    upload gets a status.  ``keep`` names further columns to carry along.

    ``engine='python'`` normalises with the Arrow-batched UDF (faster, see
    ``normalize_text_batched``); ``engine='jvm'`` keeps the whole step in SQL expressions.
    """
    norm = normalize_text_batched if engine == "python" else normalize_text
    rows = df.where(is_non_blank(text_col)) if drop_blank else df
    text = norm(text_col) if drop_blank else F.coalesce(norm(text_col), F.lit(""))
    return rows.select(F.col(id_col).alias(out_id), text.alias("content"), *keep)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when its scan has fewer splits than the cluster has cores.

    A large corpus arrives in many files and needs no help; a single-row-group file would
    otherwise tokenise in one task.  The partitioning by document id is reused downstream by the
    per-document aggregations, so it does not add a shuffle to the later stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def load_documents(spark: SparkSession, sf_dir: str, table: str = "documents",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Read a Parquet text table (only the two needed columns reach the scan)."""
    raw = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(id_col, text_col), id_col)
    return from_table(raw, id_col, text_col)


def _file_stem(path_col: str = "path") -> F.Column:
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    # Hadoop paths are URL encoded; protect literal '+' before decoding.
    name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.txt$", "")


def read_text_dir(spark: SparkSession, path: str, strict_utf8: bool = False) -> DataFrame:
    """Non-recursive ``*.txt`` files -> ``(doc_id STRING, raw STRING, valid_utf8 BOOLEAN)``.

    Invalid bytes are dropped (``errors='ignore'``) unless ``strict_utf8`` is set, in which case
    ``raw`` is null for undecodable files and ``valid_utf8`` is false.  A missing folder gives an
    empty result, as the reference logs and continues.
    """
    schema = "doc_id string, raw string, valid_utf8 boolean"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
             .option("recursiveFileLookup", "false").load(path))
    return decode_files(files.select(_file_stem().alias("doc_id"), "content"), strict_utf8)


def decode_files(files: DataFrame, strict_utf8: bool = False) -> DataFrame:
    """``(doc_id, content BINARY)`` -> ``(doc_id, raw STRING, valid_utf8)``, as ``read_text_dir`` has them."""
    decoded = F.regexp_replace(F.col("content").cast("string"), REPLACEMENT_CHAR, "")
    valid = F.is_valid_utf8(F.col("content"))
    raw = F.when(valid | F.lit(not strict_utf8), decoded)
    return files.select("doc_id", raw.alias("raw"), valid.alias("valid_utf8"))


def read_corpus_dir(spark: SparkSession, path: str) -> DataFrame:
    """Corpus from a folder: decode leniently, drop blank files, normalise."""
    files = read_text_dir(spark, path)
    return (files.where(F.col("raw").rlike(NOT_WHITESPACE))
            .select("doc_id", normalize_text("raw").alias("content")))


def read_incoming(spark: SparkSession, folder: str, requested: DataFrame, corpus: DataFrame,
                  name_col: str = "doc_name") -> DataFrame:
    """S2 + the request half of C4: requested names -> (doc_id, content, status).

    ``not_found`` when ``<name>.txt`` is missing (404), ``exists`` when the id is already in the
    corpus (409), ``invalid`` when the bytes are not UTF-8 (400, strict decoding like the upload
    path), otherwise ``ok`` with the stripped, normalised content.  No blank filter, as uploads
    have none.
    """
    req = requested.select(F.col(name_col).cast("string").alias("doc_id")).distinct()
    known = corpus.select(F.col("doc_id").cast("string").alias("doc_id"))
    return judge_requests(req, read_text_dir(spark, folder, strict_utf8=True), known)


def judge_requests(requests: DataFrame, files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Requests (doc_id, ...) with ``content`` and ``status`` by the rules of ``read_incoming``.

    ``files`` are strictly decoded ones; a name that is asked for again keeps its rows.
    """
    known = corpus.select("doc_id").distinct().withColumn("_known", F.lit(True))
    joined = requests.join(files, "doc_id", "left").join(known, "doc_id", "left")
    status = (F.when(F.col("valid_utf8").isNull(), F.lit("not_found"))
              .when(F.col("_known").isNotNull(), F.lit("exists"))
              .when(~F.col("valid_utf8"), F.lit("invalid"))
              .otherwise(F.lit("ok")))
    content = F.when(status == "ok", normalize_text(F.col("raw")))
    rest = [c for c in requests.columns if c != "doc_id"]
    return joined.select("doc_id", *rest, content.alias("content"), status.alias("status"))
