"""Duplicate checks and admission of new documents.

The reference checks and admits one uploaded document at a time.  Here a whole batch is checked
in one set-based job, and the one-after-another meaning is kept: a document is admitted iff no
corpus document and no *earlier admitted* document of the batch duplicates it.  Rows that share a text
are one node of the duplicate graph, rows that share an id one group, so its size is linear in the rows
and the pairs of different similar texts; ``decide`` resolves it by components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.operators.decide import decide, numbered, with_occurrence
from doppel.operators.search import rank_hits
from doppel.operators.simjoin import threshold_join
from doppel.operators.tfidf import TfidfModel
from doppel.session import keep

DUP_CAP = 50     # hits kept per method in a duplicate check
REPORT_TOP = 5   # hits shown per method for a suspected duplicate


# ------------------------------------------------------------------------------- exact
def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, duplicate_of): every document whose text equals an earlier (smaller) id's text.

    Each group's first id comes from a map-side combined aggregate over two independent hashes of
    the text and joins back on them, so no task holds a group of copies and AQE can split a hot one.
    """
    keyed = docs.select(id_col, F.xxhash64(text_col).alias("_h"), F.md5(text_col).alias("_m"))
    first = (keyed.groupBy("_h", "_m").agg(F.min(id_col).alias("duplicate_of"), F.count("*").alias("_n"))
             .where(F.col("_n") > 1).drop("_n"))
    return (keyed.join(first, ["_h", "_m"]).where(F.col(id_col) != F.col("duplicate_of"))
            .select(id_col, "duplicate_of"))


def exact_matches(new_docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id",
                  text_col: str = "content") -> DataFrame:
    """(doc_id, id): for each new document the first corpus document with the same text.

    Texts are the same if their SHA-256 is, as in ``admit``.  Ids and hashes meet before any aggregation, so
    no text is shuffled, only matching rows are grouped and a small incoming batch can be broadcast (AQE
    decides at run time from its measured size).
    """
    def hashed(text: F.Column) -> F.Column:
        return F.unhex(F.sha2(text.cast("binary"), 256)).alias("_h")

    new = new_docs.select(id_col, hashed(F.trim(F.col(text_col))))
    old = corpus.select(F.col(id_col).alias("id"), hashed(F.col(text_col)))
    return new.join(old, "_h").groupBy(id_col).agg(F.min("id").alias("id"))


# ------------------------------------------------------------------------------- upsert
def upsert(base: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key; others are added."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


# ------------------------------------------------------------------------------- check
def duplicate_hits(new_docs: DataFrame, corpus_docs: DataFrame, model: TfidfModel | None,
                   corpus_emb: DataFrame | None = None, new_emb: DataFrame | None = None,
                   tfidf_threshold: float = 0.7, embedding_threshold: float = 0.8,
                   cap: int = DUP_CAP, id_col: str = "doc_id", exclude_same_id: bool = True) -> DataFrame:
    """C1 flat form: (doc_id, method, id, similarity_score, rank) for a batch of new documents.

    Phase 1 (exact text) short-circuits: such a document reports the matching corpus id in both
    lists with score 1.0.  Phase 2 runs on the others only: TF-IDF with the frozen model against
    every corpus vector (never cluster-blocked), embeddings if both embedding inputs are given.
    ``exclude_same_id=False`` is for new documents whose numbers are no ids of the corpus.
    """
    # The incoming batch feeds several branches; keep it (it is the small side of every join).
    new_docs = keep(new_docs)
    if new_emb is not None:
        new_emb = keep(new_emb)
    exact = keep(exact_matches(new_docs, corpus_docs, id_col))  # else each phase hashes the corpus again
    exact_rows = exact.select(
        F.col(id_col), F.explode(F.array(F.lit("tfidf"), F.lit("embedding"))).alias("method"),
        "id", F.lit(1.0).alias("similarity_score"), F.lit(1).alias("rank"))
    rest = new_docs.join(exact.select(id_col), id_col, "left_anti")
    parts = [exact_rows]
    if model is not None:
        vecs = keep(model.transform(rest, id_col))
        hits = threshold_join(vecs, model.vectors, model.vocabulary, tfidf_threshold, id_col,
                              n_right=model.n_docs, exclude_same_id=exclude_same_id, best=cap)
        ranked = rank_hits(hits.select(F.col("a").alias("query_document_id"), F.col("b").alias("id"),
                                       "similarity"), cap, method="tfidf")
        parts.append(ranked.select(F.col("query_document_id").alias(id_col), "method", "id",
                                   "similarity_score", "rank"))
    if corpus_emb is not None and new_emb is not None:
        from doppel.operators.embeddings import embedding_hits
        q = new_emb.join(rest.select(id_col), id_col, "left_semi")
        hits = embedding_hits(q, corpus_emb, embedding_threshold, id_col, exclude_same_id=exclude_same_id, best=cap)
        ranked = rank_hits(hits, cap, method="embedding")
        parts.append(ranked.select(F.col("query_document_id").alias(id_col), "method", "id",
                                   "similarity_score", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_summary(new_docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """C1 result per new document (D8) with A6 maxima, T5 top-5 report and U1 message."""
    per = hits.groupBy(id_col).agg(
        F.max(F.when(F.col("method") == "tfidf", F.col("similarity_score"))).alias("max_tfidf"),
        F.max(F.when(F.col("method") == "embedding", F.col("similarity_score"))).alias("max_embedding"),
        F.sum(F.when(F.col("method") == "tfidf", 1).otherwise(0)).alias("n_tfidf"),
        F.sum(F.when(F.col("method") == "embedding", 1).otherwise(0)).alias("n_embedding"),
        F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), ", ").alias("ids"))
    out = new_docs.select(id_col).join(per, id_col, "left")
    return out.select(
        id_col,
        (F.coalesce(F.col("n_tfidf"), F.lit(0)) + F.coalesce(F.col("n_embedding"), F.lit(0)) > 0)
        .alias("has_duplicates"),
        F.coalesce("max_tfidf", F.lit(0.0)).alias("max_tfidf_similarity"),
        F.coalesce("max_embedding", F.lit(0.0)).alias("max_embedding_similarity"),
        F.coalesce("n_tfidf", F.lit(0)).cast("int").alias("n_tfidf"),
        F.coalesce("n_embedding", F.lit(0)).cast("int").alias("n_embedding"),
        F.when(F.col("ids").isNotNull(),
               F.concat(F.lit("Document "), F.col(id_col).cast("string"), F.lit(" has duplicates: "),
                        F.col("ids"))).alias("message"))


def duplicate_ids(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, id), the different ids a new document duplicates, whichever method found them."""
    return hits.select(id_col, "id").distinct()


def nested_report(hits: DataFrame, id_col: str = "doc_id", top: int = REPORT_TOP) -> DataFrame:
    """T5 + D8 nesting: the top hits per method as ordered arrays of (id, similarity_score).

    Rows are capped at ``top`` per method before collecting, so a list never grows with the data.
    """
    top_rows = hits.where(F.col("rank") <= top)
    return top_rows.groupBy(id_col, "method").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "similarity_score"))),
                    lambda s: F.struct(s["id"].alias("id"), s["similarity_score"].alias("similarity_score")))
        .alias("duplicates"))


# ------------------------------------------------------------------------------- admission
def embed_rows(embed, batch: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, occurrence, embedding)`` for every row of a checkpointed ``with_occurrence`` batch."""
    rows = batch.withColumn("_row", F.monotonically_increasing_id())
    vectors = embed(rows.select(F.col("_row").alias(id_col), "content")).withColumnRenamed(id_col, "_row")
    return rows.select("_row", id_col, "occurrence").join(vectors, "_row").drop("_row")


def _similar_texts(texts: DataFrame, model: TfidfModel, emb: DataFrame | None, tfidf_threshold: float,
                   embedding_threshold: float) -> DataFrame:
    """Links (u, v) between different texts ``(text, content)`` of a batch."""
    vecs = keep(model.transform(texts, "text"))
    links = threshold_join(vecs, None, model.vocabulary, tfidf_threshold, "text").select("a", "b")
    if emb is not None:
        from doppel.operators.embeddings import embedding_threshold_join
        links = links.unionByName(embedding_threshold_join(emb, None, embedding_threshold, "text").select("a", "b"))
    return links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))


def greedy_admission(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """Lexicographically-first maximal independent set of a graph in the order of its nodes.

    nodes (node long), edges (x, y) with x before y -> (node, admitted BOOLEAN).
    """
    rows = nodes.select(F.col("node").alias("row"), F.lit(None).cast("long").alias("id_group"),
                        F.col("node").alias("text"), F.col("node").alias("seq"))
    links = edges.select(F.col("x").alias("u"), F.col("y").alias("v"))
    taken = (decide(rows, links) if small is None else decide(rows, links, small)).checkpoint()
    taken = taken.select(F.col("row").alias("node"), F.lit(True).alias("admitted"))
    return nodes.join(taken, "node", "left").select("node", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def admit(batch: DataFrame, model: TfidfModel | None, corpus_docs: DataFrame | None = None,
          corpus_emb: DataFrame | None = None, batch_emb: DataFrame | None = None,
          tfidf_threshold: float = 0.7, embedding_threshold: float = 0.8,
          id_col: str = "doc_id", order_col: str = "arrival", detail: bool = False,
          small: int | None = None) -> DataFrame:
    """C3 + C4: statuses for a batch (id, content, arrival) -> (id, status, occurrence).

    One row per row of the batch, as if rows were handled one after another by (arrival, id):
    ``exists`` if the id is in the corpus or an earlier row of the same id was accepted, else
    ``duplicate`` if a corpus document or an earlier accepted row duplicates the text, else
    ``accepted``.  ``occurrence`` numbers the rows of an id from 1.  The TF-IDF model stays frozen;
    nothing is refitted.  Embeddings of the batch go by id and, if they have that column,
    ``occurrence``; rows of one text share that of the first of them.

    ``detail`` adds the reference's text for a refusal: the id that is there already, or the ids (at
    most 50 by each method, and 50 of the batch) that the text duplicates.
    """
    if model is None:
        raise ValueError("No fitted vectorizer available")
    # every row is a node of its own; reliable checkpoints cut the lineage between phases, so that
    # the plan stays small and a lost executor does not replay the whole check
    rows = (with_occurrence(batch.select(id_col, "content", order_col), id_col, order_col)
            .withColumn("_text", F.sha2(F.col("content").cast("binary"), 256)))
    rows = numbered(rows, [order_col, id_col, "occurrence"], "_seq").checkpoint()
    known = rows.limit(0)
    if corpus_docs is not None:
        known = rows.join(corpus_docs.select(id_col), id_col, "left_semi")
        rows = rows.join(corpus_docs.select(id_col), id_col, "left_anti").checkpoint()

    # the first row of each text stands for it; its number names the text
    firsts = rows.groupBy("_text").agg(F.min("_seq").alias("text")).checkpoint()
    texts = rows.join(firsts.select(F.col("text").alias("_seq")), "_seq", "left_semi")
    texts = texts.select(F.col("_seq").alias("text"), "content", id_col, "occurrence").checkpoint()
    text_emb = None
    if batch_emb is not None:
        by = [c for c in (id_col, "occurrence") if c in batch_emb.columns]
        text_emb = keep(batch_emb.join(texts.select(*by, "text"), by).drop(*by))

    # Against the corpus (C1 for the whole batch at once).
    if corpus_docs is not None:
        emb = text_emb.withColumnRenamed("text", id_col) if text_emb is not None else None
        hits = duplicate_hits(texts.select(F.col("text").alias(id_col), "content"), corpus_docs, model, corpus_emb,
                              emb, tfidf_threshold, embedding_threshold, id_col=id_col, exclude_same_id=False)
        hits = hits.select(F.col(id_col).cast("long").alias("text"), F.col("id").cast("string").alias("hit")).checkpoint()
    else:
        hits = texts.sparkSession.createDataFrame([], "text long, hit string")
    open_texts = texts.join(hits.select("text").distinct(), "text", "left_anti")
    emb = text_emb.join(open_texts.select("text"), "text", "left_semi") if text_emb is not None else None
    links = _similar_texts(open_texts.select("text", "content"), model, emb, tfidf_threshold,
                           embedding_threshold).distinct().checkpoint()

    # rows of repeated ids are tied by their id, all others stand alone
    again = rows.groupBy(id_col).agg(F.min("_seq").alias("id_group"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tagged = (rows.select(id_col, "occurrence", "_seq", "_text").join(firsts, "_text")
                  .join(again.select(F.col(id_col).alias("_id"), "id_group"), F.col(id_col).eqNullSafe(F.col("_id")), "left")
                  .select(id_col, "occurrence", F.col("_seq").alias("row"), "id_group", "text",
                          F.col("_seq").alias("seq")).checkpoint())
    candidates = tagged.join(open_texts.select("text"), "text", "left_semi").select("row", "id_group", "text", "seq")
    taken = (decide(candidates, links) if small is None else decide(candidates, links, small)).checkpoint()

    placed = tagged.join(taken.withColumn("_in", F.lit(True)), "row", "left")
    by_id = (placed.where("_in and id_group is not null").select("id_group", F.col("seq").alias("_since"))).checkpoint()
    status = (F.when(F.col("_in"), "accepted").when(F.col("_since") < F.col("seq"), "exists").otherwise("duplicate"))
    judged = placed.join(by_id, "id_group", "left").withColumn("status", status)
    out = judged.select(id_col, "status", "occurrence", "text", "seq").checkpoint() if detail else judged
    there = known.select(id_col, F.lit("exists").alias("status"), "occurrence")
    if not detail:
        return out.select(id_col, "status", "occurrence").unionByName(there)
    return (_with_refusals(out, links, hits, id_col)
            .unionByName(there.withColumn("detail", _exists_text(id_col))))


def _exists_text(id_col: str):
    return F.concat(F.lit("Document "), F.col(id_col).cast("string"), F.lit(" already exists in the system"))


def _with_refusals(judged: DataFrame, links: DataFrame, hits: DataFrame, id_col: str) -> DataFrame:
    """``(id, status, occurrence, detail)``: what a refused row duplicates, in the corpus or accepted before it."""
    from pyspark.sql import Window
    accepted = judged.where("status = 'accepted'").select("text", F.col("seq").alias("_since"),
                                                          F.col(id_col).cast("string").alias("hit"))
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = ends.join(accepted.withColumnRenamed("text", "v"), "v").select(F.col("u").alias("text"), "_since", "hit")
    first = near.unionByName(accepted)
    refused = judged.where("status = 'duplicate'").select("text", "seq")
    own = (refused.join(first, "text").where("_since < seq")
                  .withColumn("_k", F.row_number().over(Window.partitionBy("seq").orderBy("_since")))
                  .where(F.col("_k") <= DUP_CAP).select("seq", "hit"))
    told = own.unionByName(refused.join(hits, "text").select("seq", "hit"))
    ids = told.groupBy("seq").agg(F.array_join(F.sort_array(F.collect_set("hit")), ", ").alias("_ids"))
    text = (F.when(F.col("status") == "exists", _exists_text(id_col))
             .when(F.col("status") == "duplicate", F.concat(F.lit("Document "), F.col(id_col).cast("string"),
                                                            F.lit(" has duplicates: "), F.col("_ids"))))
    return judged.join(ids, "seq", "left").select(id_col, "status", "occurrence", text.alias("detail"))


def upload_statuses(requests: DataFrame, model: TfidfModel | None, corpus_docs: DataFrame,
                    corpus_emb: DataFrame | None = None, embed=None, tfidf_threshold: float = 0.7,
                    embedding_threshold: float = 0.8, id_col: str = "doc_id", order_col: str = "arrival") -> DataFrame:
    """C4: ``(id, occurrence, status, detail)`` for requests (id, content, status, arrival) of ``read_incoming``.

    Requests that are ``ok`` are checked and admitted one after another; the others keep their status.
    """
    rest = requests.where("status <> 'ok'")
    told = (F.when(F.col("status") == "not_found", F.concat(F.lit("Document "), F.col(id_col).cast("string"),
                                                            F.lit(".txt not found in data/new_docs folder")))
             .when(F.col("status") == "exists", _exists_text(id_col)).otherwise(F.lit("not valid UTF-8")))
    rest = with_occurrence(rest, id_col, order_col).select(id_col, "occurrence", "status", told.alias("detail"))
    batch = with_occurrence(requests.where("status = 'ok'").select(id_col, "content", order_col), id_col, order_col)
    batch = batch.checkpoint()
    emb = embed_rows(embed, batch, id_col).checkpoint() if embed is not None and corpus_emb is not None else None
    done = admit(batch.drop("occurrence"), model, corpus_docs, corpus_emb if emb is not None else None, emb,
                 tfidf_threshold, embedding_threshold, id_col, order_col, detail=True)
    return done.select(id_col, "occurrence", "status", "detail").unionByName(rest)
