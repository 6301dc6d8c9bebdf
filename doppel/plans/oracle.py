"""DuckDB SQL that re-derives each registered query independently (the correctness oracle).

The shared CTE chain mirrors the reference's steps in plain SQL: normalise -> tokens -> tf ->
df/cf -> vocabulary -> weights.  It never calls into the Spark library.
"""

from __future__ import annotations

# Fixed values, written out here and not taken from the library that they check: Unicode white space,
# the characters that normalising keeps, and words of two letters or more.
_SPACE = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}")
WHITESPACE_RUN = f"[{_SPACE}]+"
NOT_WHITESPACE = f"[^{_SPACE}]"
DROPPED_CHARS = r"[^a-zA-Z0-9\s.,!?]"
TOKEN_PATTERN = r"\b[a-zA-Z]{2,}\b"


def _q(s: str) -> str:
    return s.replace("'", "''")


def normalise_sql(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({col}), '{_q(WHITESPACE_RUN)}', ' ', 'g'), "
            f"'{_q(DROPPED_CHARS)}', '', 'g'))")


def corpus_ctes(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                max_features: int = 10000, min_df: int = 2, max_df: float = 0.8) -> str:
    """CTEs: docs, n_docs, toks, tf, dfs, vocab, tfidf (long form, unit rows)."""
    return f"""
docs AS (
  SELECT {id_col} AS doc_id, {normalise_sql(text_col)} AS content
  FROM {table} WHERE regexp_matches({text_col}, '{_q(NOT_WHITESPACE)}')
),
n_docs AS (SELECT count(*) AS n FROM docs),
toks AS (SELECT doc_id, unnest(regexp_extract_all(content, '{_q(TOKEN_PATTERN)}')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
kept AS (
  SELECT dfs.* FROM dfs, n_docs WHERE df >= {min_df} AND df <= {max_df} * n
  ORDER BY cf DESC, term LIMIT {max_features}
),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df, cf,
         ln((1 + n) / (1 + df)) + 1 AS idf
  FROM kept, n_docs
),
raw_w AS (
  SELECT tf.doc_id, v.term_id, (1 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v USING (term)
),
tfidf AS (
  SELECT doc_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_w
)"""


def with_ctes(*parts: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip())


def hash_embedding_cte(name: str, tf_table: str, id_col: str, dim: int = 64) -> str:
    """Signed feature hashing of (id, term, tf) rows -> long form (id, dim, value), unit norm."""
    h = "(('0x' || substr(md5(term), 1, 8))::BIGINT)"
    return f"""
{name}_raw AS (
  SELECT {id_col} AS eid, CAST({h} % {dim} AS INTEGER) AS dim,
         (CASE WHEN ({h} // {dim}) % 2 = 0 THEN 1 ELSE -1 END) * tf AS v FROM {tf_table}
),
{name}_sum AS (SELECT eid, dim, sum(v) AS v FROM {name}_raw GROUP BY eid, dim),
{name} AS (
  SELECT eid, dim, v / sqrt(sum(v * v) OVER (PARTITION BY eid)) AS value FROM {name}_sum WHERE v <> 0
)"""


def idf_embedding_cte(name: str, vectors: str, id_col: str, dim: int = 384) -> str:
    """Signed feature hashing of (id, term_id, weight) rows -> long form (id, dim, value), unit norm."""
    h = "(('0x' || substr(md5(v.term), 1, 8))::BIGINT)"
    return f"""
{name}_sum AS (
  SELECT t.{id_col} AS eid, CAST({h} % {dim} AS INTEGER) AS dim,
         sum((CASE WHEN ({h} // {dim}) % 2 = 0 THEN 1 ELSE -1 END) * t.weight) AS v
  FROM {vectors} t JOIN vocab v USING (term_id) GROUP BY 1, 2
),
{name} AS (SELECT eid, dim, v / sqrt(sum(v * v) OVER (PARTITION BY eid)) AS value FROM {name}_sum)"""


def new_docs_ctes(table: str = "benchmark", id_col: str = "item_id", text_col: str = "text") -> str:
    """CTEs for incoming documents vectorised with the frozen corpus vocabulary: new_docs, new_tfidf."""
    return f"""
new_docs AS (
  SELECT {id_col} AS item_id, {normalise_sql(text_col)} AS content FROM {table}
),
new_tf AS (
  SELECT item_id, term, count(*) AS tf FROM (
    SELECT item_id, unnest(regexp_extract_all(content, '{_q(TOKEN_PATTERN)}')) AS term FROM new_docs)
  GROUP BY item_id, term
),
new_raw AS (
  SELECT t.item_id, v.term_id, (1 + ln(t.tf)) * v.idf AS w FROM new_tf t JOIN vocab v USING (term)
),
new_tfidf AS (
  SELECT item_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM new_raw
)"""


def pair_scores_cte(threshold: float, name: str = "pairs", same_cluster: bool = False) -> str:
    """Naive inverted-index self-join of the tfidf postings (every pair sharing a term)."""
    join_extra = "JOIN clusters ca ON ca.doc_id = a.doc_id JOIN clusters cb ON cb.doc_id = b.doc_id " \
                 "AND ca.cluster_id = cb.cluster_id" if same_cluster else ""
    return f"""
{name} AS (
  SELECT a.doc_id AS doc1, b.doc_id AS doc2, least(greatest(sum(a.weight * b.weight), 0.0), 1.0) AS similarity
  FROM tfidf a JOIN tfidf b ON a.term_id = b.term_id AND a.doc_id < b.doc_id {join_extra}
  GROUP BY a.doc_id, b.doc_id
  HAVING least(greatest(sum(a.weight * b.weight), 0.0), 1.0) >= {threshold}
)"""


CLUSTERS_CTE = """
k AS (SELECT greatest(10, least(50, CAST(floor(sqrt(n)) AS BIGINT))) AS k FROM n_docs),
clusters AS (SELECT doc_id, CAST(doc_id % k AS INTEGER) AS cluster_id FROM docs, k)
"""
