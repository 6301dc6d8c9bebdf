"""Benchmark the headline operators; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every timed step runs to completion through the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from doppel import get_session  # noqa: E402
from doppel.operators import clusters as cl  # noqa: E402
from doppel.operators.dedup import duplicate_hits  # noqa: E402
from doppel.operators.embeddings import hash_embeddings, similar_embedding_pairs  # noqa: E402
from doppel.operators.search import similar_documents_tfidf  # noqa: E402
from doppel.operators.simjoin import similar_pairs  # noqa: E402
from doppel.operators.tfidf import fit_tfidf  # noqa: E402
from doppel.plans.catalog import split  # noqa: E402
from doppel.sources.corpus import load_documents  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def materialise(df):
    df = df.persist()
    df.count()
    return df


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("doppel-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
        return out

    docs = load_documents(spark, sf_dir)
    model = timed("tfidf_fit", lambda: fit_tfidf(docs))
    timed("similar_pairs_tfidf", lambda: run(similar_pairs(model.vectors, model.vocabulary, 0.7,
                                                           n_docs=model.n_docs)))
    timed("topk_tfidf", lambda: run(similar_documents_tfidf(model.vectors, model.vocabulary, 0.7, 10,
                                                            n_docs=model.n_docs)))
    clusters = timed("kmeans", lambda: materialise(cl.kmeans_clusters(model.vectors, model.vocab_size,
                                                                      model.n_docs)))
    timed("similar_pairs_tfidf_clustered",
          lambda: run(similar_pairs(model.vectors, model.vocabulary, 0.7, clusters=clusters,
                                    n_docs=model.n_docs)))
    emb_table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    timed("similar_pairs_embedding", lambda: run(similar_embedding_pairs(emb_table, 0.2)))
    timed("hash_embeddings", lambda: materialise(hash_embeddings(docs)))
    # the incoming documents (a tenth of the table) against the base corpus with its own model
    base, base_model, new = split(spark, sf_dir)
    base_emb = materialise(hash_embeddings(base))
    timed("duplicate_check", lambda: run(duplicate_hits(new, base, base_model, base_emb, hash_embeddings(new))))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "dedup_suite_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
