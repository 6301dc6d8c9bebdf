"""doppel: near-duplicate document detection on Apache Spark.

The library normalises a corpus, fits sparse TF-IDF vectors, builds embeddings,
blocks documents by cluster, runs exact threshold similarity joins and per-document
top-k searches, and admits new documents after an exact and a near-duplicate check.
Everything is expressed with DataFrame / SQL / Spark ML operations.
"""

from doppel.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
