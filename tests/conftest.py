import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from doppel import get_session
    s = get_session("doppel-tests", master="local[4]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_model(spark):
    from doppel.operators.tfidf import fit_tfidf
    from doppel.sources.corpus import load_documents
    docs = load_documents(spark, SF_SMALL)
    return docs, fit_tfidf(docs)
