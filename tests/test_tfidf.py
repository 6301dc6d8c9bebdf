"""M1 / J11 against a plain numpy implementation of the same formulas."""
import math
import re
from collections import Counter

import numpy as np
import pytest

from doppel.operators.tfidf import fit_tfidf

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "cats and dogs", "the cat and the dog",
         "zebra", "mat log mat log", "a b c"]


def brute(texts, max_features=10000, min_df=2, max_df=0.8):
    toks = [re.findall(r"\b[a-zA-Z]{2,}\b", t) for t in texts]
    n = len(texts)
    df = Counter(t for ts in toks for t in set(ts))
    cf = Counter(t for ts in toks for t in ts)
    kept = [t for t in df if min_df <= df[t] <= max_df * n]
    kept = sorted(sorted(kept), key=lambda t: -cf[t])[:max_features]
    vocab = {t: i for i, t in enumerate(sorted(kept))}
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for ts in toks:
        c = Counter(t for t in ts if t in vocab)
        w = {vocab[t]: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({i: v / norm for i, v in w.items()} if norm else {})
    return vocab, out


def test_fit_matches_formulas(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, content string")
    m = fit_tfidf(docs, max_features=5)
    vocab, want = brute(TEXTS, max_features=5)
    got_vocab = {r["term"]: r["term_id"] for r in m.vocabulary.collect()}
    assert got_vocab == vocab
    got = {r["doc_id"]: dict(zip(r["term_ids"], r["weights"])) for r in m.vectors.collect()}
    assert set(got) == set(range(len(TEXTS)))  # zero vectors kept as empty rows
    for i, w in enumerate(want):
        assert set(got[i]) == set(w)
        for k in w:
            assert abs(got[i][k] - w[k]) < 1e-12
        norm = math.sqrt(sum(v * v for v in got[i].values()))
        assert norm == 0 or abs(norm - 1) < 1e-12


def test_transform_uses_frozen_vocabulary(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, content string")
    m = fit_tfidf(docs)
    new = spark.createDataFrame([(100, "the cat sat"), (101, "unknown words only")],
                                "doc_id long, content string")
    got = {r["doc_id"]: r["term_ids"] for r in m.transform(new).collect()}
    assert got[101] == []
    assert len(got[100]) > 0


def test_empty_vocabulary_raises(spark):
    import pytest
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc")], "doc_id long, content string")
    with pytest.raises(ValueError):
        fit_tfidf(docs)


def test_lookup_equals_join_and_does_not_shuffle(spark, small_model):
    from doppel.operators.tfidf import _weigh_by_join, term_bags
    docs, m = small_model
    found = m.transform(docs)
    joined = _weigh_by_join(term_bags(docs), m.vocabulary, "doc_id")
    a = {r["doc_id"]: r for r in found.collect()}
    b = {r["doc_id"]: r for r in joined.collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert r["term_ids"] == b[k]["term_ids"]
        assert r["weights"] == pytest.approx(b[k]["weights"], abs=1e-12)
    from doppel.sources.corpus import from_table
    plain = from_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Exchange" not in m.transform(plain)._jdf.queryExecution().executedPlan().toString()


def test_uncapped_vocabulary_is_numbered_in_ranges(spark):
    rows = [(i, f"alpha beta{chr(97 + i % 5)}x gamma{chr(97 + i % 3)}y common") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    whole = fit_tfidf(docs, max_features=None, min_df=1, max_df=1.0).vocabulary.collect()
    capped = fit_tfidf(docs, max_features=1000, min_df=1, max_df=1.0).vocabulary.collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in capped}
    cut = fit_tfidf(docs, max_features=3, min_df=1, max_df=1.0).vocabulary.orderBy("term").collect()
    assert [r["term"] for r in cut] == ["alpha", "common", "gammaay"]
