"""op12_jaccard: sets that share most of their lists without linking are not formed as a pair in each of them."""
from doppel.llm import jaccard


def test_pair_is_formed_once_in_a_run_of_shared_shingles(spark, monkeypatch):
    words = [f"w{i}" for i in range(1500)]
    texts = [words[:150 * k] + [f"own{k}x{i}" for i in range(150)] + words[150 * k + 150:] for k in range(9)]
    texts.append(texts[0][:-10])  # links to the first one
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    formed, linked = [], jaccard._linked

    def counted(pairs, named, percent):
        formed.append((pairs.count(), pairs.distinct().count()))
        return linked(pairs, named, percent)

    monkeypatch.setattr(jaccard, "_linked", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {**{k: k for k in range(9)}, 9: 0}
    rows, pairs = formed[1]
    assert pairs >= 9 * 8 // 2 and rows <= 40 * pairs
