"""Periodic runs, Jaccard components and whitening against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from doppel.llm import jaccard, queries, runs, whitening

SF = "/root/testdata/sf0.001"
TEXT_SCHEMA = "doc_id long, text string, runs string, n string, sid string, plant_words string, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ----------------------------------------------------------------------------- periodic runs (11)
def plain_runs(w, min_length=6, min_exponent=4):
    """Runs by comparing every word with the one a period later, for every period."""
    found = []
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_exponent * p) and not any(
                    all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                found.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def random_documents(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        n, k = rnd.choice([0, 1, 5, 6, 7, 20, 60, 150]), rnd.choice([1, 2, 3, 50])
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        if n > 10 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize("limits", [(6, 4), (5, 3), (9, 5)])
def test_runs_equal_plain_ones(limits):
    docs = list(random_documents(limits[0]))
    for w, got in zip(docs, runs.find_runs(docs, *limits)):
        assert [tuple(r) for r in got.tolist()] == plain_runs(w, *limits)


def test_lce_equals_word_by_word_comparison():
    rnd = random.Random(3)
    s = [9] + [rnd.randrange(2) for _ in range(250)] * 3 + [10]
    pairs = [(rnd.randrange(len(s)), rnd.randrange(len(s))) for _ in range(1500)]
    i, j = np.array([p for p in pairs if p[0] != p[1]]).T
    got = runs.Lce(np.array(s, np.int64))(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert n == k


def test_long_document_over_several_grid_chunks(monkeypatch):
    monkeypatch.setattr(runs, "_GRID", 1 << 10)
    rnd = random.Random(5)
    w = [b"%d" % rnd.randrange(40) for _ in range(3000)]
    w[500:2500] = (w[500:577] * 30)[:2000]
    assert [tuple(r) for r in runs.find_runs([w])[0].tolist()] == plain_runs(w)


def test_op11_equals_plain_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for i, t in texts.items():
        w, r = planted(i, t), got[i]
        found = plain_runs(w) if len(w) < 1500 else [tuple(x) for x in runs.find_runs([w])[0].tolist()]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best and r["n_runs"] == len(found)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in found))
        assert r["collapsed_sha256"] == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
        seen += len(found)
    assert seen > 5


def test_runs_of_odd_rows(spark):
    rows = [(1, "a " * 7, *"abcde"), (1, "a " * 7, *"abcde"), (2, None, *"abcde"), (3, "", *"abcde"),
            (None, "x y " * 5, *"abcde"), (4, " \t", *"abcde"), (5, "w " * 200_000, *"abcde")]
    df = spark.createDataFrame(rows, TEXT_SCHEMA)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"])
           for r in runs.periodic_runs(df).collect()]
    assert got == [(1, 7, [(0, 7, 1)], (0, 7, 1), "a")] * 2 + [(2, 0, [], None, ""), (3, 0, [], None, ""),
                   (None, 10, [(0, 10, 2)], (0, 10, 2), "x y"), (4, 0, [], None, ""),
                   (5, 200_000, [(0, 200_000, 1)], (0, 200_000, 1), "w")]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    # ids whose hash plants a run, a null id, and columns that are named like the helper's own
    rows = [(k, " ".join(f"w{j}" for j in range(k % 50)), *"abcde") for k in range(200)] + [(None, "x y", *"abcde")]
    out = runs.with_planted_runs(spark.createDataFrame(rows, TEXT_SCHEMA))
    assert out.columns == [c.split()[0] for c in TEXT_SCHEMA.split(", ")]
    for r, row in zip(out.collect(), rows):
        assert r["plant_words"] == "d" and words(r["text"]) == (planted(row[0], row[1]) if row[0] is not None else ["x", "y"])


# ---------------------------------------------------------------------------- Jaccard links (12)
def plain_sets(texts, k=3):
    out = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def plain_components(ids, sets, percent=90):
    lists, root = defaultdict(list), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, s in enumerate(sets):
        for y, m in Counter(y for h in s for y in lists[h]).items():
            if 100 * m >= percent * (len(s) + len(sets[y]) - m):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
        for h in s:
            lists[h].append(x)
    low = {}
    for x, i in enumerate(ids):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    return [low.get(find(x), None) if sets[x] else ids[x] for x in range(len(ids))]


def near_copies(seed, groups=8):
    """Chains of edits, scattered copies, subsets at the limit, a passage that many share."""
    rnd = random.Random(seed)
    new = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage, texts = new(40), []
    for g in range(groups):
        base = new(rnd.choice([3, 9, 11, 12, 13, 20, 21, 22, 60, 200, 700]))
        texts.append(base)
        for _ in range(rnd.randrange(1, 25)):
            w = list(rnd.choice(texts[-5:]) if rnd.random() < 0.5 else base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            texts.append(w[rnd.randrange(2):len(w) - rnd.randrange(2)] if len(w) > 5 else w)
        for _ in range(4):
            texts.append(new(rnd.randrange(30)) + passage + new(rnd.randrange(30)))
    rnd.shuffle(texts)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("frequent,pair_cost", [(64, 4), (2, 0), (2, 10**6)])
def test_jaccard_components_equal_plain_ones(spark, monkeypatch, frequent, pair_cost):
    """As it is, with single shingles only, and with pairs of shingles for all but the largest sets."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PAIR_COST", pair_cost)
    texts = near_copies(frequent + pair_cost)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    sets = plain_sets(texts)
    want = plain_components(list(range(len(texts))), sets)
    assert got == {x: (len(sets[x]), want[x]) for x in range(len(texts))}
    assert 5 < len(set(want)) < len(texts)


def test_jaccard_other_limits(spark):
    texts = near_copies(77, groups=4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (70, 100):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, percent=percent).collect()}
        assert [got[x] for x in range(len(texts))] == plain_components(list(range(len(texts))), plain_sets(texts), percent)


def test_jaccard_of_odd_rows(spark):
    base = " ".join(f"q{k}" for k in range(60))
    rows = [(5, base), (3, base.upper()), (3, base.upper()), (None, base), (7, None), (1, ""), (2, " \t"), (8, "one"),
            (9, "ONE"), (10, "one two"), (None, "alone with null id"), (None, None), (11, "z " * 100_000),
            (12, base + " éÉ")]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], TEXT_SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    sets = plain_sets([t for _, t in rows])
    want = plain_components([i for i, _ in rows], sets)
    assert got == sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, want)), key=str)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert jaccard.jaccard_components(df.where("text is null")).count() == 2


def test_op12_equals_plain_one_on_the_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = plain_sets([r["text"] for r in rows])
    want = plain_components([r["doc_id"] for r in rows], sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op12_jaccard(spark, SF).collect()}
    assert got == {r["doc_id"]: (len(s), c) for r, s, c in zip(rows, sets, want)}


# -------------------------------------------------------------------------------- whitening (13)
@pytest.mark.parametrize("low,high,shape", [(0, 1, (130, 5)), (-2000, 2000, (4097, 3)), (-2**38, 2**38, (70, 4)), (7, 8, (3, 2))])
def test_scatter_is_exact(low, high, shape):
    x = np.random.default_rng(1).integers(low, high, size=shape)
    sums, products = whitening.scatter(x)
    o = x.astype(object)
    assert sums == list(o.sum(axis=0)) and (products == o.T @ o).all()


def test_op13_equals_plain_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 1024).astype(int).astype(object) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    dev = dict(zip([r["vec_id"] for r in rows], (d * d).sum(axis=1).tolist()))
    cov = np.array([[v / n**3 for v in line] for line in (d.T @ d)], np.float64)
    e = np.linalg.eigvalsh(cov)[::-1]
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 8 * n and {r["deviation"] == dev[r["vec_id"]] and r["n"] == n for r in got} == {True}
    w = np.zeros((n, 8))
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9
    w -= w.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9 and got[0]["identity_error"] < 1e-9
    # projecting the covariance back gives the eigenvalues
    coef = np.linalg.lstsq((d / n).astype(float), w, rcond=None)[0]
    assert np.allclose(np.diag(coef.T @ cov @ coef), 1)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [[float(v) for v in rng.normal(size=3)] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(good)] + [(0, good[0]), (None, good[1]), (50, None), (51, []), (52, [1.0, None, 2.0]),
                                                   (53, [nan, 0.0, 1.0]), (54, [inf, 0.0, 1.0]), (55, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "w") for i, v in rows],
                               "vec_id long, embedding array<double>, n int, whitened double, v string")
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({k: 3 for k in range(1, 40)}) + Counter({0: 6, None: 3})
    assert {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {42}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 50")).count() == 1
    one = whitening.whiten(df.where("vec_id = 3")).first()
    assert (one["whitened"], one["explained"], one["identity_error"], one["deviation"]) == (None, None, None, 0)
    flat = df.where("vec_id < 30").withColumn("embedding", F.expr("array(get(embedding, 0), get(embedding, 0), 0.5D)"))
    got = whitening.whiten(flat).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and got[0]["identity_error"] < 1e-9
    big = df.where("vec_id < 5").withColumn("embedding", F.expr("transform(embedding, x -> x * 1e12D)"))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(big).collect()


# ------------------------------------------------- columns named like the operators' own ones
INNER = ["bad", "_host", "_lines", "_kept", "host", "lines", "kept", "size", "hash", "of", "own", "own_hash", "whole", "edge",
         "before", "rest", "held", "upto", "rep", "mix_source", "mix_whole", "mix_rest", "mix_range", "mix_part", "mix_hash",
         "mix_edge", "mix_before", "mix_upto", "mix_rep", "_fp", "_k", "_key", "_component", "fp", "key", "mark", "first",
         "component", "node", "low", "_p", "found", "data", "uid", "sid", "Bad", "doc"]


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents beside a column for each of the operators' inner names, with values that must come back."""
    cols = []
    for c in INNER:
        if c.lower() not in {x.lower() for x in cols}:
            cols.append(c)
    rows = [(k, f"Menu\nthe cat and the dog number {k} ran {'far ' * (k % 7)}", "en", "s" if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in cols]), cols


def test_columns_named_like_inner_ones_come_back(spark, crowded):
    from doppel.llm import langid, lines, mixing, simhash
    df, cols = crowded
    model = langid.fit(df)
    for out in (lines.drop_boilerplate_lines(df), mixing.mix(df), mixing.repeated(mixing.mix(df)),
                simhash.keep_one(df), langid.identify(df, model)):
        assert out.columns[:len(df.columns)] == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in cols)
    assert {r["n_dropped"] for r in lines.drop_boilerplate_lines(df).collect()} == {1}
    for op in (lambda d: simhash.simhash_components(d), jaccard.jaccard_components, runs.periodic_runs):
        assert op(df).count() == 60


def test_texts_are_not_shuffled(spark, crowded):
    """No exchange carries the text: boilerplate lists and the plan of a mix go to where it is read."""
    from doppel.llm import lines, mixing
    df, _ = crowded
    for out in (lines.drop_boilerplate_lines(df.select("doc_id", "text", "source")), mixing.mix(df.select("doc_id", "text", "source"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


# ----------------------------------------------------------------------- attributes of pages (7)
@pytest.mark.parametrize("tag", [
    '<div style="overflow:hidden">', '<div data-hidden="false">', '<p data-id="ad-1">', '<p title="what is hidden here">',
    '<div class="share-price">', '<div id="related-work">', '<div class="social-history">', "<p data-x='class=ad'>",
    '<div class="lead ad1x" data-role="navigation">', '<p aria-hidden=false>', '<div onclick="x = \'hidden\'">'])
def test_attributes_that_only_look_like_boilerplate_keep_their_text(tag):
    from doppel.llm import extract
    name = tag[1:].split()[0]
    assert extract.declared(extract.blocks(f"<article><p>First</p>{tag}Main text</{name}></article>")) == "First\nMain text"


@pytest.mark.parametrize("tag", [
    '<div class="ad">', '<div class="site-nav">', '<div id=sidebar_2>', "<div class='post comments'>", '<div hidden>',
    '<p aria-hidden="true">', '<div role="navigation">', '<div class="x  newsletter-box">', '<div HIDDEN="">'])
def test_attributes_that_name_boilerplate_take_it_out(tag):
    from doppel.llm import extract
    name = tag[1:].split()[0]
    assert extract.declared(extract.blocks(f"<article><p>First</p>{tag}Off</{name}><p>Last</p></article>")) == "First\nLast"


def test_nested_raw_elements_and_headers_of_articles():
    from doppel.llm import extract
    text = lambda inner: extract.declared(extract.blocks(f"<article><p>First</p>{inner}<p>Last</p></article>"))
    assert text("<svg><svg></svg><text>leak</text></svg>") == "First\nLast"
    assert text("<svg><svg/><text>leak</text></svg>") == "First\nLast"
    assert text("<template><template>a</template>b</template>") == "First\nLast"
    assert text("<svg><svg></svg><p>shown, as nothing closes the first</p>") == "First\nshown, as nothing closes the first\nLast"
    # a header is a header, an article's own too; a title outside of one stays
    assert text("<header><h1>Title</h1></header>") == "First\nLast" and text("<h1>Title</h1>") == "First\nTitle\nLast"
