"""What the operators' own tests leave open, from plain definitions: signatures, code bits, pages, the pipeline."""
import struct
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from test_operators import ODD, SCHEMA, TOKENIZER, plain_components, plain_simhash, plain_targets, words
from tokenizers import Tokenizer

import corpus_pipeline
from doppel.llm import extract, langid, lines, minhash

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------- Order MinHash
def chained(values):
    """Spark's xxhash64 of several values: each one's XXH64 seeds the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_signature(text, bits=6):
    """Occurrence-numbered 3-mers by hash; a tuple takes the first two from its own range on, in text order."""
    w = [x.encode() for x in words(text)]
    kmers = [chained(w[i:i + 3]) >> 28 for i in range(len(w) - 2)] if len(w) > 2 else [chained(w) >> 28] if w else []
    seen, named = Counter(), []
    for pos, k in enumerate(kmers):
        named.append((signed(xxhash.xxh64_intdigest(struct.pack("<i", seen[k]), chained([k])) >> 28 << 28 | pos), pos))
        seen[k] += 1
    named.sort()
    out = []
    for t in range(-(1 << bits - 1), 1 << bits - 1):
        if not named:
            break
        at = sum(x < t << 64 - bits for x, _ in named)
        two = [named[(at + j) % len(named)] for j in range(min(2, len(named)))]
        two = [(x & (1 << 64) - 1) >> 28 for x, _ in sorted(two, key=lambda p: p[1])]
        out.append((t & (1 << bits) - 1) << 16 | chained(two) >> 48)
    return out


def test_signatures_and_likenesses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(1000 + i, r[1]) for i, r in enumerate(ODD)], "doc_id long, text string")
    for r in minhash.edit_fingerprints(docs.unionByName(odd)).join(docs.unionByName(odd), "doc_id").collect():
        a, b = plain_signature(r["text"]), plain_signature(r["edited_text"])
        assert r["signature"] == a and r["edited_signature"] == b
        either = len({x >> 16 for x in a + b})
        assert r["near_edited"] == pytest.approx(len(set(a) & set(b)) / either if either else 1.0)


# --------------------------------------------------------------------------------- language ID
def plain_grams(text):
    out = []
    for ch in text.lower():
        ch = ch if unicodedata.category(ch)[0] in "LM" else " "
        if ch != " " or out[-1:] != [" "]:
            out.append(ch)
    g, p, full = 0x9E3779B97F4A7C15, 0x100000001B3, (1 << 64) - 1
    c, counts = [ord(ch) for ch in out], np.zeros(langid.BUCKETS)
    for i in range(len(c)):
        counts[(c[i] * g & full) >> 51] += 1
        if i > 0:
            counts[((c[i - 1] * p + c[i] + (1 << 40)) * g & full) >> 51] += 1
        if i > 1:
            counts[(((c[i - 2] * p + c[i - 1]) * p + c[i] + (1 << 50)) * g & full) >> 51] += 1
    v = np.sqrt(counts)
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("size", [3, 7, 1 << 20])
def test_grams_do_not_depend_on_slices(monkeypatch, size):
    monkeypatch.setattr(langid, "_SLICE", size)
    for text in ("The cat, 12 dogs!!  and\n\n a mouse", "é日本 x", "   a", "a1b2c3d4", "straße " * 9, "ab"):
        assert np.allclose(langid.grams(text), plain_grams(text), atol=1e-6)
    assert langid.grams("12 .. \n 34 !! 5678") is None


def plain_language(model, text):
    """(language, share, lead): each bit's margin, the loss to each codeword by trust, the least one."""
    if not text or not any(unicodedata.category(ch)[0] == "L" for ch in text.lower()):
        return "und", 0.0, 1.0
    v, loss = plain_grams(text), []
    z = [float(v @ model.weights[:, b].astype(float)) + float(model.bias[b]) for b in range(model.code.shape[1])]
    for i in range(len(model.langs)):
        loss.append(len(z) * sum(model.trust[i, b] * np.log1p(np.exp(-model.code[i, b] * z[b])) for b in range(len(z))))
    share = np.exp(-np.array(loss))
    share /= share.sum()
    best = np.sort(share)
    return model.langs[int(np.argmin(loss))], best[-1], best[-1] - best[-2]


def test_language_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    code = np.array(model.code)
    n = len(model.langs)
    assert code.shape == (n, 2 ** (n - 1) - 1) and len({tuple(b) for b in code.T} | {tuple(-b) for b in code.T}) == 2 * code.shape[1]
    assert all(abs(b.sum()) < n for b in code.T) and np.allclose(model.trust.sum(1), 1)
    odd = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(
        [None, "", "12 34", "der und the and", "x", "日本語"])], "doc_id long, text string, lang string")
    for r in langid.identify(docs.unionByName(odd), model).collect():
        lang, share, lead = plain_language(model, r["text"])
        assert r["lang_pred"] == lang or lead < 1e-3
        assert r["score"] == pytest.approx(share, abs=1e-3)
        assert r["lang_ambiguous"] == (lead < langid.MIN_LEAD) or abs(lead - langid.MIN_LEAD) < 1e-3


# ------------------------------------------------------------------------------------- extract
class Article(HTMLParser):
    """The article of a page as the given pages are written, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now = 0, [], []

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag == "br":
            self.now.append(" ")
        elif tag in ("article", "h1", "p"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.cut()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = Counter()
    for r in pages.collect():
        p = Article()
        p.feed(r["html"] or "")
        p.close()
        text = "\n".join(p.out)
        want[r["page_id"], r["url"], text, len(text)] += 1
    assert Counter(tuple(r) for r in extract.extract(pages).select("page_id", "url", "text", "n_chars").collect()) == want


# ------------------------------------------------------------------------------------ pipeline
def plain_lines(rows):
    pages, has = {}, Counter()
    for r in rows:
        if r["text"] is not None:
            pages.setdefault(r["source"], set()).add(r["text"])
    for s, texts in pages.items():
        for t in texts:
            has.update((s, k) for k in {x.strip(" ") for x in t.split("\n")} - {""})
    bad = {k for k, n in has.items() if n >= lines.MIN_PAGES and n > len(pages[k[0]]) * lines.MAX_RATIO}
    for r in rows:
        own = [] if r["text"] is None else r["text"].split("\n")
        left = [x for x in own if (r["source"], x.strip(" ")) not in bad]
        if len(left) == len(own) or "\n".join(left).strip(" "):
            yield r["doc_id"], r["text"] if len(left) == len(own) else "\n".join(left)


def test_pipeline_by_values(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    seen, docs = [given.collect()], given
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    given, known, cleaned, single, mixed, packed = seen
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out("doc_id")))
    want = {r["doc_id"] for r in given if (p := plain_language(model, r["text"]))[0] != "und" and p[2] >= langid.MIN_LEAD}
    assert {r["doc_id"] for r in known} == want and len(known) == len(want)
    assert Counter((r["doc_id"], r["text"]) for r in cleaned) == Counter(plain_lines(known))
    groups = plain_components([(r["doc_id"], plain_simhash(r["text"])) for r in cleaned])
    assert sorted(r["doc_id"] for r in single) == sorted({low for _, _, low in groups})
    assert {(r["doc_id"], r["text"]) for r in single} <= {(r["doc_id"], r["text"]) for r in cleaned}
    text, sizes, taken, own = {r["doc_id"]: r["text"] for r in single}, Counter(), Counter(), Counter()
    for r in single:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(words(r["text"]))
        own[r["doc_id"]] += len(words(r["text"]))
    assert all(abs(taken[s] - t) <= 1 for s, t in plain_targets(sizes).items())
    assert all(n <= 2 * len(words(text[i])) for i, n in own.items())
    tok, ids = Tokenizer.from_file(TOKENIZER), Counter()
    for r in mixed:
        ids.update((r["doc_id"], x) for x in tok.encode(r["text"], add_special_tokens=False).ids + [2])
    assert Counter((r["doc_id"], x) for r in packed for x in r["ids"]) == ids
    again = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in again) == \
        Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in packed)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_long_texts(spark):
    rows = [(1, "alpha beta gamma " * 30_000), (2, "x" * 300_000), (3, None), (None, "")]
    df = spark.createDataFrame([(*r, "a", "en", 0, 0, "k") for r in rows], SCHEMA)
    for r in minhash.edit_fingerprints(df).where("doc_id = 2").collect():
        assert r["signature"] == plain_signature(rows[1][1]) and r["n_chars"] == 300_000
    pages = spark.createDataFrame([(1, "http://h/", "<article>" + "<p>one two three</p>" * 40_000 + "</article>"),
                                   (2, "http://h/", "<article>" + "word " * 200_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["n_chars"] for r in extract.extract(pages).collect()}
    assert got == {1: 40_000 * 14 - 1, 2: 999_999}
