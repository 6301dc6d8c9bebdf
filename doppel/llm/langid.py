"""Language identification with error-correcting output codes over character n-grams."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doppel.llm.common import own_names, prepare

#: Buckets of hashed character 1- to 3-grams.
BUCKETS = 1 << 13
#: Rows the classifiers are fitted on, all languages together, by seeded hash order.
FIT_ROWS = 2400
#: Least lead of the best language's share over the second's; below, the row is ambiguous.
MIN_LEAD = 0.05
UNDETERMINED = "und"
_SLICE = 1 << 20


def grams(text: str) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts of a whole text; None if it has no letter.

    Runs of characters that are not letters count as one space, so digits, punctuation and markup
    are not evidence.  Memory is bounded by a slice, however long the text is.
    """
    counts = np.zeros(BUCKETS, np.int64)
    tail = np.zeros(0, np.uint32)
    some = False
    for at in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[at:at + _SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
        kind = _kinds(codes)
        some = some or bool((kind == 2).any())
        codes = np.where(kind > 0, codes, np.uint32(32))
        codes = np.concatenate((tail, codes))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        k = len(tail)
        c = codes.astype(np.uint64)
        one = c[k:] * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((one >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
        two = (c[:-1] * np.uint64(0x100000001B3) + c[1:] + np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((two[max(0, k - 1):] >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
        three = ((c[:-2] * np.uint64(0x100000001B3) + c[1:-1]) * np.uint64(0x100000001B3) + c[2:]
                 + np.uint64(1 << 50)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((three >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
        tail = codes[-2:]
    if not some:
        return None
    v = np.sqrt(counts.astype(np.float32))
    return v / np.linalg.norm(v)


_KINDS: np.ndarray | None = None


def _kinds(codes: np.ndarray) -> np.ndarray:
    """2 for a letter, 1 for a combining mark, 0 for anything else."""
    global _KINDS
    if _KINDS is None:
        _KINDS = np.array([" ML".find(unicodedata.category(chr(i))[0]) for i in range(0x110000)]).clip(0)
    return _KINDS[np.minimum(codes, 0x10FFFF)]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One codeword of +1 and -1 per language, far apart from each other.

    Up to five languages: the exhaustive code of 2^(n-1) - 1 bits.  More: as many random columns
    as 15 log2 n, best of some seeded draws by least distance.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or not (b + 1) >> (i - 1) & 1 else -1 for b in range(bits)]
                         for i in range(n)])
    rng, best, gap = np.random.default_rng(seed), None, -1
    width = int(np.ceil(15 * np.log2(n)))
    for _ in range(20):
        code = rng.choice([-1, 1], (n, width))
        code[:, abs(code.sum(0)) == n] *= rng.choice([-1, 1], (n, 1))
        d = (width - code @ code.T) / 2 + width * np.eye(n)
        if d.min() > gap:
            best, gap = code, d.min()
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray     # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray    # languages x bits: how well a bit does on a language, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword."""
        z = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -z[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(2)

    def shares(self, x: np.ndarray) -> np.ndarray:
        d = -self.losses(x) * self.code.shape[1]
        e = np.exp(d - d.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit one logistic classifier per code bit on at most ``fit_rows`` labelled rows.

    Every language gets an equal part of the bound; its rows are drawn by a hash of the id and the
    text.  Features are counted on the executors, over whole texts; the bounded sample's vectors
    are what reaches the driver.  A bit's classifier sees the languages weighted alike, and its
    trust for a language is its accuracy there.  Rows without label or letter are not used.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       F.xxhash64(F.lit(3), F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    rows = rows.where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones((0, 1)))
    each = max(1, fit_rows // len(counts))
    # hashes are uniform: some twice the rows wanted lie below a limit, and only those are ordered
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items()
                           for x in (lang, int(min(1.0, (2 * each + 50) / n) * (2 ** 64 - 2048)) - 2 ** 63)])
    rows = rows.where(F.col("h") <= F.element_at(limit, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h", F.length("text"))
    sample = (rows.select("lang", "text", F.row_number().over(first).alias("r"))
                  .where(F.col("r") <= each).select("lang", "text"))

    def count(batches):
        for pdf in batches:
            keep = [(lang, v) for lang, t in zip(pdf["lang"], pdf["text"])
                    if (v := grams(t)) is not None]
            yield pd.DataFrame({"lang": [k for k, _ in keep],
                                "at": [np.flatnonzero(v).astype(np.int32) for _, v in keep],
                                "v": [v[v > 0] for _, v in keep]})

    got = sample.mapInPandas(count, "lang string, at array<int>, v array<float>").toPandas()
    langs = sorted(set(got["lang"]))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["v"])):
        x[i, at] = v
    label = np.searchsorted(langs, got["lang"].to_numpy()) if langs else np.zeros(0, int)
    code = codewords(len(langs)).astype(np.float32)
    target = code[label]
    share = (1.0 / np.maximum(1, np.bincount(label, minlength=len(langs))))[label][:, None].astype(np.float32)
    share /= max(len(langs), 1)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):  # gradient descent with momentum on the logistic loss
        z = x @ w + b
        g = -target * share / (1 + np.exp(np.clip(target * z, -30, 30)))
        vw = 0.9 * vw + x.T @ g + 1e-5 * w
        vb = 0.9 * vb + g.sum(0)
        w -= 8.0 * vw
        b -= 8.0 * vb
    right = ((x @ w + b) * target > 0).astype(np.float64)
    trust = np.array([right[label == i].mean(0) for i in range(len(langs))]) + 1e-6
    return LanguageModel(langs, code, w, b, trust / trust.sum(1, keepdims=True))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text",
             min_lead: float = MIN_LEAD) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``lang_ambiguous``.

    Each bit's classifier votes with its margin; the language whose codeword has the least
    loss-weighted distance is predicted.  ``score`` is its share of the softmax over languages.
    A row is ambiguous if the share leads the next by less than ``min_lead``.

    A null text or one without letters is ``und`` with score 0, not ambiguous; with no language
    learnt every row is ``und``.  Null ids and repeated rows are rows like any; an empty table
    gives an empty result; columns of these three names are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits, whatever the input

    @F.pandas_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang = np.full(len(texts), UNDETERMINED, object)
        score, flag = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at in range(0, len(texts), 256):
            own = [(i, v) for i, t in enumerate(texts[at:at + 256], at)
                   if t and m.langs and (v := grams(t)) is not None]
            if not own:
                continue
            s = m.shares(np.stack([v for _, v in own]))
            top = s.argmax(1)
            second = np.sort(s, 1)[:, -2] if s.shape[1] > 1 else np.zeros(len(s))
            idx = [i for i, _ in own]
            lang[idx] = np.array(m.langs, object)[top]
            score[idx] = s.max(1)
            flag[idx] = s.max(1) - second < min_lead
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": flag})

    given = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_ambiguous")]
    found, = own_names(docs.columns, "found")
    out = docs.withColumn(found, predict(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in given], F.col(found)["lang"].alias("lang_pred"),
                      F.col(found)["score"].alias("score"), F.col(found)["ambiguous"].alias("lang_ambiguous"))


def held_out(doc_id: str):
    """Documents kept from fitting: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
