"""Packing by power-of-two decomposition: no sequence crosses documents."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 4096
EOS = 2
#: Entries of a worker's caches of unusual words and of parts; past it a cache starts anew.
CACHE = (250_000, 250_000)
_JOIN = 256
# How the tokenizer cuts lower-cased text, for ASCII and the Latin-1 letters that it
# lower-cases one to one: contractions, runs of letters, single digits, runs of other signs.
_PART = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+")
# any other character, or what may begin a special token
_UNUSUAL = re.compile("[^ -~\t-\rÀ-ÖØ-öø-ÿ]|<\\|")
_SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(f"[{_SPACES}]")


def parts_of(text: str) -> list[str]:
    """The parts that the tokenizer cuts a text without unusual characters into."""
    return _PART.findall(text.lower())


class WordEncoder:
    """Ids of whole texts from a tokenizer file, part by part.

    The tokenizer lower-cases a text and cuts it into runs of letters, single digits and runs of
    other signs; it drops white space and encodes every such part on its own.  Texts of ASCII and
    plain Latin-1 letters are cut here, and each part's ids are remembered: a text's ids are those of
    its parts one after another.  A word (up to white space) with any other character goes to the
    tokenizer as it is.  Ids are held as little-endian uint32.
    """

    def __init__(self, path: str, cache: tuple[int, int] = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        # the same model for parts, which are normalised and cut already
        self.light = Tokenizer(self.tok.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most_words, self.most_parts = cache
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _learn_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Encode many parts at once; each ends at its one token that closes a word."""
        learnt = {}
        for at in range(0, len(parts), _JOIN):
            some = parts[at:at + _JOIN]
            ids = np.array(self.light.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer's words do not end in one closing token each")
            for p, s, e in zip(some, [0, *cuts], cuts):
                learnt[p] = ids[s:e].tobytes()
        if len(self.parts) + len(learnt) > self.most_parts:
            self.parts.clear()
        self.parts.update(learnt)
        return learnt

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            got = np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            self.words[word] = got
        return got

    def _cut(self, text: str) -> list[str | bytes]:
        """The parts of a text; the ids of a word that is not cut here."""
        found = _UNUSUAL.search(text)
        if not found:
            return parts_of(text)
        out, at = [], 0
        while found:
            start = max(text.rfind(c, at, found.start()) for c in _SPACES) + 1 or at
            end = _SPACE.search(text, found.end())
            end = end.start() if end else len(text)
            out += parts_of(text[at:start])
            out.append(self._word(text[start:end]))
            at = end
            found = _UNUSUAL.search(text, at)
        return out + parts_of(text[at:])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts; parts not yet known are learnt for all of them at once."""
        cut = [self._cut(x.decode("utf-8", "replace")) for x in texts]
        known = self.parts.get
        ids = [[known(p, p) for p in ps] for ps in cut]  # ids of unusual words stand for themselves
        late = [(xs, [k for k, x in enumerate(xs) if x.__class__ is str]) for xs in ids]
        missing = {xs[k] for xs, ks in late for k in ks}
        if missing:
            learnt = self._learn_parts(list(missing))
            for xs, ks in late:
                for k in ks:
                    xs[k] = learnt[xs[k]]
        return [b"".join(xs) for xs in ids]


def slices(texts, most: int = 1 << 21):
    """Lists of consecutive texts of some ``most`` bytes together (one longer text alone)."""
    some, size = [], 0
    for x in texts:
        if some and size + len(x) > most:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x)
    if some:
        yield some


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, cache: tuple[int, int] = CACHE) -> WordEncoder:
    """One encoder per worker process, file and cache size, so that its cache serves all tasks."""
    key = (path, *cache)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, cache)
    return _ENCODERS[key]


def piece_lengths(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """``n`` as full pieces of ``max_tokens`` and the binary digits of the rest, longest first."""
    full, rest = divmod(n, max_tokens)
    return [max_tokens] * full + [1 << b for b in range(max_tokens.bit_length(), -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         max_tokens: int = MAX_TOKENS, eos_id: int = EOS, keep_ids: bool = True,
         cache: tuple[int, int] = CACHE) -> DataFrame:
    """Cut each document's ids (with ``eos_id`` at the end) into pieces of power-of-two length.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset`` and,
    with ``keep_ids``, ``ids`` (array of int).  Each piece is a sequence of its own, so none
    crosses documents and none needs padding; ``bucket`` is log2 of its length, and batches are
    drawn from one bucket.  ``max_tokens`` must be a power of two.  Tokens are counted and cut in
    the task that reads the document: the operator does not shuffle.  ``sequence_id`` numbers the
    pieces of a task one after another, so it is unique.  ``cache`` bounds the words and parts a
    worker remembers: more of them cost memory (some 200 bytes each) and save tokenizer calls.

    A null or empty text is the one id ``eos_id``; a null id and repeated rows are packed like
    any row; an empty table gives an empty result; other columns are ignored.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    end = np.array([eos_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path, cache)
        for pdf in batches:
            ids, at = pdf["doc_id"], 0
            for some in slices(x or b"" for x in pdf["data"]):
                yield pieces(ids.iloc[at:at + len(some)], enc.encode(some))
                at += len(some)

    def pieces(doc_ids: pd.Series, encoded: list[bytes]) -> pd.DataFrame:
        cols = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for row, ids in enumerate(encoded):
            ids += end
            n, at = len(ids) // 4, 0
            for size in piece_lengths(n, max_tokens):
                part = ids[4 * at:4 * (at + size)]
                values = (row, at, size, zlib.crc32(part), n,
                          np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None)
                for name, value in zip(cols, values):
                    cols[name].append(value)
                at += size
        out = pd.DataFrame(cols)
        out.insert(0, "doc_id", doc_ids.iloc[cols["row"]].array)
        return out.drop(columns=["row"] if keep_ids else ["row", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    out = src.mapInPandas(run, schema + (", ids array<int>" if keep_ids else ""))
    return (out.withColumn("bucket", F.log2("length").cast("int"))
               .withColumn("sequence_id", F.monotonically_increasing_id())
               .withColumn("offset", F.lit(0).cast("long")))
