"""Main text of web pages: declared structure, checked against the repeats of a host's suffixes."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import prepare, scratch

#: Tokens of the shortest repeat that counts as boilerplate.
MIN_RUN = 6
#: ... if it is on this share of the host's distinct pages or more, and on so many at least.
MIN_SHARE = 0.05
MIN_PAGES = 2
#: ... inside declared content, which structure speaks for.
MIN_PAGES_DECLARED = 5
#: Near-equal pages are one page: bands of so many rows of a MinHash of the words agree.  With one
#: word in fifty changed (likeness 0.96) some band does in 98% of pairs, at 0.8 in 1%.
BANDS, ROWS = 12, 32
#: Keys or rows of a table that is sent to every task; a larger one is joined by shuffle.
SMALL = 200_000

# Element names and roles of HTML, words of class and id attributes.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
          "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_OFF = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select",
        "search", "fieldset"}
_OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
              "alertdialog", "menu", "menubar", "toolbar", "status"}
_OFF_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
              "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
              "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent",
              "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
              "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment",
              "comments", "commentlist", "respond", "replies", "disqus", "widget", "toolbar",
              "pagination", "pager", "copyright", "login"}
# words that stand beside one of these in a compound name without changing what it names
_BESIDE = {"site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "inner",
           "outer", "box", "bar", "block", "area", "section", "wrapper", "wrap", "container", "list", "item",
           "items", "links", "link", "button", "buttons", "icons", "posts", "articles", "slot", "unit", "body", "thread",
           "form", "author", "meta", "count", "reply"}
_PLAIN = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
_SPLITS_P = _BLOCK - {"html", "head", "body"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'/]|/(?!>))*+/>"  # self-closed: an empty element
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|object|math)(?=[\s/>])"
    r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
#: One attribute after another: a name and, after "=", its value.  Values are never searched for names.
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CUT = re.compile(r"[-_:]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


def _names_off(value: str) -> bool:
    """Whether a class or id names boilerplate: a whole token does, or all parts of a compound one go with it.

    ``ad``, ``site-nav`` and ``sidebar_2`` do; ``share-price``, ``related-work`` and ``ad-1x`` do not.
    """
    for token in value.lower().split():
        parts = [p for p in _CUT.split(token) if p and not p.isdigit()]
        if not _OFF_WORDS.isdisjoint(parts) and all(p in _OFF_WORDS or p in _BESIDE for p in parts):
            return True
    return False


def _attributes(attrs: str) -> tuple[bool, bool, bool]:
    """Boilerplate by role, class or id; main content by role; article by role or itemprop."""
    off = main = article = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if key in ("class", "id"):
            off = off or _names_off(value)
        elif key == "role":
            off, main, article = off or value in _OFF_ROLES, main or value == "main", article or value == "article"
        elif key == "itemprop":
            article = article or value == "articlebody"
        elif key == "hidden":
            off = True
        elif key == "aria-hidden":
            off = off or value == "true"
    return off, main, article


def _comment(attrs: str) -> bool:
    """Whether an article element is a reader's comment by its class or id."""
    return any(m[1].lower() in ("class", "id") and "comment" in (m[2] or m[3] or m[4] or "").lower()
               for m in _ATTR.finditer(attrs))


_NESTS = {n: re.compile(rf"<(/?){n}(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>", re.I)
          for n in ("svg", "math", "template", "object")}


def _raw_end(page: str, name: str, start: int, end: int) -> int:
    """Where a raw element that may hold others of its name ends: at the tag that closes it, else the last one."""
    depth, last = 0, end
    for m in _NESTS[name].finditer(page, start):
        if m[1]:
            depth, last = depth - 1, m.end()
            if not depth:
                return last
        elif not m[0].endswith("/>"):
            depth += 1
    return last


def blocks(page: str) -> list[tuple[str, str, str]]:
    """``(zone, part, text)`` of each block with text, in page order.

    ``zone`` is "off" inside a menu, header, footer, sidebar, notice, advert, form or comments,
    else "on"; an article's own header is a header too, so a title in it goes, one in the article
    itself stays.  ``part`` is "article", "main" or "" by the nearest declared main content.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, bool, str]] = []  # name, off, part
    text: list[str] = []
    off, part = False, ""

    def flush():
        if text:
            s = _SPACE.sub(" ", "".join(text)).strip()
            if s:
                out.append(("off" if off else "on", part, s))
            text.clear()

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if (raw := (m["raw"] or "").lower()) in _NESTS:
            at = _raw_end(page, raw, m.start(), at)
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m["end"]:
            if any(n == name for n, _, _ in stack):
                last = max(i for i, x in enumerate(stack) if x[0] == name)
                if any(x[0] in _BLOCK or x[1:] != (stack[last - 1][1:] if last else (False, ""))
                       for x in stack[last:]):
                    flush()
                del stack[last:]
                off, part = stack[-1][1:] if stack else (False, "")
            continue
        if name in _VOID:
            continue
        if name in _SPLITS_P:  # a block ends an open paragraph and what is open in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    off, part = stack[-1][1:] if stack else (False, "")
                    break
                if stack[i][0] in _BLOCK:
                    break
        attrs = m["attrs"]
        by_attr, main, article = _attributes(attrs) if attrs.strip() else (False, False, False)
        if name in _PLAIN:
            by_attr = by_attr and name == "article" and _comment(attrs)
        new_off = off or by_attr or name in _OFF
        new_part = "article" if name == "article" or article else part or ("main" if name == "main" or main else "")
        if (new_off, new_part) != (off, part):
            flush()
        off, part = new_off, new_part
        if not attrs.endswith("/"):
            stack.append((name, off, part))
        else:
            off, part = stack[-1][1:] if stack else (False, "")
    if at < len(page):
        text.append(html.unescape(page[at:]))
    flush()
    return out


def _content(found: list[tuple[str, str, str]]) -> list[str] | None:
    """The blocks of the declared main content: articles, else the main element; else None.

    Comments, teasers and the like in article elements (zone "off") declare nothing.
    """
    for part in ("article", "main"):
        if any(p == part and zone == "on" for zone, p, _ in found):
            return [s for zone, p, s in found if p == part and zone == "on"]
    return None


def declared(found: list[tuple[str, str, str]]) -> str | None:
    """The text of the declared main content, or None."""
    own = _content(found)
    return None if own is None else "\n".join(own)


def _runs(own: list[str], min_run: int) -> list[tuple[int, int]]:
    """From each block on the fewest whole blocks of ``min_run`` tokens or more: (first, end)."""
    sizes, out, end, held = [len(s.split()) for s in own], [], 0, 0
    for i, n in enumerate(sizes):
        while held < min_run and end < len(own):
            held, end = held + sizes[end], end + 1
        if held < min_run:
            break
        out.append((i, end))
        held -= n
    return out


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64)[:, None]


def _bands(host: str, tokens: list[str]) -> list[int]:
    """Band hashes of the page's words (repeats numbered); pages of a host that share one are near-equal."""
    if not tokens:
        return []
    seen: dict[str, int] = {}
    words = []
    for t in tokens:
        seen[t] = k = seen.get(t, 0) + 1
        words.append(xxhash.xxh64_intdigest(t, k))
    h = np.array(words, np.uint64)
    low = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[None, at:at + 2048] * _MUL + _ADD).min(1))
    return [xxhash.xxh64_intdigest(host.encode() + band.tobytes(), i) - (1 << 63)
            for i, band in enumerate(low.reshape(BANDS, ROWS))]


def _small(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, to be broadcast if it has few rows."""
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= SMALL else df


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_run: int = MIN_RUN, min_share: float = MIN_SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Blocks inside a declared article (else main element) are the page's text, without menus,
    headers, footers, sidebars, notices, adverts, forms and comments inside it, and without what
    its host repeats there.  A page that declares none is decided by its host's suffix array.  The token streams of the host's pages
    outside declared articles are concatenated, without matches across pages.  A substring of
    ``min_run`` tokens or more that repeats on distinct pages is a run of suffixes whose first
    ``min_run`` tokens agree, so suffixes are ordered by those alone: each is a row keyed by host
    and the hash of its first tokens, and a run's pages are counted map-side.  A run is boilerplate
    on ``min_share`` of the host's distinct pages, and on two at least.  A block goes if such runs
    cover it whole; any other block stays whole, with the ordinary phrases in it.  Near-equal pages
    (``_bands``) are one page, the first of them, so a copied page, edited or not, is no evidence
    against itself.  Declared content is judged by the suffixes that start at a block, up to the end
    of the block that makes them ``min_run`` tokens: whole blocks go that so repeat on ``min_share``
    of the host's distinct pages, and on ``MIN_PAGES_DECLARED`` at least.  Where nothing would be
    left, structure prevails and the content stays whole.

    Character references are decoded; white space inside a block is one space; blocks are trimmed
    and joined by a newline.  A null or empty page, and one without text, has an empty text; null
    urls are one host; null ids and repeated rows are rows like any; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches):
        for pdf in batches:
            cols = {c: [] for c in ("page_id", "url", "host", "declared", "blocks", "keys", "suffixes", "bands")}
            for page_id, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                found, host = blocks(page or ""), _host(url)
                content = _content(found)
                own = [s for zone, part, s in found if part != "article" and (content is None or part == "")]
                keep = [s if zone == "on" else None for zone, part, s in found
                        if part != "article" and (content is None or part == "")]
                tokens = " ".join(own).split()
                n = max(1, len(tokens) - min_run + 1) if tokens else 0
                keys = [xxhash.xxh64_intdigest(" ".join(tokens[i:i + min_run])) - (1 << 63) for i in range(n)]
                cols["page_id"].append(page_id)
                cols["url"].append(url)
                cols["host"].append(host)
                cols["declared"].append(content is not None)
                # of a page that declares nothing: its blocks, those of structure's boilerplate as counts
                cols["blocks"].append(content if content is not None else
                                      [s if k is not None else "\0" * len(s.split()) for s, k in zip(own, keep)])
                cols["keys"].append([xxhash.xxh64_intdigest("\n".join(content[i:j])) - (1 << 63)
                                     for i, j in _runs(content, min_run)] if content is not None else [])
                cols["suffixes"].append(keys)
                cols["bands"].append(_bands(host, " ".join(s for zone, _, s in found if zone == "on").split() or tokens))
            yield pd.DataFrame(cols | {"page_id": pd.Series(cols["page_id"], dtype=pdf["page_id"].dtype)})

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    path = scratch(spark, "pages")
    src.mapInPandas(read, f"page_id {kind}, url string, host string, declared boolean, "
                          "blocks array<string>, keys array<bigint>, suffixes array<bigint>, bands array<bigint>") \
       .withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    parsed = spark.read.parquet(path)
    # a page that shares a band with an earlier one is near-equal to it and not counted
    bands = parsed.select("row", F.explode("bands").alias("band"))
    firsts = bands.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = _small(bands.join(firsts, "band").where("first < row").select("row").distinct())
    single = parsed.where(F.size("bands") > 0).join(copies, "row", "left_anti")
    totals = _small(single.groupBy("host").agg(F.count("*").alias("pages")))
    runs = (single.select("host", F.explode(F.array_distinct("suffixes")).alias("key"))
                  .groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
                  .join(totals, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "key"))
    open_ = parsed.where("not declared")
    hits = (open_.select("row", "host", F.posexplode("suffixes").alias("at", "key"))
                 .join(runs, ["host", "key"]).groupBy("row").agg(F.collect_list("at").alias("ats")))

    def keep_unique(texts: pd.Series, ats: pd.Series) -> pd.Series:
        out = []
        for own, hit in zip(texts, ats):
            covered = set()
            for i in (hit if hit is not None else ()):
                covered.update(range(i, i + min_run))
            at, lines = 0, []
            for s in (own if own is not None else ()):
                end = at + (len(s) if s[:1] == "\0" else len(s.split()))
                if s[:1] != "\0" and not all(i in covered for i in range(at, end)):
                    lines.append(s)
                at = end
            out.append("\n".join(lines))
        return pd.Series(out)

    unique = F.pandas_udf(keep_unique, "string")
    left = (open_.join(hits, "row", "left")
                 .select("page_id", "url", unique("blocks", "ats").alias("text")))

    # a host has few such keys: (blocks of a page) / min_share at most
    bad = (single.where("declared").select("host", F.explode(F.array_distinct("keys")).alias("key"))
                 .groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES_DECLARED)
                 .join(totals, "host").where(F.col("n") >= F.col("pages") * min_share)
                 .select("host", "key").checkpoint())
    lists = bad.groupBy("host").agg(F.collect_list("key").alias("bad"))
    if bad.count() <= SMALL:
        lists = F.broadcast(lists)

    def drop_repeats(texts: pd.Series, keys: pd.Series, bad: pd.Series) -> pd.Series:
        out = []
        for own, key, gone in zip(texts, keys, bad):
            left, gone = list(own), set(gone if gone is not None else ())
            if not gone.isdisjoint(key):
                for k, (i, j) in zip(key, _runs(list(own), min_run)):
                    if k in gone:
                        left[i:j] = [None] * (j - i)
                left = [s for s in left if s is not None] or own
            out.append("\n".join(left))
        return pd.Series(out)

    judged = F.pandas_udf(drop_repeats, "string")
    out = (parsed.where("declared").join(lists, "host", "left")
                 .select("page_id", "url", judged("blocks", "keys", "bad").alias("text")).unionByName(left))
    return out.withColumn("n_chars", F.length("text").cast("long"))
