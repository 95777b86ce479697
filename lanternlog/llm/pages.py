"""Main text of web pages by nearest-URL page differencing and markup.

A page becomes text lines, one for each block element, with what the markup proves of each: inside the article, inside a
menu, header, advert or the like, or neither. The pages of a host stand in the order of their URL paths, each is paired with
the neighbour whose path agrees longest, and the lines of both that markup doesn't prove part of an article are aligned by
longest common subsequence; what both share is deleted. Pages with the same lines are one page there, and a neighbour that
has nearly all of a page's lines is a copy and tells nothing. What is left outside the article where there is one, or in
boilerplate elements where there is none, goes by its markup: menus and adverts that vary from page to page are never
shared, so differencing alone would keep them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table
from .sharding import number_rows
from .urls import host_and_path

# HTML elements by what they mean for the main text.
RAW_TEXT = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
).split()
BOILERPLATE = "nav aside footer form menu dialog button select svg canvas head template object audio video map".split()
BOILERPLATE_ROLE = "navigation banner contentinfo complementary search dialog alert menu menubar".split()
BOILERPLATE_NAME = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments commentlist respond disqus reply replies pagination pager widget toolbar skip teaser teasers"
).split()
#: First words of names that tell how a page is laid out, and of what: has-sidebar stands on what is beside the sidebar.
LAYOUT_NAME = "has no with without is not js hide show sticky fixed".split()
#: Words that may stand beside those in a name without giving it another meaning: share-buttons, but not share-price.
NEUTRAL_NAME = "area bar block body box button buttons container content form group holder icons inner item items left links list main outer panel posts right section slot stories articles text thread tools top bottom unit wrap wrapper".split()

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*+)(?:>|$)|<[!?/][^>]*(?:>|$)|[^<]+|<", re.S)
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
HIDDEN, UNSEEN = re.compile(r"(?i)(?:^|[\s/])hidden(?=[\s/]|$)"), re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+(?:[xX][0-9]+)?")
ATTR = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLOCK, _VOID, _RAW, _BOILER, _ROLE, _NAME, _NEUTRAL, _LAYOUT = map(frozenset, (BLOCK, VOID, RAW_TEXT, BOILERPLATE, BOILERPLATE_ROLE, BOILERPLATE_NAME, NEUTRAL_NAME, LAYOUT_NAME))
#: An unclosed one ends where the next of these begins.
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote td th aside nav footer header form".split())

CONTENT, OPEN, DROPPED = 2, 1, 0


def _names_boilerplate(name: str, in_article: bool) -> bool:
    """Whether a class or id says so: by its last word that isn't neutral or a number, which tells what a thing is. So
    `related-posts`, `site-footer`, `entry-comments`, `cookieConsent` and `ad-300x250` do; `related-work` and `share-price` don't, nor
    does `has-sidebar`. Inside an article a header is its own unless it is the site's or the page's."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in _LAYOUT:
        return False
    told = [w for w in words if w not in _NEUTRAL and not w[0].isdigit()]
    return bool(told) and told[-1] in _NAME and not (in_article and told[-1] == "header" and not {"site", "page", "global"} & set(told))


def _is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """By element, role or name, or because it isn't shown."""
    if tag in _BOILER or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "idden" in attrs.lower() and HIDDEN.search(VALUE.sub(" ", attrs)):
        return True
    for name, a, b, c in ATTR.findall(attrs):
        said = a or b or c
        if name.lower() == "role":
            if tag != "article" and any(one in _ROLE for one in said.lower().split()):
                return True
        elif name.lower() == "style":
            if UNSEEN.search(said):
                return True
        elif any(_names_boilerplate(one, in_article) for one in said.split()):
            return True
    return False


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, CONTENT, OPEN or DROPPED) of each block with text, in page order. Character references are decoded and white
    space (any that Unicode calls so, no-break spaces included) inside a block becomes one space. A quote in a tag begins a value
    only right after `=`. A page that ends early ends its open elements; a null page has no lines."""
    html = html or ""
    stack: list[tuple[str, int]] = []  # (element, what its text is)
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    state, at = OPEN, 0

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                lines.append((text, state))
            parts.clear()

    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(unescape(raw))
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                parts.append(" ")
            if any(t == tag for t, _ in stack):
                if tag in _BLOCK or state != _outer(stack, tag):
                    flush()
                while stack.pop()[0] != tag:
                    pass
                state = stack[-1][1] if stack else OPEN
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            close = re.compile(rf"(?i)</{tag}(?=[\s/>]|$)").search(html, at)
            at = close.start() if close else len(html)
            if close:
                at = html.find(">", close.start()) + 1 or len(html)
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES.get(tag, frozenset(("p",)))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES:
                    break
            state = stack[-1][1] if stack else OPEN
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID or m["attrs"].endswith("/") and tag not in _BLOCK:
            continue
        inside = state
        if state != DROPPED:
            if _is_boilerplate(tag, m["attrs"], state == CONTENT):
                inside = DROPPED
            elif tag in ("article", "main"):
                inside = CONTENT
        if inside != state:
            flush()
        stack.append((tag, inside))
        state = inside
    flush()
    return lines


def _outer(stack: list[tuple[str, int]], tag: str) -> int:
    """What text is after the innermost open element of a kind."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            return stack[k - 1][1] if k else OPEN
    return OPEN


def _ends(a: list[int], b: list[int]) -> int:
    """Bits of b's places at which the common subsequence with all of a doesn't grow (bit-parallel, one row of bits in hand)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return v


def _lengths(v: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of b, from 0 to n places."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: Bits of the rows that common_lines keeps at once; beyond it the lines are halved first.
MOST_BITS = 1 << 26


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, by the bit-parallel method: a row of bits for each line of a.

    Where those rows would be too many bits, a is cut in half and b at the place where the halves' subsequences are longest
    together, so memory stays within MOST_BITS and time is at most doubled."""
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        before = _lengths(_ends(a[:half], b), len(b))
        after = _lengths(_ends(a[half:][::-1], b[::-1]), len(b))
        cut = int(np.argmax(before + after[::-1]))
        return common_lines(a[:half], b[:cut]) + [half + i for i in common_lines(a[half:], b[cut:])]
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def agreeing(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


#: Share of its lines' characters from which on a page is a copy of its neighbour, which then tells nothing of it.
COPY = 0.9


def shared_lines(pages: DataFrame) -> DataFrame:
    """(host, content, shared): for each page which of its lines its nearest page has too, by their number.

    pages: (host, path, content, hashes and sizes of the lines), a row for each host and content. Every page has a number in the
    order of host, path and content; numbers one apart are neighbours, so pairing is an equi-join whatever the size of a host. Of
    two neighbours the one whose path agrees longer is taken, unless it is a copy."""
    numbered, _ = number_rows(pages, ["host", "path", "content"], "at")
    numbered = settle(numbered)
    side = lambda by, s: numbered.select((F.col("at") + by).alias("at"), *(F.col(c).alias(f"{c}_{s}") for c in ("host", "path", "hashes")))
    near = numbered.where(F.size("hashes") > 0).join(side(1, "before"), "at", "left").join(side(-1, "after"), "at", "left")

    @F.pandas_udf("array<int>")
    def shared(host: pd.Series, path: pd.Series, own: pd.Series, sizes: pd.Series, h1: pd.Series, p1: pd.Series, l1: pd.Series, h2: pd.Series, p2: pd.Series, l2: pd.Series) -> pd.Series:
        out = []
        for h, p, mine, size, ha, pa, la, hb, pb, lb in zip(host, path, own, sizes, h1, p1, l1, h2, p2, l2, strict=True):
            best: list[int] = []
            near = [(agreeing(p, q), -k, other) for k, (g, q, other) in enumerate(((ha, pa, la), (hb, pb, lb))) if other is not None and g == h]
            for _, _, other in sorted(near, key=lambda x: x[:2], reverse=True):
                places = common_lines(list(mine), list(other))
                if sum(size[i] for i in places) < COPY * sum(size):
                    best = places
                    break
            out.append(best)
        return pd.Series(out, dtype=object)

    cols = ["host", "path", "hashes", "sizes", "host_before", "path_before", "hashes_before", "host_after", "path_after", "hashes_after"]
    return near.select("host", "content", shared(*cols).alias("shared")).where(F.size("shared") > 0)


def _parsed(pages: DataFrame, html: str) -> DataFrame:
    """Adds `_lines`, an array of (text, state)."""

    @F.pandas_udf("array<struct<text string, state int>>")
    def lines(pages: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "state": s} for t, s in page_lines(x)] for x in pages], dtype=object)

    return pages.withColumn("_lines", lines(html))


#: Pages with shared lines up to which these are broadcast; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds `text`, the main text with two line feeds between blocks, and `n_shared`, how many lines outside of an article the
    differencing deleted, to every row; the html is dropped. Each page is parsed once.

    Lines inside an article or main element, but for boilerplate there, are the text as they are. Of the others, those that the
    nearest page shares are deleted; the rest is dropped if the page has an article, or if it stands in boilerplate elements.
    Null or empty html gives an empty text; a null URL has an empty host and path; pages of a host with the same such lines
    are one page, at their first path, so that none is compared with its own copy; repeated rows give repeated results; an empty
    table stays empty. Columns `text`, `n_shared`, `_lines`, `_host` and `_content` that the pages have are replaced."""
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    outside = F.filter("_lines", lambda x: x.state != CONTENT)
    hashes = F.transform(outside, lambda x: F.xxhash64(x.text))
    parsed = _parsed(pages.withColumns({"_host": host, "_path": path}), html).drop(html).withColumn("_content", F.xxhash64(hashes))
    parsed = settle(parsed)
    lines = parsed.where(F.size(outside) > 0).groupBy(F.col("_host").alias("host"), F.col("_content").alias("content"))
    sizes = F.transform(outside, lambda x: F.char_length(x.text))
    own = lines.agg(F.min("_path").alias("path"), F.any_value(F.struct(hashes.alias("hashes"), sizes.alias("sizes"))).alias("own")).select("host", "path", "content", "own.*")
    shared = settle(shared_lines(own).select(F.col("host").alias("_host"), F.col("content").alias("_content"), F.col("shared").alias("_shared")))
    joined = parsed.join(F.broadcast(shared) if shared.count() <= MOST_BROADCAST else shared, ["_host", "_content"], "left").withColumn("_shared", F.coalesce("_shared", F.array().cast("array<int>")))
    has_content = F.exists("_lines", lambda x: x.state == CONTENT)
    # Lines outside keep their number among themselves, by which differencing names them.
    left = F.filter(F.filter(outside, lambda x, i: ~F.array_contains("_shared", i)), lambda x: x.state == OPEN)
    kept = F.when(has_content, F.filter("_lines", lambda x: x.state == CONTENT)).otherwise(left)
    return joined.withColumns({"text": F.array_join(F.transform(kept, lambda x: x.text), "\n\n"), "n_shared": F.size("_shared").cast("long")}).drop("_lines", "_host", "_path", "_content", "_shared")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
