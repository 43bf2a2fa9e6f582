r"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: the paths of its elements (tag and classes from the
root) and its text blocks (path and text). Over the pages of one host, tokens
with the same occurrence vector (how often they stand on each page) form an
equivalence class; Spark keeps the vector as the sum of a hash of (page, count),
so classes are found by grouping, however many pages a host has. A class is
valid when it has at least MIN_TOKENS tokens, stands on MIN_PAGES pages, and
holds an element (the markup of a layout, however rare) or stands on MIN_SHARE
of the host's pages. A class is nested in the valid class that holds its nearest
ancestor path; the nested valid classes are the host's template, and what lies
between template tokens are its slots.

Pages are counted by distinct contents: of pages whose article and main text has
the same min-hash of 3-word shingles (elsewhere: equal blocks) one counts, so
that copies don't look like a template. Text inside ``article`` or ``main`` is
template text only where such contents are half of the pages that hold it.

A page's text is what its slots hold, in page order: template text goes first,
wherever it stands; of the rest, the blocks inside ``article`` and ``main`` (else
the body) that are not in a menu, header, footer, sidebar, notice, advert, form,
script, style or reader comment (by tag, role, class or id). Inside ``article``
and ``main`` such words count only as a whole class of a block element: parts of
a class, ids and anything on a heading or inline element say nothing there.

Character references are decoded, white space (``br`` included) inside a block
becomes one space, blocks are trimmed and joined by one newline.

Null html: empty text. A null or unreadable url: a host of its own without a
template. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES = 3
MIN_SHARE = 0.5
MIN_TOKENS = 2
SHINGLE = 3

#: Fixed values of HTML: elements without an end, inline elements, raw text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
#: Elements, roles and class or id words that hold no main text.
_ASIDE = frozenset("nav footer aside form head script style noscript template iframe textarea title svg math object "
                   "canvas button select dialog menu input video audio".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar "
                   "form toolbar".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor "
                   "sponsored sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar "
                   "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup "
                   "comment comments commentlist disqus reply replies respond share sharing social related "
                   "recommended widget pagination pager toolbar skip login".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+)|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    path: str
    text: str
    region: int  # 2: in article, 1: in main, 0: elsewhere
    aside: bool


class _Open(NamedTuple):
    tag: str
    path: str
    region: int
    aside: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _opened(tag: str, raw: str, parent: _Open) -> _Open:
    names = ""
    aside = parent.aside or tag in _ASIDE or (tag == "header" and not parent.region)
    region = max(parent.region, 2 if tag == "article" else 1 if tag == "main" else 0)
    if raw and not raw.isspace():
        at = _attributes(raw)
        role = at.get("role", "").lower()
        if role == "main":
            region = max(region, 1)
        names = ".".join(sorted(_PART.findall(at.get("class", "").lower())))
        if tag in _HEADINGS or region and tag in _INLINE:
            words = set()
        elif region:
            words = set(at.get("class", "").lower().split())
        else:
            words = set(_PART.findall(f"{at.get('class', '')} {at.get('id', '')}".lower()))
        if tag not in ("html", "body"):
            aside = (aside or bool(words & _WORDS) or role in _ROLES or "hidden" in at
                     or "display:none" in at.get("style", "").replace(" ", "").lower())
    return _Open(tag, f"{parent.path}/{tag}" + (f".{names}" if names else ""), region, aside)


def blocks(html: str) -> tuple[list[Block], Counter]:
    """The text blocks of a page in order, and the paths of its elements."""
    out: list[Block] = []
    paths: Counter = Counter()
    stack = [_Open("", "", 0, False)]
    held: list[str] = []
    where = stack[0]

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(where.path, text, where.region, where.aside))
            held.clear()

    def close(at: int) -> None:
        del stack[at:]

    skip_to = None
    for m in _TOKEN.finditer(html):
        text = m[7]
        tag = (m[2] or m[5] or "").lower()
        ends = bool(m[1] or m[4])
        if skip_to:  # inside raw text only its end counts
            if ends and tag == skip_to:
                skip_to = None
            continue
        if text is not None or m[0] == "<":
            if not held:
                block = next(x for x in reversed(stack) if x.tag not in _INLINE)
                where = _Open(block.tag, block.path, stack[-1].region, stack[-1].aside)
            elif stack[-1].aside != where.aside:
                flush()
                where = stack[-1]
            held.append(unescape(text if text is not None else "<"))
            continue
        if not tag:
            continue
        if tag == "br":
            if held:
                held.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if ends:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # an inline end does not close the block around it
            if at and not (inline and any(x.tag not in _INLINE for x in stack[at + 1:])):
                close(at)
            continue
        if not inline:
            # a block starts: open paragraphs and, for a list entry, its predecessor end
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        opened = _opened(tag, m[3] or m[6] or "", stack[-1])
        paths[opened.path] += 1
        if tag in _RAW:
            skip_to = None if (m[3] or m[6] or "").rstrip().endswith("/") and tag in ("svg", "math") else tag
        elif tag not in _VOID:
            stack.append(opened)
    flush()
    return out, paths


def _hash(path: str, text: str | None = None) -> int:
    n = xxhash.xxh64_intdigest(path if text is None else f"{path}\0{text}", 17)
    return n - (1 << 64) if n >> 63 else n


def main_text(html: str, template: frozenset[int]) -> str:
    """The page's text given the host's template tokens."""
    found, _ = blocks(html)
    inner = any(b.region and not b.aside for b in found)
    slots = [b for b in found if _hash(b.path, b.text) not in template]
    return "\n".join(b.text for b in slots if not b.aside and (b.region or not inner))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(host != "", host)


def _content(found: list[Block]) -> int:
    """A number that copies of a page share, near copies mostly."""
    words = " ".join(b.text for b in found if b.region and not b.aside).split()
    if not words:
        return _hash("\n".join(f"{b.path}\0{b.text}" for b in found))
    return min(_hash(" ".join(words[i:i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1)))


_TOKENS = "array<struct<token:bigint,parent:bigint,is_text:boolean,inner:boolean,n:bigint>>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its content's number and its tokens (hash, that of the path
    above it, whether it is text, whether inside article or main, count)."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()),
                               ("inner", pa.bool_()), ("n", pa.int64())]))
    for batch in batches:
        contents, rows = [], []
        for html in batch.column(2):
            found, paths = blocks(html.as_py())
            contents.append(_content(found))
            row = [(_hash(p), _hash(p.rpartition("/")[0]), False, False, n) for p, n in paths.items()]
            texts = Counter((b.path, b.text, b.region > 0) for b in found)
            rows.append(row + [(_hash(p, t), _hash(p), True, inner, n) for (p, t, inner), n in texts.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(contents, pa.int64()), pa.array(rows, kind)],
            names=["host", "page", "content", "tokens"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its distinct texts' tokens."""
    for batch in batches:
        held = [sorted({_hash(b.path, b.text) for b in blocks(html.as_py())[0]}) for html in batch.column(2)]
        at = pa.array([i for i, x in enumerate(held) for _ in x], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array([t for x in held for t in x], pa.int64())],
            names=["host", "page", "token"])


def _sources(pages: DataFrame) -> DataFrame:
    """The pages that have a host: ``host, page, t``."""
    text = common.text_of("html")
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("url", text).alias("page"), text.alias("t"))
    return rows.filter("host is not null")


def templates(pages: DataFrame) -> DataFrame:
    """Per host the tokens of its valid classes: ``host, token, is_text, class,
    parent_class`` (the valid class of the nearest ancestor path)."""
    rows = _sources(pages).mapInArrow(_tokens, f"host string, page long, content long, tokens {_TOKENS}")
    contents = common.stored(rows.groupBy("host", "content").agg(
        F.min_by("tokens", F.struct("page", F.size("tokens"))).alias("tokens"), F.count("*").alias("copies")), "contents")
    count = contents.groupBy("host").agg(F.count("*").alias("pages"))
    tokens = contents.select("host", "content", "copies", F.inline("tokens"))
    vectors = tokens.groupBy("host", "token", "parent", "is_text", "inner").agg(
        F.sum(F.xxhash64("content", "n").cast("decimal(20,0)")).cast("string").alias("class"),
        F.count("*").alias("support"), F.sum("copies").alias("copies"))
    often = vectors.filter((F.col("support") >= MIN_PAGES) & (~F.col("inner") | (2 * F.col("support") >= F.col("copies"))))
    often = common.stored(often.join(count, "host"), "tokens")
    valid = often.groupBy("host", "class").agg(
        F.count("*").alias("size"), F.min("is_text").alias("bare"), F.min("support").alias("support"),
        F.min("pages").alias("pages"))
    valid = valid.filter((F.col("size") >= MIN_TOKENS) & (~F.col("bare") | (F.col("support") >= MIN_SHARE * F.col("pages"))))
    held = often.join(valid.select("host", "class"), ["host", "class"])
    above = held.filter("not is_text").select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    return held.join(above, ["host", "parent"], "left").select("host", "token", "is_text", "class", "parent_class")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page row: ``page_id, url, text, n_chars``."""
    common.prepare(pages.sparkSession)

    @F.arrow_udf("string")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, fixed in columns:
            yield pa.array([main_text(h.as_py(), frozenset(f.as_py() or ())) for h, f in zip(htmls, fixed)], pa.string())

    # a page gets the template texts that it holds itself, however many its host has
    # (stored, so that adaptive execution can split the joins for a host of very many pages)
    fixed = common.stored(templates(pages).filter("is_text").select("host", "token").distinct(), "fixed")
    held = _sources(pages).mapInArrow(_texts, "host string, page long, token long").join(fixed, ["host", "token"])
    held = common.stored(held.groupBy("page").agg(F.collect_set("token").alias("fixed")), "held")
    html = common.text_of("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.xxhash64("url", html).alias("page"))
    text = rows.join(held, "page", "left").select("page_id", "url", run(F.col("html"), F.col("fixed")).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
