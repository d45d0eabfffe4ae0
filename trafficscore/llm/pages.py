"""Main text of web pages by site template removal.

A page's html is read into a tree of elements (forgiving: unclosed and stray
tags, raw script and style text).  The hash of an element's subtree covers its
tag, its class and id, and everything in it.  Spark counts, per host, in how
many pages each subtree stands; a subtree found in at least ``MIN_PAGES`` pages
and ``MIN_SHARE`` of the host's pages belongs to the site's template and is
deleted.  Elements whose tag, class, id or role says that they aren't content
(``DROPPED_TAGS``, ``DROPPED_NAMES``) are deleted on every page, also on hosts
with too few pages to tell a template.

If the page has articles or main elements, all outermost ones are read, in page
order (its content).  A template may not delete these, nor what holds them.
Running text inside them (paragraphs, headings, list items, quotes, ...) goes
only if it recurs in at least ``MIN_PAGES`` different contents and in
``RUNNING_SHARE`` of the host's different contents, so an article that stands
under many addresses stays whole.  Without content elements, nothing is deleted
that holds more than half of the page's text.

Tags are found in one pass.  From a tag on that never ends by its quotes,
quotes no longer hide ">"; a "<" with no ">" after it is text.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one line feed in page order; empty
blocks vanish.

Null html gives empty text, null or odd urls count as one host "".  Repeated rows
count once for each repeat in page counts, once in all in counts of contents.
Other columns pass, whatever their names; a column named like the result is
replaced.  Empty table: empty result.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import cut, map_arrow, unused

MIN_PAGES = 5
MIN_SHARE = 0.2
RUNNING_SHARE = 0.5
RUNNING = 0x5BD1E995        # turns a subtree's key into its key as running text
BROADCAST_KEYS = 100_000      # template subtrees (8 bytes each) that are broadcast; above, a shuffle join

# Tags and names that mark what isn't main text.
DROPPED_TAGS = frozenset("nav header footer aside form script style noscript template iframe object embed svg canvas "
                         "button select input textarea label fieldset dialog menu head title audio video map".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
                          "navbar navigation menu menubar breadcrumb breadcrumbs header footer sidebar side-bar aside "
                          "widget comment comments respond replies disqus cookie cookies consent gdpr notice notices "
                          "newsletter subscribe signup share sharing social related recommended popup modal overlay "
                          "toolbar pagination pager masthead copyright".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
RAW_TAGS = frozenset("script style noscript textarea title template iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                       "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
                       "option p pre section summary table tbody td tfoot th thead title tr ul".split())
RUNNING_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody table figcaption caption ul ol dl "
                         "summary".split())
#: A start tag closes these open elements, up to the nearest of the bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("table ul ol dl select menu html body article main section div".split())

_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_TAG_REST = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+""")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'])([^\s=/"']++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Element:
    """A node of the tree; ``inside`` has text (str) and elements in order."""

    __slots__ = ("tag", "marks", "up", "inside", "key", "size", "away")

    def __init__(self, tag: str, marks: str, up: Element | None):
        self.tag, self.marks, self.up = tag, marks, up
        self.inside: list[str | Element] = []
        self.key = self.size = 0
        self.away = False

    def dropped(self) -> bool:
        if self.tag in DROPPED_TAGS or self.away:
            return True
        if self.tag in ("html", "body", "article", "main"):     # their class tells of the page, not of a part
            return False
        return self.named()

    def named(self) -> bool:
        """Whether class, id or role say that this isn't main text."""
        return bool(self.marks) and any(
            w in DROPPED_NAMES if a else w in DROPPED_ROLES
            for a, part in zip((True, False), self.marks.split("|"), strict=False) for w in _words(part))


def _words(marks: str) -> set[str]:
    own = set(marks.lower().replace("_", "-").split())
    return own | {w for x in own for w in x.split("-")}


def parse(page: str) -> Element:
    """The page's tree under a root element."""
    root = here = Element("#root", "", None)
    at, n, quotes = 0, len(page), True
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.inside.append(page[at:])
            break
        start, inner = m.span()
        if m[0] == "<!--":
            end = page.find("-->", inner)
            after = n if end < 0 else end + 3
        else:
            end = _TAG_REST.match(page, inner).end() if m[2] and quotes else page.find(">", inner)
            if m[2] and quotes and page[end:end + 1] != ">":
                quotes, end = False, page.find(">", inner)
            if end < 0:                                       # no tag ends from here on; a comment may still stand
                end = page.find("<!--", start)
                here.inside.append(page[at:n if end < 0 else end])
                break
            after = end + 1
        if start > at:
            here.inside.append(page[at:start])
        at = after
        if m[2] is None:
            continue
        rest = page[inner:end]
        tag = m[2].lower()
        if m[1]:                                              # end tag: close the nearest open one, if any
            up = here
            while up is not root and up.tag != tag:
                up = up.up
            if up is not root:
                here = up.up
            continue
        if tag in BLOCK_TAGS:                                 # a block ends an open paragraph
            up = here
            while up is not root and up.tag != "p" and up.tag not in BOUNDS:
                up = up.up
            if up.tag == "p":
                here = up.up
        if tag in CLOSES:
            up, last = here, None
            while up is not root and up.tag not in BOUNDS:
                if up.tag in CLOSES[tag]:
                    last = up
                up = up.up
            if last is not None:
                here = last.up
        marks = ""
        if "=" in rest:
            own = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)}
            names = f"{own.get('class', '')} {own.get('id', '')}".strip()
            marks = f"{names}|{own.get('role', '')}" if names or "role" in own else ""
        new = Element(tag, marks, here)
        here.inside.append(new)
        if tag in VOID_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:                                   # up to its own end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            new.inside.append(page[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        here = new
    return root


def elements(root: Element) -> list[Element]:
    """All elements, each before those inside it."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack += [x for x in reversed(e.inside) if isinstance(x, Element)]
    return out


def hash_subtrees(found: list[Element]) -> None:
    """``key`` and ``size`` (characters of text) of each, from the leaves up."""
    for e in reversed(found):
        parts, e.size = [f"<{e.tag} {e.marks}>"], 0
        for x in e.inside:
            if isinstance(x, Element):
                parts.append(str(x.key))
                e.size += x.size
            else:
                text = " ".join(x.split())
                parts.append(text)
                e.size += len(text) * (e.tag not in RAW_TAGS)
        e.key = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def read(page: str) -> list[Element]:
    """The page's elements, hashed.  Of its articles, those whose names say comment, advert, ... are away,
    unless all are named so."""
    found = elements(parse(page))
    hash_subtrees(found)
    articles = [e for e in found if e.tag == "article" and e.size]
    apart = [e for e in articles if e.named()]
    if len(apart) < len(articles):
        for e in apart:
            e.away = True
    return found


def content_roots(found: list[Element]) -> list[Element]:
    """The outermost articles and main elements that hold text, in page order."""
    roots, shut = [], set()                                   # shut: inside a root or a dropped element
    for e in found:
        if id(e.up) in shut or e.dropped():
            shut.add(id(e))
        elif e.tag in ("article", "main") and e.size:
            roots.append(e)
            shut.add(id(e))
    return roots


def above(e: Element) -> list[Element]:
    """The element and those around it."""
    out = []
    while e is not None:
        out.append(e)
        e = e.up
    return out


def recurring(found: list[Element], roots: list[Element]) -> tuple[list[Element], list[Element]]:
    """The elements that a template may delete: by their pages, and running text by its contents."""
    if not roots:
        return [e for e in found if e.up is not None and e.tag in BLOCK_TAGS and 2 * e.size <= found[0].size], []
    holds = {id(x) for r in roots for x in above(r)}
    inside = {id(x) for r in roots for x in elements(r)}
    free = [e for e in found if e.tag in BLOCK_TAGS and id(e) not in holds]
    running = [id(e) in inside and e.tag in RUNNING_TEXT for e in free]
    return ([e for e, r in zip(free, running, strict=True) if not r], [e for e, r in zip(free, running, strict=True) if r])


def text_of(page: str, template: frozenset) -> str:
    """Main text of a page whose host's template is the subtrees of these keys."""
    found = read(page)
    roots = content_roots(found)
    gone = set()
    if template:
        parts, running = recurring(found, roots)
        gone = {id(e) for e in parts if e.key in template} | {id(e) for e in running if e.key ^ RUNNING in template}
    starts = set(map(id, roots))
    blocks: list[list[str]] = [[]]
    stack: list[tuple[str, object]] = [("open", r) for r in reversed(roots or found[:1])]
    while stack:
        what, x = stack.pop()
        if what == "break":
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif id(x) in starts or not (x.dropped() or id(x) in gone):
            if x.tag in ("br", "wbr"):
                blocks[-1].append(" " * (x.tag == "br"))
                continue
            block = x.tag in BLOCK_TAGS
            if block:
                blocks.append([])
                stack.append(("break", None))
            stack += [("open", y) for y in reversed(x.inside)]
    lines = (" ".join(references.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(df: DataFrame, url_col: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(df: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              running_share: float = RUNNING_SHARE) -> DataFrame:
    """(host, template: array<long>) of ``df`` (host, html): the subtrees that recur across pages of a host,
    and, by keys of their own, the running text that recurs across its different contents."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, running, contents = [], [], []
        for page in batch.column(1).to_pylist():
            found = read(page or "")
            roots = content_roots(found)
            a, b = recurring(found, roots)
            own.append(np.unique(np.array([e.key for e in a if e.inside], dtype=np.int64)))
            running.append(np.unique(np.array([e.key ^ RUNNING for e in b if e.inside], dtype=np.int64)))
            told = ",".join(str(e.key) for e in roots)
            contents.append(xxhash.xxh64_intdigest(told.encode()) - (1 << 63) if roots else None)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own, lists), pa.array(running, lists), pa.array(contents, pa.int64())],
            names=["host", "keys", "running", "content"])

    held = cut(map_arrow(df.select("host", "html"), keys, "host string, keys array<long>, running array<long>, content long"))

    def often(rows: DataFrame, of: DataFrame, share: float) -> DataFrame:
        """Keys of ``rows`` that stand in this share of their host's rows of ``of``."""
        all_of = of.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
        counts = rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
        return counts.join(all_of, "host").where(F.col("n") >= share * F.col("pages")).select("host", "key")

    different = held.where("content is not null")
    by_page = often(held.select("host", F.explode("keys").alias("key")), held, min_share)
    by_content = often(different.select("host", "content", F.explode("running").alias("key")).distinct(),
                       different.select("host", "content").distinct(), running_share)
    # a key of these shares is on every fifth page: a host has a few times as many as a page has subtrees
    return by_page.unionByName(by_content).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("template"))


def extract(df: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", **limits) -> DataFrame:
    """All columns of ``df`` but the html, and ``out``: the main text."""
    kept = [f for f in df.schema.fields if f.name not in (html_col, out)]
    names = [f.name for f in kept]
    html, host, template = (unused(df, x) for x in ("_html", "_host", "_template"))
    rows = df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{html_col}`").alias(html),
                     host_of(df, url_col).alias(host))
    found = cut(templates(rows.select(F.col(host).alias("host"), F.col(html).alias("html")), **limits))
    size = found.agg(F.coalesce(F.sum(F.size("template") + F.lit(4)), F.lit(0))).first()[0]
    found = found.withColumnRenamed("host", host).withColumnRenamed("template", template)
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_KEYS else found, host, "left").drop(host)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[bytes, frozenset] = {}
        texts = []
        for page, own in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1), strict=True):
            key = own.values.to_numpy().tobytes() if own.is_valid else b""
            if key not in sets:
                sets[key] = frozenset(np.frombuffer(key, dtype=np.int64).tolist())
            texts.append(text_of(page or "", sets[key]))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(texts, pa.string())], names=[*names, out])

    return map_arrow(rows.select(*(F.col(f"`{n}`") for n in names), html, template), run, schema)


def main_texts(df: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and its code points."""
    return (extract(df.select("page_id", "url", "html"))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))
