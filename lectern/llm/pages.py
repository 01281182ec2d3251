"""Main text of web pages by paths that the pages of a host agree on.

Each page scores its containers and votes for the generalised path (tags with classes, digits masked) of its best one.
The votes are counted per host in Spark, and every page is read again with the path that won on its host; a page that has
no such container falls back to its own best.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, written

#: Hosts whose winning paths may be sent to every executor (some 100 bytes each); beyond it the pages are shuffled by host.
BROADCAST_HOSTS = 100_000

_WORDS = lambda text: frozenset(text.split())
_INLINE = _WORDS("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr")
_VOID = _WORDS("area base br col embed frame hr img input link meta param source track wbr")
#: Elements that never hold main text, and words of classes, ids and roles that say so. Fixed values.
_DROP_TAGS = _WORDS("head title nav header footer aside form button select textarea input menu dialog canvas audio video map")
_REPLY_WORDS = _WORDS("comment comments disqus respond reply replies")
_DROP_WORDS = _REPLY_WORDS | _WORDS(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related "
    "recommended login search pagination pager widget toolbar copyright complementary contentinfo dialog hidden"
)
#: Words of classes that hold main text; the first five do so even where another class of the element speaks of replies.
_ARTICLE_WORDS = _WORDS("article main post entry story")
_GOOD_WORDS = _ARTICLE_WORDS | _WORDS("content body text page prose")
#: Before a word in one class, these say that the element lies beside what the word names, or could hold it.
_BESIDE = _WORDS("has with no without is not js")
_AFTER = _WORDS("open closed off enabled disabled")
_BLOCK_TEXT = _WORDS("p pre blockquote td dd li")
#: An element that one of these opens is closed first. Fixed values.
_CLOSES = {
    "p": _WORDS("p"), "li": _WORDS("li p"), "dt": _WORDS("dt dd p"), "dd": _WORDS("dt dd p"), "tr": _WORDS("tr td th p"), "td": _WORDS("td th p"), "th": _WORDS("td th p"),
    "option": _WORDS("option"), "tbody": _WORDS("tr td th thead tbody p"), "body": _WORDS("head title"),
} | {t: _WORDS("p") for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
_SCOPES = _WORDS("table ul ol dl select body html")

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_MARK = re.compile(r"[>\"']")
#: Elements whose content is no text of the page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe".split()}
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[^a-zA-Z]+")


@dataclass(slots=True)
class Element:
    tag: str
    #: Number of the path in Page.paths.
    path: int
    parent: int
    dropped: bool
    link: bool
    good: bool
    #: The nearest element around, or this one, that isn't inline.
    block: int
    score: float = 0.0


@dataclass
class Page:
    """The elements of a page in order, and its texts as (element, text); a text of line end is a block's edge. A path is
    kept as its last name and the number of the path before it."""

    elements: list[Element] = field(default_factory=lambda: [Element("", 0, -1, False, False, False, 0)])
    texts: list[tuple[int, str]] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def path_of(self, element: int) -> str:
        names, back = [], {n: key for key, n in self.paths.items()}
        at = self.elements[element].path
        while at:
            at, name = back[at]
            names.append(name)
        return "".join(f"/{n}" for n in reversed(names))

    def path_number(self, path: str) -> int | None:
        at = 0
        for name in path.split("/")[1:]:
            if (at := self.paths.get((at, name))) is None:
                return None
        return at


def _tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, attributes) of each tag, comment and raw element, in one walk; all but tags have no name.

    A quoted value may hold a > as long as the tag ends somewhere; once one didn't, tags end at their first >."""
    at, quotes = 0, True
    while m := _OPEN.search(source, at):
        begin, after = m.start(), m.end()
        if source.startswith("<!--", begin):
            end = source.find("-->", after)
            end = len(source) if end < 0 else end + 3
            yield begin, end, "", "", ""
        else:
            end = after
            if quotes and m[2]:
                while (mark := _MARK.search(source, end)) and mark[0] != ">":
                    end = source.find(mark[0], mark.end()) + 1
                    if not end:
                        mark = None
                        break
                quotes = mark is not None
                end = mark.end() if mark else 0
            if not (quotes and m[2]):
                end = source.find(">", after) + 1
            if not end:
                return
            if not m[2]:
                yield begin, end, "", "", ""
            else:
                name = m[2].lower()
                if name in _RAW and not m[1]:
                    close = _RAW[name].search(source, end)
                    end = close.end() if close else len(source)
                    yield begin, end, "", "", ""
                else:
                    yield begin, end, m[1], name, source[after : end - 1]
        at = end


def parse(source: str) -> Page:
    page = Page()
    elements, texts, stack, at = page.elements, page.texts, [0], 0
    open_tags: dict[str, int] = {}

    def leave(depth: int) -> None:
        for e in stack[depth:]:
            open_tags[elements[e].tag] -= 1
        del stack[depth:]

    for begin, end, slash, tag, attributes in _tags(source):
        if begin > at:
            texts.append((stack[-1], html.unescape(source[at:begin])))
        at = end
        if not tag:
            continue
        if tag not in _INLINE:
            texts.append((stack[-1], "\n"))
        if slash:
            if open_tags.get(tag):
                leave(next(d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag))
            continue
        if (closed := _CLOSES.get(tag)) and any(open_tags.get(t) for t in closed):
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = elements[stack[depth]].tag
                if open_tag in closed:
                    leave(depth)
                    if not any(open_tags.get(t) for t in closed):
                        break
                elif open_tag not in _INLINE:
                    break
        if tag in _VOID:
            continue
        elements.append(_element(page, tag, attributes, stack[-1]))
        if not attributes.endswith("/") or tag not in _INLINE:
            stack.append(len(elements) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(source):
        texts.append((stack[-1], html.unescape(source[at:])))
    return page


def _speaks_of(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id names one of the words, and not just something beside it."""
    parts = [p for p in _PARTS.split(token) if p]
    return any(p in words and not _BESIDE.intersection(parts[:i]) and not (i + 1 < len(parts) and parts[i + 1] in _AFTER) for i, p in enumerate(parts))


def _element(page: Page, tag: str, attributes: str, parent: int) -> Element:
    above = page.elements[parent]
    name, dropped, good = tag, tag in _DROP_TAGS, tag in ("article", "main")
    if attributes and ("=" in attributes or "hidden" in attributes):
        tokens: list[str] = []
        for key, *values in _NAMED.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "").lower()
            if key in ("class", "id", "role"):
                tokens += value.split()
                if key == "class":
                    name += "".join(f".{c}" for c in sorted(re.sub(r"\d+", "#", value).replace("/", "|").split()))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                dropped = True
        bad = [t for t in tokens if _speaks_of(t, _DROP_WORDS)]
        liked = {p for t in tokens if t not in bad for p in _PARTS.split(t)} & _GOOD_WORDS
        good |= bool(liked)
        # a class of its own for the article outweighs others; one for just any text doesn't make a reply an article
        if bad and tag not in ("html", "body"):
            dropped |= not liked or any(_speaks_of(t, _REPLY_WORDS) for t in bad) and not liked & _ARTICLE_WORDS
    if tag in _INLINE:
        path, block = above.path, above.block
    else:
        path, block = page.paths.setdefault((above.path, name), len(page.paths) + 1), len(page.elements)
    return Element(tag, path, parent, dropped or above.dropped, tag == "a" or above.link, good, block)


def best_container(page: Page) -> int:
    """The element with the highest score, 0 if none has text. A text block gives its words to its container and half of
    them to the one above; links count against it, and names that stand for content count for it."""
    blocks: dict[int, list[int]] = {}
    elements = page.elements
    for e, text in page.texts:
        if elements[e].dropped or text == "\n":
            continue
        block = elements[e].block
        words = blocks.setdefault(block, [0, 0])
        words[elements[e].link] += len(text.split())
    for block, (plain, linked) in blocks.items():
        if (gain := plain - 2 * linked) <= 0:
            continue
        holder = elements[block].parent if elements[block].tag in _BLOCK_TEXT or re.fullmatch("h[1-6]", elements[block].tag) else block
        share = float(gain)
        for _ in range(2):
            if holder <= 0:
                break
            elements[holder].score += share * (1.5 if elements[holder].good else 1.0)
            holder, share = elements[holder].parent, share / 2
    return max(range(len(elements)), key=lambda i: (elements[i].score, -i))


def text_below(page: Page, roots: set[int]) -> str:
    """The text of the given elements without what is dropped, white space and block edges as one space."""
    elements = page.elements
    inside = [i in roots for i in range(len(elements))]
    for i, e in enumerate(elements):
        if e.parent >= 0:
            inside[i] |= inside[e.parent]
    keep = [inside[i] and not e.dropped for i, e in enumerate(elements)]
    return " ".join("".join([t for e, t in page.texts if keep[e]]).split())


def main_text(source: str | None, winner: str | None) -> str:
    """The text below the containers with the winning path, or below the page's own best container."""
    if not source:
        return ""
    page = parse(source)
    number = page.path_number(winner) if winner else None
    roots = {i for i, e in enumerate(page.elements) if number and e.path == number and not e.dropped and e.tag not in _INLINE}
    return text_below(page, roots or {best_container(page)})


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path and votes of the path that most pages of each host vote for (of equals the first in order)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            paths = []
            for source in part.column("html").to_pylist():
                page = parse(source) if source else Page()
                paths.append(page.path_of(best_container(page)) or None)
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(paths, pa.string())], names=["host", "path"])

    small_batches(pages.sparkSession)
    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("best")).select("host", "best.path", (-F.col("best.less")).alias("votes"))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and path (the host's winning path, null if no page of it has text).

    Null or empty html gives an empty text; pages without a host vote together. Repeated rows vote each; of paths with as
    many votes the first in order wins, of containers with the same score the first on the page. Pages of any length and
    depth are read in one walk. An empty table gives an empty result; other columns are left out.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    winners = written(winning_paths(own), "winners").select("host", "path")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(s, w) for s, w in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), part.column("path")], names=["page_id", "url", "text", "path"])

    return own.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string, path string")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; nulls, repeats, ties and empty tables as for extract_main_text."""
    rows = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


QUERIES = {"op4_main_text": op4_main_text}
