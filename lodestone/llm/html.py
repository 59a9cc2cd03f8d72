"""Main text of web pages by consensus host paths.

Each page is parsed into elements; an element's score is the text of its own blocks outside links. A page's best container is the
smallest that holds nearly all of this text (NEARLY), so that an article in several parts stays whole; text outside articles, or else
main parts, doesn't count where these hold a third of it. A path names the tags and classes from the root to an element, digits
taken out, and is kept as a chained hash of these names, so that deep pages don't give long paths. Each page votes for the path of
its best container; votes are summed for each host, and the host's winning path decides what is extracted from all of its pages, so
that a page whose own best container is a sidebar or a comment thread follows the others. A page without the winning path gives
its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by tag, role or class, are
never part of a container. A class says so as a whole word. For groups of blocks (not paragraphs and headings), ids count too, and
words in several parts that end in one of the list ("site-footer") or go on with a word of layout only ("ad-box"; not "related-work"
or "with-sidebar"); these stay if they hold most of the page's text outside links. A header within an article that has a heading,
and one named as an article's ("post-header"), is part of it. Character references are decoded; white space within a block becomes
one space; blocks are trimmed and joined by two line breaks.

Defined cases: null html counts as empty and gives an empty text; a page without markup is one block; unclosed and stray tags,
and pages cut off anywhere, are taken as browsers would, near enough; a null url is a host of its own name, empty; repeated rows
vote each and give a row each. Ties go to the first container of a page and to the path that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed

#: Bytes of hosts and paths up to which they are sent to every executor, and the part of all pages from which a host is hot.
SENT = 8 << 20
HOT = 1 / 1000
#: Part of a page's text that its best container holds at least.
NEARLY = 0.9

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is text up to their end tag, whatever is in it.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style iframe textarea title xmp noframes noembed".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center div main section td html".split())
_SELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table div section article main body td".split())
_DROP = frozenset("nav footer aside form button select menu head dialog object canvas audio video label input fieldset svg template noscript".split())
_GROUPS = frozenset("aside center details div dl figure footer form header li nav ol section table tbody td tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promotion related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: What may follow one of these words in a class without changing what it says.
_PLAIN = frozenset("area articles bar block body bottom box button buttons container content form group icons inner item items left line links list main message overlay panel posts right row section slot stories text thread top unit wrap wrapper zone".split())
_HEADERS = frozenset("header masthead".split())
_OF_ARTICLES = frozenset("article blog chapter content entry news page paper post section story text".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NEVER = frozenset("html body article main".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Whether an element stays: it does; if it holds most of the page's text; if it also has a heading within an article; it goes.
STAYS, IF_MOST, IF_HEADED, GOES = range(4)


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    container: int
    link: bool
    heading: bool


@dataclass
class Container:
    """A container's path and tag, the number of the one around it, on what it stays, and the text of its own blocks outside links."""

    path: str
    tag: str
    around: int
    doubt: int = STAYS
    score: float = 0.0
    headed: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _fate(tag: str, attributes: dict[str, str]) -> int:
    """Whether an element stays: of STAYS, IF_MOST, IF_HEADED and GOES."""
    if tag in _DROP:
        return GOES
    if tag in _NEVER:
        return STAYS
    found = IF_HEADED if tag == "header" else STAYS
    if not attributes:
        return found
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("role", "").lower() in _ROLES:
        return GOES
    group = tag in _GROUPS
    for name in f"{attributes.get('class', '')} {attributes.get('id', '') if group else ''}".split():
        name = _CAMEL.sub("-", name).lower().replace("_", "-")
        if name in _WORDS:
            return max(IF_HEADED, found) if name in _HEADERS else GOES
        words = [w for w in name.split("-") if w and not w.isdigit()]
        if not group or not words:
            continue
        if words[-1] in _HEADERS and words[0] in _OF_ARTICLES:
            continue
        if words[-1] in _WORDS and words[0] not in ("has", "with", "without", "no", "is", "hide", "show") or words[0] in _WORDS and all(w in _PLAIN or w in _WORDS for w in words[1:]):
            found = max(found, IF_HEADED if words[-1] in _HEADERS else IF_MOST)
    return found


class _Stack:
    """Open elements. A fence (a table, a list, a section ...) hides those around it from the end tags of others."""

    def __init__(self):
        self.elements = [Element("", "", False, 0, False, False)]
        self.scopes: list[dict[str, list[int]]] = [{}]
        self.fences: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        if e.tag in _FENCE:
            self.scopes.append({})
            self.fences.setdefault(e.tag, []).append(len(self.elements))
        self.scopes[-1].setdefault(e.tag, []).append(len(self.elements))
        self.elements.append(e)

    def find(self, tag: str) -> int:
        """The place of the innermost open element of a tag that the place at hand can see; 0 for none."""
        places = (self.fences if tag in _FENCE else self.scopes[-1]).get(tag)
        return places[-1] if places else 0

    def inside(self, tags: set[str]) -> int:
        """The place of the innermost open element of the tags since the last fence, that included; 0 for none."""
        return max((places[-1] for t in tags if (places := self.scopes[-1].get(t))), default=0)

    def close(self, at: int) -> None:
        while len(self.elements) > at:
            e = self.elements.pop()
            self.scopes[-1][e.tag].pop()
            if e.tag in _FENCE:
                self.scopes.pop()
                self.fences[e.tag].pop()


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page's texts, start tags and end tags, kind being "text", "start" and "end".

    Every character is looked at a bounded number of times: a quote that nothing closes is a character like others, and a tag that
    nothing closes runs to the page's end.
    """
    size, at = len(html), 0
    last = {q: html.rfind(q) for q in "\"'"}
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", html[at:lt], ""
        if lt == size:
            return
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = end + 3 if end >= 0 else size
            continue
        name = _NAME.match(html, lt + 1)
        if not name:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt + 1)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end = name.end()
        while True:
            end = _UNQUOTED.match(html, end).end()
            if end >= size or html[end] == ">":
                break
            quote = html[end]
            end = html.find(quote, end + 1) + 1 if end < last[quote] else end + 1
        if end >= size:
            return
        tag, raw, at = name[1].lower(), html[name.end() : end], end + 1
        if html[lt + 1] == "/":
            yield "end", tag, ""
        elif tag in _RAW:
            close = _RAW[tag].search(html, at)
            at = close.start() if close else at if raw.endswith("/") else size
        else:
            yield "start", tag, raw


def parse(html: str) -> tuple[list[tuple[str, int]], list[Container]]:
    """The page's blocks that are not dropped, each with the number of its container, and the containers."""
    blocks: list[tuple[str, int]] = []
    containers = [Container("", "", -1)]
    stack = _Stack()
    text: list[str] = []
    plain = 0

    def flush() -> None:
        nonlocal plain
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack.elements[-1]
                blocks.append((joined, top.container))
                containers[top.container].score += plain if plain * 2 >= len(joined) else 0
                containers[top.container].headed |= top.heading
            text.clear()
        plain = 0

    def said(raw: str) -> None:
        nonlocal plain
        if raw and not stack.elements[-1].dropped:
            decoded = unescape(raw)
            text.append(decoded)
            if not stack.elements[-1].link:
                plain += len(decoded)

    for kind, tag, raw in tokens(html):
        if kind == "text":
            said(tag)
            continue
        if kind == "end":
            if tag in _BLOCK:
                flush()
            if at := stack.find(tag):
                stack.close(at)
            continue
        if tag == "br":
            said(" ")
        if tag in _BLOCK:
            flush()
            if at := stack.inside(_SELF.get(tag, {"p"})):
                stack.close(at)
        if tag in _VOID or raw.endswith("/"):
            continue
        attributes, top = _attributes(raw), stack.elements[-1]
        path, container = top.path, top.container
        fate = GOES if top.dropped else _fate(tag, attributes)
        if tag in _CONTAINER or STAYS < fate < GOES:
            classes = sorted({re.sub(r"\d+", "", c) for c in attributes.get("class", "").split()} - {""})
            path = xxhash.xxh3_128_hexdigest(f"{top.path}>{'.'.join([tag, *classes])}".encode("utf-8", "surrogatepass"))
            if fate < GOES:
                containers.append(Container(path, tag, container, fate))
                container = len(containers) - 1
        stack.push(Element(tag, path, fate == GOES, container, top.link or tag == "a", top.heading or tag in _HEADINGS))
    flush()
    return _settled(blocks, containers) if any(c.doubt for c in containers) else (blocks, containers)


def _settled(blocks: list[tuple[str, int]], containers: list[Container]) -> tuple[list[tuple[str, int]], list[Container]]:
    """Without the doubtful containers that don't stay, and all below them."""
    held, headed = [c.score for c in containers], [c.headed for c in containers]
    for i in range(len(containers) - 1, 0, -1):
        held[containers[i].around] += held[i]
        headed[containers[i].around] |= headed[i]
    gone, inside = [False] * len(containers), [False] * len(containers)
    for i, c in enumerate(containers):
        inside[i] = c.tag == "article" or (c.around >= 0 and inside[c.around])
        stays = not c.doubt or held[i] * 2 > held[0] or (c.doubt == IF_HEADED and headed[i] and inside[i])
        gone[i] = not stays or (c.around >= 0 and gone[c.around])
    number, kept = [], 0
    for g in gone:
        number.append(kept)
        kept += not g
    stay = [c for c, g in zip(containers, gone) if not g]
    for c in stay:
        c.around = number[c.around] if c.around >= 0 else -1
    return [(b, number[i]) for b, i in blocks if not gone[i]], stay


def best(containers: list[Container]) -> tuple[int, float]:
    """The number of the smallest container that holds nearly all the text that counts, and how much of it."""
    n = len(containers)
    for kind in ("article", "main", None):
        inside = [False] * n
        for i, c in enumerate(containers):
            inside[i] = kind is None or c.tag == kind or (c.around >= 0 and inside[c.around])
        held = [c.score * i for c, i in zip(containers, inside)]
        for i in range(n - 1, 0, -1):
            held[containers[i].around] += held[i]
        if held[0] * 3 >= sum(c.score for c in containers) and held[0] > 0:
            # Those that hold nearly all are around each other, the smallest last.
            at = max(i for i in range(n) if held[i] >= NEARLY * held[0])
            return at, held[at]
    return 0, 0.0


def vote(html: str) -> tuple[str, float]:
    """The path of a page's best container, and its score."""
    _, containers = parse(html)
    top, score = best(containers)
    return containers[top].path, float(score)


def extract(html: str, path: str | None) -> str:
    """The blocks below the containers of the path, or below the page's best container where it has none with text."""
    blocks, containers = parse(html)

    def below(chosen: set[int]) -> str:
        inside = [False] * len(containers)
        for i, c in enumerate(containers):
            inside[i] = i in chosen or (c.around >= 0 and inside[c.around])
        return "\n\n".join(b for b, i in blocks if inside[i])

    if path is not None and (text := below({i for i, c in enumerate(containers) if c.path == path})):
        return text
    return below({best(containers)[0]})


def host(url):
    """The host of a url column, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def winners(pages: DataFrame) -> DataFrame:
    """host, path and pages: the container path with the most votes of the host's pages, each vote the square root of its text's length, and the number of these pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [vote(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([g[0] for g in got], pa.string()), pa.array([int(100 * max(g[1], 0) ** 0.5) for g in got], pa.int64())], names=["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, votes bigint")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    first = F.min_by("path", F.struct(-F.col("votes"), "path"))
    return counted.groupBy("host").agg(first.alias("path"), F.sum("n").alias("pages"))


def with_paths(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """pages (with a column host) with their host's winning path, without moving the pages of hot hosts.

    The hosts are broadcast if their bytes, which are counted first, are at most ``sent``. Otherwise those with more than the part
    HOT of all pages, of which there can't be more than 1 / HOT, are; the pages of the others meet their paths in a shuffle by host.
    """
    found = checkpointed(winners(pages))
    known = found.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32).alias("bytes"), F.sum("pages").alias("pages")).first()
    found, n = found.withColumnRenamed("host", "of"), F.col("pages")
    on = F.col("host") == F.col("of")
    if (known["bytes"] or 0) <= sent:
        return pages.join(F.broadcast(found), on, "left").drop("of", "pages")
    hot, rest = found.where(n > known["pages"] * HOT), found.where(n <= known["pages"] * HOT)
    few = F.broadcast(hot)
    return pages.join(few, on).unionByName(pages.join(few.select("of"), on, "left_anti").join(rest, on)).drop("of", "pages")


def main_texts(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """page_id, url and main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(h or "", p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html")
    joined = with_paths(rows.withColumn("host", host(F.col("url"))), sent).select("page_id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")


def op6(pages: DataFrame) -> DataFrame:
    """The columns of the op6 contract."""
    return main_texts(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))
