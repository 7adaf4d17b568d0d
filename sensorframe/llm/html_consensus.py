"""Main text of web pages: the pages of a host vote on the container that holds the article."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.url_reputation import host_of
from sensorframe.session import materialize

#: What tags and words in classes, ids and roles mean.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("html body main article section div td center".split())
BLOCK = CONTAINER | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th blockquote pre figure figcaption hr address header "
    "footer nav aside form fieldset legend details summary caption menu dir dialog head option select".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu math "
    "audio video map".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOISE_WORDS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside rail widget widgets "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer comment comments "
    "commentlist respond reply replies discussion disqus share sharing social related recommended trending tags taglist "
    "skip hidden copyright disclaimer search"
).split()
NOISE_ARTICLES = "comment comments reply ad ads advert advertisement sponsored promo".split()
PLACE_WORDS = "site page main post article entry blog global primary secondary top bottom left right mobile desktop sticky fixed user users reader readers".split()
FORM_WORDS = (
    "list section box block container wrapper wrap area bar left right top bottom inner outer link links button buttons icon icons form slot "
    "unit item items post posts article articles story stories content text body title heading group holder panel module zone column row thread"
).split()
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SHIELD = CONTAINER | frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(?:!--|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _whole_name(words: list[str]) -> re.Pattern:
    """Names made of ``words`` alone, but for words of place before and of place or form after them: not ``related-work``."""
    own, before, after = "|".join(words), "|".join(PLACE_WORDS), "|".join(words + FORM_WORDS + PLACE_WORDS)
    return re.compile(rf"(?:(?:{before})[-_]+)*(?:{own})(?:[-_]+(?:{after}))*[-_]*\d*")


_NOISE, _NOISE_ARTICLE, _HEADER = _whole_name(NOISE_WORDS), _whole_name(NOISE_ARTICLES), _whole_name(["header"])


@dataclass
class _Element:
    """An open element. All but ``tag`` and ``container`` are handed down to what it holds."""

    tag: str
    container: int
    #: Dropped for its tag, role or attribute (2), or for its name (1), which a ``main`` inside overrides.
    dropped: int = 0
    link: bool = False
    article: bool = False
    h1: bool = False
    heading: bool = False
    #: Inside a page header that lies in an article only headings count.
    headings_only: bool = False


def _step(path: int, step: str) -> int:
    """The key of a path one step longer. Keys stand for paths, whose text would grow with the depth."""
    return int.from_bytes(blake2b(f"{path}/{step}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def path_key(path: str) -> int:
    """The key of a written path such as ``/html/body/div.text``."""
    return reduce(_step, path.split("/")[1:], 0)


@dataclass
class Page:
    """Blocks of text as ``(container, text, characters in links)``; containers as path key and parent.

    ``titles`` are the blocks that are top headings, ``tags`` the elements that the blocks lie in, ``articles`` and ``mains`` each
    container's outermost article and main, -1 if none.
    """

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    titles: set[int] = field(default_factory=set)
    paths: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [-1])
    articles: list[int] = field(default_factory=lambda: [-1])
    mains: list[int] = field(default_factory=lambda: [-1])


def _names(attributes: dict[str, str]) -> list[str]:
    """Classes and id in lower case, with hyphens for the humps of camel case."""
    return [_SPLIT_CAMEL.sub("-", n).lower() for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]


def _general(attributes: dict[str, str]) -> str:
    """Classes without their digits, in order, so that numbered classes of a template fall together."""
    classes = {re.sub(r"\d+", "", c.lower()) for c in attributes.get("class", "").split()}
    return "".join(f".{c}" for c in sorted(classes) if c)


def parse(html: str) -> Page:
    """Blocks and containers of a page, without what is boilerplate by tag, role, class or id.

    One pass over the tags; unclosed paragraphs, list items and cells are closed as browsers close them,
    other unclosed elements end with their parent. Time and memory grow with the length alone, however deep
    the elements nest.
    """
    page, root, text, linked = Page(), _Element("", 0), [], 0
    stack: list[_Element] = []
    n_open: Counter[str] = Counter()
    ends: list[int] = []  # places in the stack of elements that a tag may close unasked, and of those that shield what is around them

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(text).split())
        if block:
            top = stack[-1] if stack else root
            if top.h1:
                page.titles.add(len(page.blocks))
            page.blocks.append((top.container, block, min(linked, len(block))))
            page.tags.append(top.tag)
        text.clear()
        linked = 0

    def close(to: int) -> None:
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        n_open.subtract(e.tag for e in stack[to:])
        del stack[to:]
        while ends and ends[-1] >= to:
            ends.pop()

    def say(raw: str) -> None:
        nonlocal linked
        top = stack[-1] if stack else root
        if top.dropped or top.headings_only and not top.heading:
            return
        plain = unescape(raw) if "&" in raw else raw
        text.append(plain)
        if top.link:
            linked += len(plain)

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        low = html.find("<", at)
        if low < 0 or low > last and not html.startswith("<!--", low):
            say(html[at:])
            break
        if low > at:
            say(html[at:low])
        m = _TAG.match(html, low)
        if not m:
            say("<")
            at = low + 1
            continue
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if n_open[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                say(" ")
            continue
        rest = m[3] if m[2] else m[6]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = n if not end else html.find(">", end.end()) + 1 or n
            continue
        if tag in BLOCK:
            flush()
            closed = CLOSED_BY.get(tag, "").split()
            for i in range(len(ends) - 1, -1, -1):  # closing drops places from here up
                if stack[ends[i]].tag == "p" or stack[ends[i]].tag in closed:
                    close(ends[i])
                elif stack[ends[i]].tag in SHIELD:
                    break
        up = stack[-1] if stack else root
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(rest)} if rest and ("=" in rest or "hidden" in rest) else {}
        names = _names(attributes)
        header = tag == "header" or tag in CONTAINER and any(map(_HEADER.fullmatch, names))
        new = _Element(
            tag, up.container, up.dropped, up.link or tag == "a", up.article or tag in ("article", "main"), up.h1 or tag == "h1",
            up.heading or tag in HEADINGS, up.headings_only or header and up.article,
        )
        if tag == "main" and new.dropped == 1:
            new.dropped = 0
        if tag in DROPPED or header and not up.article or "hidden" in attributes:
            new.dropped = 2
        elif tag not in ("html", "body", "main"):
            if attributes.get("role", "").lower() in DROPPED_ROLES:
                new.dropped = 2
            elif any(map((_NOISE_ARTICLE if tag == "article" else _NOISE).fullmatch, names)):
                new.dropped = new.dropped or 1
        if tag in CONTAINER and not new.dropped:
            new.container = len(page.paths)
            page.paths.append(_step(page.paths[up.container], tag + _general(attributes)))
            page.parents.append(up.container)
            for outermost, name in ((page.articles, "article"), (page.mains, "main")):
                outermost.append(new.container if outermost[up.container] < 0 and tag == name else outermost[up.container])
        if tag in SHIELD or tag in CLOSED_BY or tag == "p":
            ends.append(len(stack))
        n_open[tag] += 1
        stack.append(new)
    flush()
    return page


def _around(page: Page, k: int) -> int:
    """The outermost article around a container or itself, else the outermost main, else the container."""
    return page.articles[k] if page.articles[k] >= 0 else page.mains[k] if page.mains[k] >= 0 else k


def scores(page: Page) -> tuple[list[int], list[int], list[int]]:
    """By container, with all that lies in it: its score, its characters and those in links. Link text counts against the score."""
    score, size, links = ([0] * len(page.paths) for _ in range(3))
    for k, text, linked in page.blocks:
        score[k] += max(len(text) - 2 * linked, 0)
        size[k] += len(text)
        links[k] += linked
    for k in range(len(page.paths) - 1, 0, -1):  # parents come before what they hold
        for sums in (score, size, links):
            sums[page.parents[k]] += sums[k]
    return score, size, links


def best(page: Page, score: list[int], share: float = 0.95) -> dict[int, int]:
    """The containers that a page votes for, with their scores: its outermost articles, else its mains, else the lowest container
    that holds ``share`` of the score."""
    for outermost in (page.articles, page.mains):
        found = {k: score[k] for k in set(outermost) if k >= 0 and score[k]}
        if found:
            return found
    return {lowest: score[lowest]} if (lowest := max((k for k, v in enumerate(score) if v and v >= share * score[0]), default=-1)) >= 0 else {}


def votes(page: Page) -> dict[int, int]:
    """The generalised paths of the best containers of a page, with thousandths of a vote."""
    by_path: Counter[int] = Counter()
    for k, v in best(page, scores(page)[0]).items():
        by_path[page.paths[k]] += v
    total = sum(by_path.values())
    return {p: 1000 * v // total for p, v in by_path.items()}


def _ancestors(page: Page, k: int) -> set[int]:
    found = set()
    while (k := page.parents[k]) >= 0:
        found.add(k)
    return found


def beside(page: Page, around: set[int], inside: list[bool]) -> dict[int, tuple[int, list[int]]]:
    """The parts that lie in the containers ``around`` the best one, and not ``inside`` it: ``{part: (path, blocks)}``.

    A part is a container, or a block of its own. Parts that are mostly links are none.
    """
    owner = [k if parent in around and k not in around and not inside[k] else -1 for k, parent in enumerate(page.parents)]
    for k, parent in enumerate(page.parents):
        if owner[k] < 0 <= parent:
            owner[k] = owner[parent]
    parts: dict[int, tuple[int, list[int]]] = {}
    for n, (k, _, _) in enumerate(page.blocks):
        if owner[k] >= 0:
            parts.setdefault(owner[k], (page.paths[owner[k]], []))[1].append(n)
        elif k in around:
            parts[-1 - n] = (_step(page.paths[k], f"#{page.tags[n]}"), [n])
    return {
        k: (path, own) for k, (path, own) in parts.items()
        if 2 * sum(page.blocks[n][2] for n in own) <= sum(len(page.blocks[n][1]) for n in own)
    }


def _inside(page: Page, chosen: set[int]) -> list[bool]:
    inside = [k in chosen for k in range(len(page.paths))]
    for k, parent in enumerate(page.parents):
        inside[k] = inside[k] or parent >= 0 and inside[parent]
    return inside


def part_texts(page: Page) -> list[tuple[int, int]]:
    """``(path, hash of the text)`` of the parts beside a page's best container, where that is no article or main."""
    chosen = best(page, scores(page)[0])
    if len(chosen) != 1 or _around(page, only := next(iter(chosen))) != only or page.articles[only] == only or page.mains[only] == only:
        return []
    parts = beside(page, _ancestors(page, only), _inside(page, {only})).values()
    return [(path, _step(0, "\n".join(page.blocks[n][1] for n in own))) for path, own in parts]


def main_text(page: Page, winners: list[int], wide: int = 0, varied: frozenset[int] = frozenset()) -> str:
    """Text of the containers with the host's first winning path that the page has; else of the page's own best ones.

    If they lie in an article, or else in main, all of that is taken: sections, leads and what stands between them.
    Else the outermost container around them whose path is one of the ``wide`` first winners is taken in their place,
    parts in it that are mostly links are left out, and parts beside it whose paths are ``varied`` join it.
    If there is no top heading in all this, the last one before it in a container around it leads the text.
    """
    score, size, links = scores(page)
    chosen = next((ks for p in winners if (ks := {k for k, own in enumerate(page.paths) if own == p and score[k]})), None) or set(best(page, score))
    if not chosen:  # nothing but links, or nothing
        return "\n".join(t for _, t, _ in page.blocks)
    lifted = {_around(page, k) for k in chosen}
    first = min(lifted)
    around = _ancestors(page, first)
    free = page.articles[first] < 0 and page.mains[first] < 0
    if free:
        lifted = {min((k for k in around if k and page.paths[k] in winners[:wide]), default=first)} | lifted
        first = min(lifted)
        around = _ancestors(page, first)
    inside = _inside(page, lifted)
    out = [free and inside[k] and k not in lifted and 2 * links[k] > size[k] for k in range(len(page.paths))]
    for k, parent in enumerate(page.parents):
        out[k] = out[k] or parent >= 0 and out[parent]
    kept = {n for n, (k, _, _) in enumerate(page.blocks) if inside[k] and not out[k]}
    if free and varied:
        for path, own in beside(page, around, inside).values():
            kept |= set(own) if path in varied else set()
    if kept and not page.titles & kept:
        low = min(kept)
        kept |= set([n for n in sorted(page.titles) if n < low and page.blocks[n][0] in around and not page.blocks[n][2]][-1:])
    return "\n".join(page.blocks[n][1] for n in sorted(kept))


def _tally(pages: DataFrame) -> DataFrame:
    """``(host, path, votes, page, text)``: votes of paths per batch; and, without votes, the parts beside best containers, by hashes
    of their page and their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cast: Counter[tuple] = Counter()
            parts = set()
            for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                source = html.as_py() or ""
                page = parse(source)
                for path, v in votes(page).items():
                    cast[host, path] += v
                parts.update((host, path, None, _step(0, source), text) for path, text in part_texts(page))
            rows = [(host, path, v, None, None) for (host, path), v in cast.items()] + list(parts)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "votes", "page", "text"])

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, path long, votes long, page long, text long")


def host_paths(pages: DataFrame, least: float = 0.05, wide: float = 0.25) -> DataFrame:
    """``(host, paths, wide, varied)``: what the pages of a host agree on.

    ``paths`` are keys of the container paths with at least ``least`` of the votes, most votes first; the first ``wide`` of them
    have that share or more. ``varied`` are the paths of parts beside the best containers that at least two different pages and
    ``least`` of those with parts have, with a text of their own on more than half of them: leads and closing
    paragraphs, but not what a template repeats. Pages that are equal count as one there.
    """
    tally = materialize(_tally(pages), "host-votes")
    cast = tally.where("votes IS NOT NULL").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = cast.join(cast.groupBy("host").agg(F.sum("votes").alias("total")), "host").where(F.col("votes") >= least * F.col("total"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    paths = ranked.groupBy("host").agg(
        F.transform(order, lambda x: x["path"]).alias("paths"), F.count_if(F.col("votes") >= wide * F.col("total")).cast("int").alias("wide"))
    parts = tally.where("votes IS NULL").distinct()  # equal pages of several batches
    # a page's texts under one path count as one text, so that the number of texts compares with the number of pages
    texts = parts.groupBy("host", "path", "page").agg(F.bit_xor("text").alias("text"))
    n_texts = texts.groupBy("host", "path", "text").agg(F.count("*").alias("n")).groupBy("host", "path").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n"))
    n_pages = parts.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    varied = n_texts.join(n_pages, "host").where((F.col("n") > 1) & (2 * F.col("texts") > F.col("n")) & (F.col("n") >= least * F.col("pages")))
    return paths.join(varied.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("varied")), "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    A null or empty html, or one without text, gives an empty text. Pages with a null url vote as pages of
    the empty host. Repeated rows and null ids stay. The table of winning paths (at most twenty a host, and as many sets of parts) is
    written first, so that the join with it is planned by its true size: broadcast if small, else on the host
    with large hosts split.
    """
    winners = materialize(host_paths(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of("url").alias("host"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths", "wide", "varied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                main_text(parse(h), paths or [], wide or 0, frozenset(varied or ())) if (h := html.as_py()) else ""
                for html, paths, wide, varied in zip(b.column("html"), *(b.column(c).to_pylist() for c in ("paths", "wide", "varied")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
