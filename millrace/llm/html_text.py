"""Main text of web pages by the paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import column, packed, saved, unpacked

# A comment, a declaration, or a tag with its name and attributes. Possessive
# repeats: a stray quote cannot make matching slow.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACES = re.compile(r"\s+")

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html tbody td tfoot th thead tr option optgroup legend summary dt dd".split())
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPE = frozenset("article aside body div html main nav section table td th ul ol dl form header footer blockquote".split())
_CONTAINER = frozenset("article body div main section td".split())
# What is not part of an article, by element, role, and words of class and id.
_DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input "
    "map math menu nav noembed noframes noscript object script select style svg template textarea title video".split()
)
_DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar widget widgets footer header "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus respond replies reply "
    "share sharing social related recommended recommendations pagination pager skip".split()
)
# What a compound class name may add to them ("comment-list", "site_header").
_PLACES = frozenset(
    "area bar block body bottom box buttons container content form group inner item items left line link "
    "links list main outer page panel post posts right row section site thread title top wrap wrapper zone".split()
)


@dataclass
class Page:
    """A parsed page: elements in document order and the text between tags."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)  # generalised tag and class
    end: list[int] = field(default_factory=list)  # first element after its subtree
    drop: list[int] = field(default_factory=list)  # 2: by element, 1: by class
    # (element, text), or (element, None) where a block begins or ends
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def _generalised(tag: str, classes: str) -> str:
    words = sorted({re.sub(r"\d+", "#", w) for w in classes.lower().split()})
    return ".".join([tag, *words])


def _dropped(tag: str, attributes: dict[str, str]) -> int:
    if tag in _DROPPED or attributes.get("role", "").lower() in _DROPPED_ROLES:
        return 2
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 2
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return 2
    if tag in ("html", "body", "main", "article"):
        return 0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return int(any(map(_boilerplate, names)))


@lru_cache(4096)
def _boilerplate(name: str) -> bool:
    """Whether a whole class name says so: all of its parts do, or only add a place.
    One that also names something else ("related-work", "article-header") does not."""
    parts = [p for p in re.split(r"[_-]+|\d+", name) if p]
    return not _DROPPED_WORDS.isdisjoint(parts) and (_DROPPED_WORDS | _PLACES).issuperset(parts)


def parse(source: str) -> Page:
    """Elements and text of a page; unclosed and misplaced tags are repaired as
    browsers do for paragraphs, list items and table cells."""
    page = Page()
    stack: list[int] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            page.end[e] = len(page.tag)
            if page.tag[e] in _BLOCK:
                page.pieces.append((stack[-1] if stack else -1, None))

    def close_any(names, scope) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            t = page.tag[stack[depth]]
            if t in names:
                return close_to(depth)
            if t in scope:
                return None
        return None

    at = 0
    while at < len(source):
        m = _MARKUP.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            page.pieces.append((stack[-1] if stack else -1, text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                page.pieces.append((stack[-1] if stack else -1, html.escape(m[0][9:].removesuffix("]]>"))))
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if page.tag[stack[depth]] == tag:
                    close_to(depth)
                    break
            if tag == "p" or tag == "br":
                page.pieces.append((stack[-1] if stack else -1, None if tag == "p" else " "))
            continue
        if tag in _CLOSES_P:
            close_any({"p"}, _SCOPE)
        if tag in _SIBLINGS:
            close_any(_SIBLINGS[tag], {"table", "ul", "ol", "dl", "select"})
        if tag in ("br", "wbr"):
            page.pieces.append((stack[-1] if stack else -1, " " if tag == "br" else ""))
        attributes = {
            a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3].rstrip("/>"))
        } if len(m[3]) > 1 else {}
        e = len(page.tag)
        page.tag.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.name.append(_generalised(tag, attributes.get("class", "")))
        page.end.append(e + 1)
        page.drop.append(_dropped(tag, attributes))
        if tag in _BLOCK:
            page.pieces.append((e, None))
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            continue
        stack.append(e)
    close_to(0)
    _resolve(page)
    return page


def _resolve(page: Page) -> None:
    """Settle which elements are left out: those marked, and all below them. A
    class alone does not remove the element that holds the article, and what
    carries the title inside an article stays, be it a header by element or class."""
    n = len(page.tag)
    holds, title = [0] * (n + 1), [0] * (n + 1)
    for e in range(n):
        holds[e + 1] = holds[e] + (page.tag[e] in ("article", "main"))
        title[e + 1] = title[e] + (page.tag[e] == "h1")
    inside = [False] * n
    for e in range(n):
        p = page.parent[e]
        inside[e] = page.tag[e] in ("article", "main") or p >= 0 and inside[p]
        drop = page.drop[e]
        if drop == 1 and holds[page.end[e]] > holds[e]:
            drop = 0
        titled = inside[e] and title[page.end[e]] > title[e]
        if titled and (page.tag[e] == "header" or drop == 1):
            drop = 0
        page.drop[e] = 1 if drop or p >= 0 and page.drop[p] else 0


def _clean(text: str) -> str:
    return _SPACES.sub(" ", html.unescape(text)).strip()


def blocks(page: Page, within: int = -1) -> list[tuple[int, str, int]]:
    """(element, text, length in links) of each block of text that is kept, in
    page order, optionally of one element's subtree."""
    out: list[tuple[int, str, int]] = []
    parts: list[str] = []
    owner, linked = -1, 0
    first, last = (within, page.end[within]) if within >= 0 else (-1, len(page.tag))

    def flush() -> None:
        nonlocal linked
        if parts and (text := _clean("".join(parts))):
            out.append((owner, text, linked))
        parts.clear()
        linked = 0

    for e, text in page.pieces:
        if not first <= e < last or e >= 0 and page.drop[e]:
            continue
        if text is None:
            flush()
            continue
        if not parts:
            owner = e
        parts.append(text)
        up = e
        while up >= 0 and page.tag[up] not in _BLOCK:
            if page.tag[up] == "a":
                linked += len(text)
                break
            up = page.parent[up]
    flush()
    return out


def container_scores(page: Page) -> dict[int, float]:
    """Score of each container: the text of the blocks right inside it, and half
    of what lies one level deeper, less what is linked."""
    scores: dict[int, float] = {}
    for owner, text, linked in blocks(page):
        worth = max(0, len(text) - 2 * linked)
        e, share = owner, 1.0
        while e >= 0 and share >= 0.5:
            if page.tag[e] in _CONTAINER and not page.drop[e]:
                scores[e] = scores.get(e, 0.0) + worth * share
                share /= 2
            e = page.parent[e]
    return scores


def best_container(page: Page, scores: dict[int, float] | None = None) -> int:
    """The container of highest score, or the article or main element around it;
    -1 when no container has text."""
    scores = container_scores(page) if scores is None else scores
    best = max(scores, key=lambda e: (scores[e], -e), default=-1)
    if best < 0 or scores[best] <= 0:
        return -1
    e, around = best, -1
    while e >= 0:
        if page.tag[e] == "article" or page.tag[e] == "main" and around < 0:
            around = e
        e = page.parent[e]
    return around if around >= 0 else best


def path(page: Page, e: int) -> str:
    """Generalised tag-class path: digits in classes become #, places are left out."""
    names = []
    while e >= 0:
        names.append(page.name[e])
        e = page.parent[e]
    return ">".join(reversed(names))


def voted_container(page: Page) -> int:
    """The best container, or the one around it and its siblings where they share
    an article: where it is a section beside others, or where what lies around it
    has at least a quarter of its text. -1 when no container has text."""
    best = best_container(page)
    if best < 0 or page.tag[best] in ("article", "main"):
        return best
    before = [0] * (len(page.tag) + 1)
    for owner, text, linked in blocks(page):
        before[owner + 1] += max(0, len(text) - 2 * linked)
    for e in range(len(page.tag)):
        before[e + 1] += before[e]
    worth = lambda e: before[page.end[e]] - before[e]
    split = {}  # sections with text, by what they lie in
    for e, tag in enumerate(page.tag):
        if tag == "section" and not page.drop[e] and worth(e) > 0:
            split[page.parent[e]] = split.get(page.parent[e], 0) + 1
    e = page.parent[best]
    below = best
    while e >= 0:
        beside = page.tag[below] == "section" and split.get(e, 0) > 1
        if page.tag[e] in _CONTAINER and (beside or 4 * (worth(e) - worth(best)) >= worth(best)):
            best = e
        below, e = e, page.parent[e]
    return best


def covering_container(page: Page) -> int:
    """The article or main element around the best container; without one, the
    smallest container that covers all kept text, or -1 for the whole page."""
    best = best_container(page)
    if best < 0 or page.tag[best] in ("article", "main"):
        return best
    owners = [b[0] for b in blocks(page)]
    first, last, e = min(owners), max(owners), best
    while e >= 0 and not (page.tag[e] in _CONTAINER and e <= first and last < page.end[e]):
        e = page.parent[e]
    return e


def extract(source: str, winners: list[str]) -> str:
    """Text of all elements on the first winning path that the page has; without
    one, of the article or main element, or else of the smallest container that
    covers the text of the page, or of the whole body."""
    page = parse(source)
    if winners:
        kept = [e for e in range(len(page.tag)) if page.tag[e] in _CONTAINER and not page.drop[e]]
        paths = {e: path(page, e) for e in kept}
        for winner in winners:
            found = [b[1] for e in kept if paths[e] == winner for b in blocks(page, e)]
            if found:
                return "\n\n".join(found)
    return "\n\n".join(b[1] for b in blocks(page, covering_container(page)))


def main_texts(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_share: float = 0.1,
) -> DataFrame:
    """Input columns with ``text`` (and ``n_chars``) of each page's article.

    Every page scores its containers and votes for the generalised path of the
    best one, or of the one around it where an article is split. Paths with at least ``min_share`` of a host's votes win, in order of
    their votes, and all pages of the host are extracted again by them.

    * A null or empty page, and one without text, gives an empty text.
    * Pages without a host in their url, and those without a winning path, keep
      their article or main element, or else all text outside boilerplate.
    * Pages have no length limit; rows that repeat are treated alike; an empty
      table gives an empty result.

    Votes are combined per host and path before the shuffle, a host has at most
    1 / ``min_share`` winners, and the table of winners is written before pages
    meet it, so a hot host's pages can be split.
    """
    host = F.lower(F.regexp_extract(column(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.coalesce(host, F.lit(""))
    votes = (
        pages.select(host.alias("host"), _voted(column(html_col)).alias("path"))
        .filter("host <> '' and path <> ''")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    votes = saved(votes, "votes")
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"))
    winners = saved(
        votes.join(totals, "host")
        .filter(F.col("n") >= min_share * F.col("total"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("w"))
        .select(F.col("host").alias("h"), F.col("w.path").alias("winners")),
        "winners",
    )
    rows = packed(pages, host=host)
    joined = rows.join(winners, rows.host == F.col("h"), "left").select(
        "row", _extracted(F.col("row").getField(html_col), F.col("winners")).alias("text")
    )
    return unpacked(joined, "text", n_chars=F.length("text").cast("long"))


def _voted(source: F.Column) -> F.Column:
    @F.arrow_udf("string")
    def vote(pages: pa.Array) -> pa.Array:
        out = []
        for text in pages.to_pylist():
            page = parse(text or "")
            best = voted_container(page)
            out.append(path(page, best) if best >= 0 else "")
        return pa.array(out, pa.string())

    return vote(source)


def _extracted(source: F.Column, winners: F.Column) -> F.Column:
    @F.arrow_udf("string")
    def extracted(pages: pa.Array, paths: pa.Array) -> pa.Array:
        pairs = zip(pages.to_pylist(), paths.to_pylist(), strict=True)
        return pa.array([extract(text or "", p or []) for text, p in pairs], pa.string())

    return extracted(source, winners)
