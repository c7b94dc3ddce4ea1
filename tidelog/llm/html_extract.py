"""HTML extraction by line-block distribution.

A page is read into elements once. Markup is stripped: comments, scripts and styles with what they hold, and elements that by name, role or class are no article (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments). A class or identifier counts by its whole tokens and by their head word, so that `no-sidebar` or `related-work` mark nothing, and only on elements that hold blocks, never on a paragraph or a heading. No element goes that holds the page's largest article.

What is left falls into lines at the tags that begin or end a block. A line's length is its text outside links; a line of links alone has none and counts as a line for each link. Lengths are summed over a sliding window of WINDOW lines: where the sum falls to nothing the text dives, where it rises again it surges, and what stands between a surge and the next dive is kept. So a menu that nothing marks goes, and a paragraph that is a link stays. Where marked articles hold most of the text, lines outside them are no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import slices, texts_of

WINDOW = 3

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
    |<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)
    |<(?P<raw>script|style|noscript|template|textarea|title|iframe|canvas|select|datalist|audio|video|xmp)(?=[\s/>])(?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*+(?:(?<=/)>|>(?P<held>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Names of elements (fixed values of HTML): those that hold no article, those without content, those that begin and end a line, and those on which a class or identifier tells what they hold.
_AWAY = frozenset("nav footer aside form menu dialog button label fieldset search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td text tfoot th thead tr ul".split())
_HOLDERS = frozenset("div section ul ol dl li table aside header footer nav form span center article".split())
#: Elements whose end a sibling's begin implies, and what they can't reach out of (fixed values of HTML).
_SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "a": ("a", "td th div li")}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SIBLINGS.items()}
_CELLS = frozenset("td th caption table".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Parts of a page: a form that holds one is a frame.
_PARTS = frozenset("h1 h2 nav header footer aside".split())

#: Roles of no article (fixed values).
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Head words of a class or identifier that mark no article: those of the contract's list and what pages call them.
_MARKS = frozenset(
    "nav navbar navigation topnav sidenav subnav menu menubar breadcrumb breadcrumbs pagination pager footer colophon contentinfo sidebar aside notice notices notification cookie cookies consent gdpr alert popup modal overlay "
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored promo promos promotion form search searchbar searchbox newsletter subscribe signup login share sharing social related recommended comment comments commentlist respond reply replies disqus".split()
)
_HEADERS = frozenset("header masthead banner topbar".split())
#: Words of a header that is the page's own and not a section's.
_OF_PAGE = frozenset("site page global main web blog top app".split())
#: Words behind the head word that add nothing to it; words before it that say it is only told of.
_TRAILING = frozenset("container wrapper wrap inner outer area box block list section left right top bottom primary secondary content contents body item items panel slot unit thread holder bar widget region posts articles stories links".split())
_TOLD_OF = frozenset("no not non without with has have is hide show layout grid template".split())


def _words(token: str) -> list[str]:
    return [x for x in re.split(r"[-_:\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]


def _marks(token: str, inside: bool) -> bool:
    """Whether a token of a class or identifier says that the element is no article; inside: of an article, whose headers are its own."""
    words = _words(token)
    while len(words) > 1 and words[-1] in _TRAILING:
        words.pop()
    if not words or _TOLD_OF.intersection(words[:-1]):
        return False
    if words[-1] in _HEADERS:
        return not inside and (len(words) == 1 or words[-2] in _OF_PAGE)
    return words[-1] in _MARKS


def _no_article(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element by its role, class or identifier is no article, or is hidden."""
    for m in _ATTR.finditer(attrs):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "hidden":
            return True
        if what == "role":
            if any(x in _ROLES and not (inside and x == "banner") for x in value.lower().split()):
                return True
        elif what in ("class", "id") and name in _HOLDERS:
            if any(_marks(x, inside) for x in value.split()):
                return True
    return False


@dataclass
class Page:
    """Elements in the order of their begins: name, parent, whether they are no article, whether they lie in a link, whether they are an article; text with the element that holds it, None for the end of a line."""

    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    away: list[bool] = field(default_factory=lambda: [False])
    linked: list[int] = field(default_factory=lambda: [0])
    article: list[bool] = field(default_factory=lambda: [False])
    parts: list[tuple[int, str | None]] = field(default_factory=list)

    @classmethod
    def of(cls, source: str) -> Page:
        page, at, now = cls(), 0, 0
        names, parents, parts = page.names, page.parents, page.parts
        inside = [False]  # an article, main or section
        open_: dict[str, int] = {}

        def up(to: int) -> int:
            k = now
            while k != to:
                open_[names[k]] -= 1
                k = parents[k]
            return to

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text = source[at : m.start()]
                parts.append((now, html.unescape(text) if "&" in text else text))
            at = m.end()
            if m["data"] is not None:
                parts.append((now, m["data"]))
            elif m["raw"] is not None and m["raw"].lower() == "xmp":
                parts += [(now, None), (now, m["held"] or ""), (now, None)]
            if m["name"] is None:
                continue
            name, attrs = m["name"].lower(), m["attrs"]
            block = name in _BLOCK
            if m["close"]:
                if name == "br":
                    parts.append((now, None))
                elif open_.get(name):
                    found = now
                    while found and names[found] != name and (names[found] not in _BLOCK if not block else name in _CELLS or names[found] not in _CELLS):
                        found = parents[found]
                    if found and names[found] == name:
                        now = up(parents[found])
                if block:
                    parts.append((now, None))
                continue
            if block:
                if names[now] == "p":
                    now = up(parents[now])
                parts.append((now, None))
            if name in _IMPLIED:
                siblings, bounds = _IMPLIED[name]
                found = now
                while found and names[found] not in bounds and names[found] not in siblings:
                    found = parents[found]
                if found and names[found] in siblings:
                    now = up(parents[found])
            if name in _VOID or (attrs.endswith("/") and name not in _BLOCK and name != "a"):
                continue
            names.append(name)
            parents.append(now)
            open_[name] = open_.get(name, 0) + 1
            held = inside[now]
            article = name in ("article", "main") or "main" in attrs and re.search(r"""\srole\s*=\s*["']?main\b""", attrs, re.I) is not None
            bare = name in ("html", "body", "main")
            quote = name == "footer" and names[now] == "blockquote"
            no = not bare and (name in _AWAY and not quote or name == "header" and not held or bool(attrs) and _no_article(name, attrs, held))
            page.away.append(no)
            page.article.append(article and not no)
            page.linked.append(page.linked[now] or (len(names) - 1 if name == "a" and "href" in attrs.lower() else 0))
            inside.append(held or article or name == "section")
            now = len(names) - 1
        if at < len(source):
            text = source[at:]
            parts.append((now, html.unescape(text) if "&" in text else text))
        return page

    def _stripped(self, away: list[bool]) -> list[bool]:
        out = [False] * len(away)
        for k in range(1, len(away)):
            out[k] = away[k] or out[self.parents[k]]
        return out

    def stripped(self) -> list[bool]:
        """Which elements go: those that are no article and what they hold, but for elements around the page's largest article, and a form that is the frame of a page, with a heading or other parts of it and more paragraphs than the rest."""
        gone = self._stripped(self.away)
        if not any(gone[k] and (self.article[k] or n == "form") for k, n in enumerate(self.names)):
            return gone
        own, left = [0] * len(gone), 0
        for k, text in self.parts:
            if text:
                n = len(text.strip())
                own[k] += n
                left += 0 if gone[k] else n
        prose, form, frames = [False] * len(gone), [0] * len(gone), set()
        for k in range(1, len(gone)):
            prose[k] = self.names[k] in _PROSE or prose[self.parents[k]]
            form[k] = k if self.names[k] == "form" else form[self.parents[k]]
            if self.names[k] in _PARTS:
                frames.add(form[k])
        whole, paragraphs = own.copy(), [n if p else 0 for n, p in zip(own, prose, strict=True)]
        for k in range(len(gone) - 1, 0, -1):
            if not self.away[k]:
                whole[self.parents[k]] += whole[k]
                paragraphs[self.parents[k]] += paragraphs[k]
        sizes = {k: whole[k] if self.article[k] else paragraphs[k] for k in range(1, len(gone)) if gone[k] and (self.article[k] or k in frames)}
        best = max(sizes, key=lambda k: (sizes[k], -k), default=0)
        if not best or sizes[best] <= left:
            return gone
        away = self.away.copy()
        while best:
            away[best] = False
            best = self.parents[best]
        return self._stripped(away)

    def lines(self) -> list[tuple[str, int, int]]:
        """(text, length, links) of each line: text of lines that are no part of the article is empty."""
        gone = self.stripped()
        within = [False] * len(gone)
        for k in range(1, len(gone)):
            within[k] = not gone[k] and (self.article[k] or within[self.parents[k]])
        sums = [0, 0]
        for k, text in self.parts:
            if text is not None and not gone[k]:
                sums[within[k]] += len(text.strip())
        marked = sums[1] > sums[0]
        out: list[tuple[str, int, int]] = []
        held: list[tuple[int, str]] = []

        def end() -> None:
            text = " ".join("".join(t for _, t in held).split())
            if text:
                links = {self.linked[k] for k, _ in held} - {0}
                if marked and not within[held[0][0]]:
                    out.append(("", 0, 0))
                elif marked or not links:
                    out.append((text, len(text), 0))
                else:
                    out.append((text, sum(c.isalnum() for k, t in held if not self.linked[k] for c in t), len(links)))
            held.clear()

        for k, text in self.parts:
            if text is None:
                end()
            elif not gone[k]:
                held.append((k, text))
        end()
        return out


def between(lengths: list[int], window: int = WINDOW) -> list[bool]:
    """Which lines stand between a surge and the dive after it: no window of lines whose lengths sum up to nothing covers them."""
    out = [True] * len(lengths)
    total = sum(lengths[:window])
    for k in range(len(lengths) - window + 1):
        if total == 0:
            out[k : k + window] = [False] * window
        if k + window < len(lengths):
            total += lengths[k + window] - lengths[k]
    return out


def extract(page: str | None, window: int = WINDOW) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    lines = Page.of(page).lines()
    lengths = [x for _, length, links in lines for x in ([length] if length or not links else [0] * links)]
    kept = between(lengths, window)
    out, at = [], 0
    for text, length, links in lines:
        if text and kept[at]:
            out.append(text)
        at += 1 if length or not links else links
    return " ".join(out)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row: the main text of the whole page and its code points.

    Null, empty and text-less pages have an empty text. Rows that repeat are extracted each; null page_id and url pass through; ties don't arise; pages of any length are read whole; other columns play no part, whatever their names. An empty table gives no rows.
    """
    ids = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts_of(batch, "html")
            for a, b in slices(whole):
                texts = [extract(x.decode("utf-8", "replace")) if x else "" for x in whole[a:b]]
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in ids.schema.fields}
    return ids.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
