"""Main text of web pages by tag-path ratios.

Each page is one row, so a task works page by page and nothing is shuffled:

1. ``parsed`` walks the markup into blocks of text with their root-to-leaf tag paths, kept as a tree of paths. Markup
   that browsers repair is repaired alike where it matters: unclosed paragraphs and list items, stray end tags, a cut-off
   last tag. Scripts, styles, form controls and hidden elements hold no text.
2. Text length, punctuation, link text and block counts are summed for each path. A path's ratios (``path_ratios``) are
   its density, log(1 + characters a block) * log(2 + punctuation marks a block), and the share of its text outside links.
   Density stops to grow at ``FULL_CHARS`` and ``FULL_MARKS``: a paragraph is no more of an article for being long.
3. Smoothing: the paths of one box (headings, paragraphs, lists, tables and figures of one div, section or body) are each
   other's neighbourhood. Its value is that of all their text, log(1 + characters) * log(2 + marks) outside links; a box takes
   at least ``INSIDE`` of the value of the box around it, and of the page's best where it lies in ``article`` or ``main``, by
   the share of the page's text there. Own density and neighbourhood, as shares of the fullest, are fused by a weighted mean,
   times the path's share outside links, times ``HINT`` for each element (``HINTS`` at most) whose tag, role, class or id
   speaks of page furniture. A form, or a word in the class of a wrapper, around all of the page's text changes nothing.
4. Paths at or above ``THRESHOLD`` of the best fused value are content, and their blocks are the text, if the best
   neighbourhood has ``FLOOR``. Two kinds of paths that no word speaks against join them: headings right before content, and
   links in a box whose text is content (a paragraph of its own, anything in ``article``, or between blocks of content).

Every step is linear in the markup, so a page of any length or depth costs in proportion. Null or empty html, or no
content, gives the empty text. Ties need no rule: equal paths are one path. Repeated rows give equal results, an empty
table an empty one; other columns make no difference.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.55
FLOOR = 0.3
HINT, HINTS = 0.08, 2
INSIDE = 0.75
FULL_CHARS, FULL_MARKS = 160, 3
#: Share of the neighbourhood in the fused value.
AROUND = 0.75

# Element names of HTML, and class or id words of page furniture.
_BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noembed noframes title textarea svg math object audio video canvas xmp select button".split())
_ENDS_P = _BLOCKS - frozenset("body head html button option select legend summary td th tr tbody thead tfoot".split())
_ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CELLS = frozenset("tr td th".split())
_SCOPES = frozenset("article aside body button details dialog div dl fieldset figure footer form header html main nav ol section table td th ul".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
_HEADINGS = _LEAVES - {"p"}
#: Elements that are part of the box around them.
_PARTS = _LEAVES | frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address center details summary hgroup dir".split())
_FURNITURE = frozenset("footer aside menu dialog header nav".split())
_FORMS = frozenset("form fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: A class name with one of these speaks of furniture.
_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter overlay pager paginate pagination popup promo promoted promotion promotions recommended related shoutbox sidebar sidebars signup sponsor sponsored subscribe subscription tagcloud toolbar topbar".split())
#: A class name made of these and the words above alone does, too.
_WEAK = frozenset("alert alerts banner discussion feedback login notice notices notification privacy replies reply respond responses search share sharing skip social widget widgets".split())
_HEADER_WORDS = frozenset("header hdr".split())
#: A class name with one of these speaks of the layout around furniture.
_NEUTRAL = frozenset("has with no without not is layout".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡]")
_VALUE = re.compile(r"""=\s*+("[^"]*+"|'[^']*+')""")
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile("[a-z]+")
_CAMEL = re.compile("([a-z])([A-Z])")


@dataclass(slots=True)
class _Open:
    """An open element; ``counts``: open elements by name since the last scope, shared by that scope's elements."""

    name: str
    path: int
    hidden: bool
    counts: Counter


@dataclass(slots=True)
class Page:
    """Blocks in order as (path, text), and the tree of paths: each path's parent comes before it."""

    blocks: list[tuple[int, str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    hints: list[float] = field(default_factory=lambda: [0])
    soft: list[float] = field(default_factory=lambda: [0])
    article: list[bool] = field(default_factory=lambda: [False])
    box: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    sums: list[list[int]] = field(default_factory=lambda: [[0, 0, 0, 0]])
    known: dict[tuple[int, str, bool], int] = field(default_factory=dict)

    def path(self, parent: int, name: str, label: str, soft: bool) -> int:
        """The path below ``parent``; ``soft``: role, class or id speak of furniture."""
        at = self.known.get((parent, label, soft))
        if at is None:
            at = self.known[parent, label, soft] = len(self.parent)
            firm = name in _FURNITURE and not (name == "header" and self.article[parent])
            size = 0.5 if name in _LEAVES else 1
            self.parent.append(parent)
            self.hints.append(self.hints[parent] + size * (soft or firm))
            self.soft.append(self.soft[parent] + size * (soft and not firm))
            self.article.append(self.article[parent] or name in ("article", "main"))
            self.box.append(self.box[parent] if name in _PARTS else at)
            self.name.append(name)
            self.sums.append([0, 0, 0, 0])
        return at


def _speaks_of_furniture(names: str, in_article: bool) -> bool:
    for name in names.split():
        words = set(_WORD.findall(_CAMEL.sub(r"\1 \2", name).lower()))
        strong = words & _WORDS or words & _HEADER_WORDS and not in_article
        if words and not words & _NEUTRAL and (strong or words <= _WORDS | _WEAK):
            return True
    return False


def _described(name: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """(label, furniture by role, class or id, hidden) of a start tag."""
    furniture = name in _FORMS
    if "=" not in attributes and "hidden" not in attributes:
        return name, furniture, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    own = f"{found.get('class', '')} {found.get('id', '')}".strip()
    style = found["style"].replace(" ", "").lower() if "style" in found else ""
    hidden = "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden") == "true"
    hidden |= "hidden" in attributes and bool(_BARE_HIDDEN.search(_VALUE.sub("", attributes)))
    furniture |= "role" in found and found["role"].lower() in _ROLES
    if not own:
        return name, furniture, hidden
    furniture |= name not in ("html", "body") and _speaks_of_furniture(own, in_article)
    return f"{name}.{_DIGITS.sub('', own)}", furniture, hidden


def parsed(markup: str) -> Page:
    """The blocks of a page and its paths."""
    page, text = Page(), []
    stack = [_Open("", 0, False, Counter())]
    everywhere: Counter = Counter()
    links = at = 0

    def flush() -> None:
        nonlocal links
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                path = stack[-1].path
                page.blocks.append((path, whole))
                sums = page.sums[path]
                for k, x in enumerate((1, len(whole), len(_PUNCTUATION.findall(whole)), min(links, len(whole)))):
                    sums[k] += x
            text.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece and not stack[-1].hidden:
            text.append(piece)
            if everywhere["a"]:
                links += len(piece)

    def pop_to(k: int) -> None:
        if any(e.name in _BLOCKS for e in stack[k:]):
            flush()
        for e in stack[k:]:
            everywhere[e.name] -= 1
            stack[k - 1].counts[e.name] -= e.counts is stack[k - 1].counts
        del stack[k:]

    def close(names: set[str], stop: frozenset[str]) -> bool:
        """Pop to the innermost of ``names`` unless one of ``stop`` comes before it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                pop_to(k)
                return True
            if stack[k].name in stop:
                break
        return False

    while tag := _TAG.search(markup, at):
        say(markup[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name or tag[0][-1] != ">":
            continue
        if tag[1] or tag[4]:
            if name in _SCOPES:
                if everywhere[name]:
                    close({name}, frozenset())
            elif stack[-1].counts[name] or name in _CELLS and everywhere[name]:
                close({name}, _SCOPES)
        elif name == "br":
            text.append(" ")
        elif name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(markup, at)
            at = end.end() if end else len(markup)
            if name == "button":
                flush()
        elif name in _VOID:
            if name == "hr":
                flush()
        else:
            if name in _ENDS_P and stack[-1].counts["p"]:
                close({"p"}, _SCOPES)
            if name in _CELLS:
                while any(everywhere[x] for x in _ENDS_SELF[name]) and close(_ENDS_SELF[name], _SCOPES - _CELLS):
                    pass
            elif name in _ENDS_SELF and any(stack[-1].counts[x] for x in _ENDS_SELF[name]):
                close(_ENDS_SELF[name], _SCOPES)
            top = stack[-1]
            label, furniture, hidden = _described(name, tag[3] or tag[6] or "", page.article[top.path])
            if name in _BLOCKS:
                flush()
                path = page.path(top.path, name, label, furniture)
            else:
                path = top.path
            new = _Open(name, path, top.hidden or hidden, Counter() if name in _SCOPES else top.counts)
            if new.counts is top.counts:
                top.counts[name] += 1
            everywhere[name] += 1
            stack.append(new)
    say(markup[at:])
    flush()
    return page


def path_ratios(blocks: int, chars: int, marks: int, linked: int) -> tuple[float, float]:
    """A path's density and its share of text outside links."""
    return math.log1p(min(FULL_CHARS, chars / blocks)) * math.log(2 + min(FULL_MARKS, marks / blocks)), 1 - linked / chars


def _neighbourhoods(page: Page, own: list[int], weight: dict[int, float], share: float) -> dict[int, float]:
    """The value of each box with text, from that of its own paths and of the boxes around it."""
    near: dict[int, list[float]] = {}
    for p in own:
        blocks, chars, marks, linked = page.sums[p]
        sums, free = near.setdefault(page.box[p], [0.0, 0.0]), (1 - linked / chars) * weight[p]
        sums[0] += chars * free
        sums[1] += marks * free
    value = {c: math.log1p(chars) * math.log(2 + marks) for c, (chars, marks) in near.items()}
    top = max(value.values())
    full = [0.0] * len(page.parent)
    for c in range(len(full)):  # a box comes after the one around it
        if page.box[c] == c:
            around = full[page.box[page.parent[c]]] if c else 0.0
            full[c] = max(value.get(c, 0.0), INSIDE * around, INSIDE * share * top * page.article[c])
    return {c: full[c] for c in value}


def _joining(page: Page, chosen: set[int], hints: dict[int, float]) -> set[int]:
    """Paths that belong to the content around them: headings before it, and links within its boxes."""
    most = max((hints[p] for p in chosen), default=0)
    text, near, first, last = Counter(), Counter(), {}, {}
    for p in hints:
        near[page.box[p]] += page.sums[p][1]
        text[page.box[p]] += page.sums[p][1] * (p in chosen)
    for k, (p, _) in enumerate(page.blocks):
        if p in chosen:
            first.setdefault(page.box[p], k)
            last[page.box[p]] = k
    out, follows = set(), False
    for k in range(len(page.blocks) - 1, -1, -1):
        p = page.blocks[k][0]
        if p in chosen or p in out or hints[p] > most:
            follows = p in chosen or p in out
            continue
        box, linked = page.box[p], 2 * page.sums[p][3] > page.sums[p][1]
        inside = 2 * text[box] >= near[box] and text[box] > 0
        between = inside and first[box] < k < last[box]
        if page.name[p] in _HEADINGS and follows and not linked or inside and (page.name[p] == "p" or page.article[p] or between):
            out.add(p)
            follows = True
        else:
            follows = False
    return out


def main_text(markup: str | None) -> str:
    page = parsed(markup or "")
    if not page.blocks:
        return ""
    own = [p for p in range(len(page.parent)) if page.sums[p][0]]
    around = min(page.soft[p] for p in own)  # of wrappers around all of the page
    hints = {p: page.hints[p] - around for p in own}
    least = min(hints.values())
    unlinked = {p: page.sums[p][1] - page.sums[p][3] for p in own if hints[p] == least}
    share = sum(x for p, x in unlinked.items() if page.article[p]) / max(1, sum(unlinked.values()))
    weight = {p: HINT ** min(HINTS, hints[p]) for p in own}
    around_it = _neighbourhoods(page, own, weight, share)
    ratios = {p: path_ratios(*page.sums[p]) for p in own}
    top, fullest = max(around_it.values()), max(d for d, _ in ratios.values())
    if top < FLOOR or not fullest:
        return ""
    fused = {p: ((1 - AROUND) * density / fullest + AROUND * around_it[page.box[p]] / top) * free * weight[p] for p, (density, free) in ratios.items()}
    least_value = THRESHOLD * max(fused.values())
    chosen = {p for p in own if fused[p] >= least_value > 0}
    chosen |= _joining(page, chosen, hints)
    return "\n".join(text for p, text in page.blocks if p in chosen)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
