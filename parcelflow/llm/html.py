"""Main text of web pages by tag-path ratios: text and punctuation under each path, smoothed, fused with what tags and names say, against a threshold."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Elements whose content is no text of the page. (Fixed values.)
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas select option textarea button".split())
#: Elements around the article, and forms. (Fixed values.)
BARRED = frozenset("nav header footer aside menu dialog".split())
AROUND = BARRED | {"form"}
#: Elements that run inside a block and give no path of their own. (Fixed values.)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, as far as the nearest element in the second set. (Fixed values.)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Block elements end an open paragraph. (Fixed values.)
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words that class, id and role names use for what stands beside an article. (Fixed values.)
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs cookie cookies consent gdpr disclaimer disclaimers footer footers header headers masthead "
    "menu menus nav navbar navigation newsletter newsletters notice notices notification notifications pagination pager popup popups modal promo promos promoted promotion promotions recommended recommendations related "
    "share sharing sidebar sidebars social sponsor sponsored sponsors subscribe subscription toolbar toolbars widget widgets alert alerts login signup search "
    "comment comments commentlist respond replies disqus".split()
)
#: Words that say where such a node lies or what shape it has, and nothing of what it holds. (Fixed values.)
SHAPE = frozenset(
    "site page global user reader top bottom left right inner outer primary secondary block box bar area section panel slot unit container wrapper wrap group list lists item items row col column button buttons link links icon icons "
    "form field input text title posts articles stories news results center middle full wide sticky fixed float js is".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold short text by their nature. (Fixed values.)
ITEMS = frozenset("li dt dd td th caption figcaption summary pre address blockquote".split())
#: Elements that are parts of a text, and never all of it. (Fixed values.)
PARTS = ITEMS | HEADINGS | frozenset("p ul ol dl table thead tbody tfoot tr figure".split())
#: What a path's score adds for its leaf, by kind, and takes for each element around it that stands beside an article.
FOR_HEADING, FOR_ITEM, FOR_PARAGRAPH, BESIDE_COSTS = 1.5, 1.2, 0.7, 4.0
#: What a path loses if all of it is linked, and if all its marks are exclamation marks (in a plain box, in other elements).
LINKED_COSTS, LOUD_COSTS = 3.0, (3.0, 1.0)
#: How far below the article's own path a score may lie: in the element that holds that path, and elsewhere.
WITHIN, ELSEWHERE = 2.2, 1.0
_PART = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_RAW = {x: re.compile(rf"</{x}\b[^>]*(?:>|$)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe")}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.,;:?。，；：？…]")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def beside(name: str) -> bool:
    """Whether a class, id or role name says that a node stands beside an article.

    All its words have to: one that names a subject ("share-price",
    "social-history") or a relation ("with-sidebar") makes it another name.
    """
    parts = [x for x in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if x]
    return any(x in BESIDE for x in parts) and all(x in BESIDE or x in SHAPE for x in parts)


@dataclass
class Path:
    """A tag path: where it hangs, its depth, how many elements around and in it stand beside an article, whether a tag says so, and the text under it."""

    tag: str
    parent: int
    depth: int
    besides: int
    barred: bool
    blocks: int = 0
    chars: int = 0
    linked: int = 0
    marks: int = 0
    loud: int = 0


@dataclass
class Block:
    """A block of text: the numbers of its path and of the element it lies in, and its pieces with the number of each one's own path, if any."""

    path: int
    element: int
    pieces: list[tuple[str, int, int]]


@dataclass
class _Open:
    tag: str
    path: int
    element: int
    unseen: bool


@dataclass
class Element:
    tag: str
    parent: int
    #: The last element in it; elements are numbered as they open.
    last: int = 0


@dataclass
class Page:
    paths: list[Path] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", 0)])

    def text(self, block: Block, kept: list[bool] | None = None) -> str:
        return " ".join(entities.unescape("".join(t for t, _, p in block.pieces if kept is None or p < 0 or kept[p])).split())


def read(page: str) -> Page:
    """Blocks of text in page order with their tag paths.

    A path has each open block element, with its first class name, and
    inline elements whose name says that they stand beside the article. What
    cannot be seen is left out.
    """
    out = Page()
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    numbers: dict[tuple[int, str, bool], int] = {}
    #: Open inline elements from one that is named or unseen on; what it holds has a path of its own, or none.
    inline: list[str] = []
    inline_path: int | None = None
    held: list[tuple[str, int, int]] = []
    link_depth, unseen = 0, 0

    def path_of(tag: str, name: str, aside: bool) -> int:
        parent = stack[-1].path if stack else -1
        key = (parent, f"{tag}.{name}", aside)
        if key not in numbers:
            above = out.paths[parent] if parent >= 0 else Path("", -1, 0, 0, False)
            numbers[key] = len(out.paths)
            out.paths.append(Path(tag, parent, above.depth + 1, above.besides + aside, above.barred or aside and tag in BARRED))
        return numbers[key]

    def end_block() -> None:
        if held:
            top = stack[-1] if stack else None
            out.blocks.append(Block(top.path if top else path_of("", "", False), top.element if top else 0, held[:]))
            held.clear()
        inline.clear()

    def close(n: int) -> None:
        nonlocal unseen
        end_block()
        for x in stack[n:]:
            unseen -= x.unseen
            open_tags[x.tag] -= 1
            out.elements[x.element].last = len(out.elements) - 1
        del stack[n:]

    def say(text: str) -> None:
        if text and not unseen and not (inline and inline_path is None):
            held.append((text, len(text.strip()) if link_depth else 0, inline_path if inline else -1))

    at, n = 0, len(page)
    while at < n:
        m = _PART.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        given = _attributes(m[3]) if m[3] and not m[1] else {}
        aside = any(beside(x) for k in ("class", "id", "role") for x in given.get(k, "").split()) if given else False
        name = next(iter(given.get("class", "").split()), "")
        out_of_sight = "hidden" in given or "style" in given and bool(_UNSEEN.search(given["style"]))
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if m[1] else 1
            elif tag == "br":
                say(" ")
            if m[1]:
                if inline and inline[-1] == tag:
                    inline.pop()
            elif tag not in VOID and inline:
                if tag == inline[0]:
                    inline.append(tag)
            elif tag not in VOID and (out_of_sight or aside):
                inline_path = None if out_of_sight else path_of(tag, name, True)
                inline.append(tag)
            continue
        if m[1]:
            if open_tags[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            else:
                end_block()
            continue
        if tag in _RAW:
            e = _RAW[tag].search(page, at)
            at = e.end() if e else n
            end_block()
            continue
        if tag in ENDS_P and open_tags["p"] > 0:
            close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"))
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            i = len(stack)
            while i and stack[i - 1].tag not in stop:
                i -= 1
            for j in range(i, len(stack)):
                if stack[j].tag in ends:
                    close(j)
                    break
        end_block()
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        gone = tag in HIDDEN or out_of_sight
        aside = (aside or tag in AROUND and not (tag == "header" and open_tags["article"])) and tag not in ("html", "body", "main", "article")
        unseen += gone
        out.elements.append(Element(tag, stack[-1].element if stack else 0))
        stack.append(_Open(tag, path_of(tag, name, aside), len(out.elements) - 1, gone))
        open_tags[tag] += 1
        if tag in ("article", "section", "div"):
            link_depth = 0
    close(0)
    out.elements[0].last = len(out.elements) - 1
    out.blocks = [b for b in out.blocks if any(t.strip() for t, _, _ in b.pieces) and out.text(b)]
    for b in out.blocks:
        texts: dict[int, list] = {}
        for t, linked, p in b.pieces:
            x = texts.setdefault(b.path if p < 0 else p, [[], 0])
            x[0].append(t)
            x[1] += linked
        for p, (pieces, linked) in texts.items():
            if text := " ".join(entities.unescape("".join(pieces)).split()):
                to = out.paths[p]
                to.blocks += 1
                to.chars += len(text)
                to.linked += min(linked, len(text))
                to.marks += len(_MARKS.findall(text))
                to.loud += text.count("!")
    return out


def _apart(paths: list[Path], a: int, b: int) -> int:
    """Steps from one path up to what both share and down to the other."""
    n = 0
    while a != b and n < 4:
        if b < 0 or a >= 0 and paths[a].depth >= paths[b].depth:
            a = paths[a].parent
        else:
            b = paths[b].parent
        n += 1
    return n


def path_scores(paths: list[Path], blocks: list[int], smooth: int = 2) -> dict[int, float]:
    """Score of each path that has text; ``blocks`` are the paths of the blocks in page order.

    Of each path the text that is not linked and the punctuation, both by
    block, are smoothed with those of the paths of up to ``smooth`` blocks before and after its
    own, each weighed by how near it hangs in the tree. Their logs are added;
    a leaf made for text adds, links, exclamations and elements that stand
    beside the article take.
    """
    ratio = {i: (p.chars - p.linked) / p.blocks for i, p in enumerate(paths) if p.blocks}
    beside_it: dict[int, Counter] = {}
    for k, i in enumerate(blocks):
        near = beside_it.setdefault(i, Counter())
        near.update(j for j in (*blocks[max(0, k - smooth) : k], *blocks[k + 1 : k + 1 + smooth]) if j != i)
    out = {}
    for i in ratio:
        p = paths[i]
        text, points, weight = ratio[i], p.marks / p.blocks, 1.0
        for j, n in beside_it.get(i, {}).items():
            # What stands beside the article lends nothing.
            if j in ratio and paths[j].besides <= p.besides:
                near = 0.5 ** (_apart(paths, i, j) - 1) * n / p.blocks
                text, points, weight = text + near * ratio[j], points + near * paths[j].marks / paths[j].blocks, weight + near
        leaf = FOR_HEADING if p.tag in HEADINGS else FOR_ITEM if p.tag in ITEMS else FOR_PARAGRAPH if p.tag == "p" else 0.0
        loud = 0.0 if p.tag in HEADINGS else LOUD_COSTS[leaf > 0] * p.loud / max(1, p.loud + p.marks)
        out[i] = math.log1p(text / weight) + 0.5 * math.log1p(points / weight) + leaf - LINKED_COSTS * p.linked / p.chars - loud - BESIDE_COSTS * p.besides
    return out


def _own(p: Path) -> float:
    """A path's score from its own text alone."""
    return path_scores([p], [0])[0]


def _holder(page: Page, blocks: list[Block]) -> int:
    """The innermost element around all the blocks that is no mere part of a text."""
    least, most = min(b.element for b in blocks), max(b.element for b in blocks)
    at = least
    while at and (page.elements[at].last < most or page.elements[at].tag in PARTS or len(blocks) == 1 and at == least):
        at = page.elements[at].parent
    return at


def main_text(page: str | None) -> str:
    """Text of the article: its blocks in page order, joined by two line breaks.

    The path with the best score for its amount of text, if no tag says that
    it stands beside the article, is the article's own; the innermost element
    around all its blocks holds the article. In there
    paths pass that score nearly as well; before it, so do those from the
    headline on; elsewhere a path has to score as well by its own text. Blocks lose the pieces whose
    path does not pass. Null, empty and text-free pages give an empty text.
    """
    got = read(page or "")
    if not got.blocks:
        return ""
    scores = path_scores(got.paths, [b.path for b in got.blocks])
    able = {b.path for b in got.blocks if not got.paths[b.path].barred} & scores.keys()
    if not able:
        return ""
    main = max(able, key=lambda i: (scores[i] + 0.5 * math.log(got.paths[i].chars), -i))
    best = scores[main]
    holder = _holder(got, [b for b in got.blocks if b.path == main])
    inside = [holder <= b.element <= got.elements[holder].last for b in got.blocks]
    first = inside.index(True)
    # The headline may stand before the element that holds the text.
    start = max((i for i in range(first) if got.paths[got.blocks[i].path].tag == "h1" and got.paths[got.blocks[i].path].besides <= got.paths[main].besides), default=first)
    while start and got.paths[got.blocks[start - 1].path].tag in HEADINGS and got.paths[got.blocks[start - 1].path].besides <= got.paths[main].besides:
        start -= 1
    near = [s >= best - WITHIN for s in (scores.get(i, -math.inf) for i in range(len(got.paths)))]
    far = [ok and _own(p) >= _own(got.paths[main]) - ELSEWHERE for ok, p in zip(near, got.paths, strict=True)]
    parts = []
    for i, b in enumerate(got.blocks):
        kept = near if inside[i] or start <= i < first else far
        if kept[b.path] and (text := got.text(b, kept)):
            parts.append(text)
    return "\n\n".join(parts)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each row in ``text_col``, never null.

    All rows stay, repeated ones too; a column named ``text_col`` is
    replaced, others stay whatever their names. Null and empty pages and
    pages without text give an empty text. Pages are read whole, in time
    that grows with their length; an unclosed element or comment
    ends with the page, and a tag whose quote is never closed is text. An empty table stays empty.
    """

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        # One page at a time is a Python string.
        return pa.array((main_text(x.as_py()) for x in pages), pa.string())

    return pages.withColumn(text_col, text(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    col = fresh(pages, "text")
    return extract(pages, text_col=col).select("page_id", "url", F.col(col).alias("text"), F.length(col).cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
SQL: dict[str, str] = {}
