"""Main text of web pages by two-pass block rules.

A page becomes blocks (runs of text between block-level tags). Scripts, styles and forms are left out, and elements that say
by tag, class, id or role that they are menus, headers, footers, sidebars, notices, adverts or comments.

The first pass decides blocks by stop-word density, length and share of text in links; short blocks, headings and those of
middling density stay open. In the second pass open blocks inherit the label of the nearest decided block, the earlier one on
a tie, headings that of the next decided one; bad if there is none.

An article or main element is context. It is believed if the first pass finds as much good text in it as outside: then
nothing outside is good, and within it no block is bad by its links or its lack of stop words alone (references, code, tables);
such blocks stay open, and are good if no block is decided. Otherwise the page is judged as if it had none. On a page without
any block of at least SHORT characters and density STOP_LOW, in a language whose stop words aren't known, length and links
decide alone. Known are English, German, French and Spanish.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Function words of the languages that the rules know.
STOP_WORDS = frozenset(
    "the of and a to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if will each about how up out them then she many some so these would other into has her two him see time could no than been who its now did get may over "
    "der die das und ist von mit den im zu auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de des et est un une en du que qui dans pour pas au sur se ne par plus ce il avec son sa ou comme mais nous vous ils elle sont été leur aux ses cette "
    "el los las y del se por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without text of the page: code, and what stands in forms.
RAW_TAGS = frozenset("script style title textarea select button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|banner|promo\w*|sponsor\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|newsletter|subscribe|signup|login|popup|modal|overlay|comments?|commentlist|disqus|footer|copyright)(?=$|[\s_-])", re.I
)
#: Names that may mean boilerplate: they do outside an article, and in it where most of the text is links.
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:alert|respond|replies|share|sharing|social|related|recommend\w*|widgets?|pagination|pager|toolbar|skip)(?=$|[\s_-])", re.I)
#: Names of page heads; inside an article they hold its title.
HEAD_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.25, 0.35

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NOTICE = re.compile(r"(?:\W*copyright\b|©|\(c\)|.*all rights reserved)", re.I)
_WORDS = re.compile(r"\w+")
# Start tags that end an open element of these names, as HTML leaves their end tags out.
_CLOSES = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _role(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether its name makes that possible."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside:
        return True, False
    if tag in ("html", "body", "article", "main") or not attributes:
        return False, False
    doubtful = False
    for name, *value in _ATTRIBUTE.findall(attributes):
        value = "".join(value)
        if name.lower() == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return True, False
        elif BOILERPLATE_NAMES.search(value) or not inside and (HEAD_NAMES.search(value) or DOUBTFUL_NAMES.search(value)):
            return True, False
        else:
            doubtful |= bool(DOUBTFUL_NAMES.search(value))
    return False, doubtful


class Block(NamedTuple):
    """A run of text between block-level tags: characters in links, nearest block-level tag, and where it stands."""

    text: str
    links: int
    tag: str
    main: bool
    bad: bool
    doubtful: bool


class _Open(NamedTuple):
    """An open element and what holds inside it; block and block_bad are those of the nearest block-level one."""

    tag: str
    main: bool
    bad: bool
    doubtful: bool
    block: str
    block_bad: bool


_TOP = _Open("", False, False, False, "", False)


def blocks_of(html: str) -> list[Block]:
    """The blocks that have text. Time is linear in the page, however deep elements nest and whether they are closed or not."""
    found: list[Block] = []
    stack: list[_Open] = [_TOP]
    count: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    links, anchors, at = 0, 0, 0

    def flush() -> None:
        nonlocal links, parts
        if parts:
            text, own = " ".join("".join(parts).split()), stack[-1]
            if text:
                found.append(Block(text, min(links, len(text)), own.block, own.main, own.block_bad, own.doubtful))
            parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if stack[-1].bad and not stack[-1].block_bad:
            return  # boilerplate within a line of text
        text = unescape(raw)
        parts.append(text)
        if anchors:
            links += len(" ".join(text.split()))

    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if not close and tag in RAW_TAGS and not (tag == "title" and stack[-1].main):
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if close else 1))
            continue
        if tag in VOID_TAGS and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS:
            flush()
            anchors = 0
        if close:
            if count[tag]:
                while (gone := stack.pop().tag) != tag:
                    count[gone] -= 1
                count[tag] -= 1
        elif tag not in VOID_TAGS and not attributes.endswith("/"):
            while stack[-1].tag in _CLOSES and tag in _CLOSES[stack[-1].tag]:
                count[stack.pop().tag] -= 1
            up, block = stack[-1], tag in BLOCK_TAGS
            bad, doubtful = _role(tag, attributes, up.main)
            bad |= up.bad
            stack.append(_Open(tag, up.main or tag in MAIN_TAGS, bad, doubtful or up.doubtful, tag if block else up.block, bad if block else up.block_bad))
            count[tag] += 1
    if at < len(html):
        add(html[at:])
    flush()
    return found


_HEADING = re.compile("h[1-6]")


def density_of(text: str) -> float:
    """Share of stop words among the words."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list[Block], density: list[float], inside: bool, known: bool = True) -> list[tuple[bool | None, str]]:
    """Label (None: open) and the rule that gave it, for blocks that all stand inside a believed article, or outside one.

    density: of stop words, for blocks of at least SHORT characters. known: whether the page's language has stop words here.
    """
    out: list[tuple[bool | None, str]] = []
    for b, d in zip(blocks, density, strict=True):
        n, links = len(b.text), b.links / max(1, len(b.text))
        if links > LINKS and not inside:
            out.append((False, "links"))
        elif n < SHORT or _HEADING.fullmatch(b.tag):
            out.append((False, "short with links") if not inside and (b.links or _NOTICE.match(b.text)) else (None, "short"))
        elif links > LINKS:
            out.append((None, "links in article"))
        elif not known:
            out.append((True, "long, no stop words known") if n > LONG and not b.links else (None, "no stop words known"))
        elif d >= STOP_HIGH:
            out.append((True, "stop words") if n > LONG or not b.links else (None, "links in short text"))
        elif d >= STOP_LOW or inside:
            out.append((None, "few stop words"))
        else:
            out.append((False, "no stop words"))
    return out


def second_pass(first: list[bool | None], heading: list[bool], alone: bool = False) -> list[bool]:
    """Open blocks take the label of the nearest decided one; alone: what they are where none is decided."""
    last = len(first) - 1
    ahead, behind = [-1] * len(first), [-1] * len(first)
    for i, x in enumerate(first):
        behind[i] = i if x is not None else behind[i - 1] if i else -1
    for i in range(last, -1, -1):
        ahead[i] = i if first[i] is not None else ahead[i + 1] if i < last else -1
    out = []
    for i, x in enumerate(first):
        if x is None:
            b, a = behind[i], ahead[i]
            near = a if heading[i] and a >= 0 else b if a < 0 or b >= 0 and i - b <= a - i else a
            x = bool(first[near]) if near >= 0 else alone
        out.append(x)
    return out


def decide(blocks: list[Block]) -> list[tuple[bool, str]]:
    """Which blocks belong to the main text, and by which rule."""
    bad = [b.bad or b.doubtful and b.links > LINKS * len(b.text) for b in blocks]  # menus, in an article too
    free = [i for i, x in enumerate(bad) if not x]
    density = {i: density_of(blocks[i].text) if len(blocks[i].text) >= SHORT else 0.0 for i in free}
    known = any(d >= STOP_LOW for d in density.values())
    judge = lambda rows, inside: first_pass([blocks[i] for i in rows], [density[i] for i in rows], inside, known)
    good = lambda rows, labels: sum(len(blocks[i].text) for i, (x, _) in zip(rows, labels, strict=True) if x)
    main, rest = ([i for i in free if blocks[i].main == side] for side in (True, False))
    first, other = judge(main, True), judge(rest, False)
    article = bool(main) and good(main, first) >= good(rest, other)
    judged = main if article else free
    if not article:
        first = judge(free, False) if main else other
    final = second_pass([x for x, _ in first], [bool(_HEADING.fullmatch(blocks[i].tag)) for i in judged], article)
    out = [(False, "boilerplate" if x else "outside the article") for x in bad]
    for i, (x, rule), keep in zip(judged, first, final, strict=True):
        out[i] = keep, rule if x is not None else f"inherited: {rule}"
    return out


def main_text(html: str | None) -> str:
    """The main text's blocks, joined by two line ends; empty if there is none."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, (keep, _) in zip(blocks, decide(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, repeats included. Null or empty html: empty text. Pages of any length and
    nesting are read whole, in time linear in their length. No rows give no rows; other columns don't matter."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches(it):
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(C.quoted(id_col)).cast("long").alias("page_id"), F.col(C.quoted(url_col)).cast("string").alias("url"), F.col(C.quoted(html_col)).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(C.table(spark, sf_dir, "pages"))
