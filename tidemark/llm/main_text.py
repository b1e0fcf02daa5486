"""Main text of raw pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: menus, page headers and footers, sidebars, notices, adverts,
forms, hidden parts and reader comments (by tag, role or a word of class and id), and blocks that are mostly links, are
decided as boilerplate; blocks inside an article or main element that hold stop words or are long enough are decided as
text; elsewhere length and stop-word density decide. Short or stop-word-poor blocks and headings stay open. Second pass:
an open block takes the label of its nearest decided neighbours; where they differ, the nearer one's, and at equal
distance the label its own stop words speak for. Inside an article the article's own ends count as text, elsewhere the
page's ends count as boilerplate. If a page has an article or main element with words, nothing outside it is text.

Null and empty pages give an empty text. Unclosed or stray tags, comments without an end and lone ``<`` signs are read as
browsers do. Repeated rows are treated alike; other columns are not read. Pages are parsed one by one in their task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element kinds of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED_END = frozenset("p li dt dd td th tr option".split())
# Elements and roles that never hold the article, and words of class or id that name such parts.
ASIDE_TAGS = frozenset("nav footer aside form menu button select svg canvas object audio video map dialog search head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "respond disqus replies widget pagination pager toolbar copyright disclaimer skip".split())

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on are as with his they at be this have from or had by not but what all were when we "
    "there can an your which their if will he she has been who its "
    "der die das und ist von den mit zu ein eine einer des im dem nicht sich auf für auch es an als aus bei nach wird sind oder um "
    "war wie am haben durch nur noch "
    "le la les de des du et est un une que qui dans pour pas sur par avec ce il elle sont au aux plus ne se ou mais son sa ses on "
    "nous vous leur été "
    "el los las y en del se por con una para su al lo como más pero sus este ya o fue ha muy sin sobre también me hasta hay donde "
    "desde todo".split())

SHORT_CHARS = 70
LONG_CHARS = 200
LINKED = 0.5
STOPS_LOW = 0.10
STOPS_HIGH = 0.25

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"\w+")

TEXT, BOILERPLATE, OPEN = 1, 0, None


class _Block:
    __slots__ = ("parts", "linked", "aside", "article", "heading")

    def __init__(self, aside: bool, article: bool, heading: bool) -> None:
        self.parts, self.linked, self.aside, self.article, self.heading = [], 0, aside, article, heading


def _is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    names: set[str] = set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key in ("class", "id"):
            names.update(x.lower() for x in _NAME_PART.findall(value))
        elif (key == "role" and value.strip().lower() in ASIDE_ROLES) or (key == "aria-hidden" and value == "true") or (
                key == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return True
    return bool(names & ASIDE_WORDS) and not (tag == "article" and "comment" not in names and "comments" not in names) and not names & {"article", "entry", "story"}


def blocks(page: str) -> list[_Block]:
    """Blocks in page order, each with its marks."""
    out: list[_Block] = []
    aside: list[list] = []  # [tag, depth] of the outermost part that is no article
    article = link = breaks = 0
    heading, block = False, None
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal block, breaks
        if not piece:
            return
        piece = entities.unescape(piece)
        if block is None:
            if not piece.strip():
                return
            block = _Block(bool(aside), article > 0, heading)
            out.append(block)
        block.parts.append(piece)
        if piece.strip():
            breaks = 0
            if link:
                block.linked += len("".join(piece.split()))

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if page.startswith("<!--", start):
            text(page[at:start])
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            text(page[at:start])
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, start)
        if found is None:
            end = page.find(">", start)
            if end < 0 or not re.match(r"</?[a-zA-Z]", page[start : start + 3]):
                text(page[at : start + 1])
                at = start + 1
                continue
            found = re.match(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[start : end + 1])
            text(page[at:start])
            at = end + 1
        else:
            text(page[at:start])
            at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in RAW_TAGS:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = size if end is None else end.end()
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                block = None
            elif block is not None:
                block.parts.append(" ")
            continue
        if tag in VOID_TAGS and tag != "hr":
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in BLOCK_TAGS:
            block, breaks = None, 0
            if tag in HEADING_TAGS:
                heading = not closing
        if aside and not closing and (aside[0][0] == tag and tag in IMPLIED_END or aside[0][0] == "p" and tag in BLOCK_TAGS):
            aside.clear()  # the start of this element ends the open one
        if aside:
            if tag == aside[0][0]:
                aside[0][1] += -1 if closing else 1
                if aside[0][1] <= 0:
                    aside.clear()
                    block = None
            elif closing and tag in ("body", "html"):
                aside.clear()
        elif not closing and not attributes.rstrip().endswith("/") and _is_aside(tag, attributes, article > 0):
            aside.append([tag, 1])
            block = None
        if tag in ("article", "main") and not aside:
            article = max(0, article + (-1 if closing else 1))
    return out


def _first_pass(block: _Block, text: str) -> int | None:
    chars = len(text) - text.count(" ")
    if block.aside or (block.linked > LINKED * chars):
        return BOILERPLATE
    words = [w.lower() for w in _WORD.findall(text)]
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if block.heading:
        return OPEN
    if block.article:
        return TEXT if stops >= STOPS_LOW or len(text) >= LONG_CHARS else OPEN
    if len(text) < SHORT_CHARS:
        return OPEN
    if stops >= STOPS_HIGH or (stops >= STOPS_LOW and len(text) >= LONG_CHARS):
        return TEXT
    return OPEN if stops >= STOPS_LOW else BOILERPLATE


def _second_pass(labels: list[int | None], texts: list[str], ends: int) -> list[int]:
    before: list[tuple[int, int]] = []
    near = (ends, -1)
    for i, label in enumerate(labels):
        near = near if label is None else (label, i)
        before.append(near)
    out, near = [0] * len(labels), (ends, len(labels))
    for i in range(len(labels) - 1, -1, -1):
        near = near if labels[i] is None else (labels[i], i)
        (a, x), (b, y) = before[i], near
        if a == b or i - x < y - i:
            out[i] = a
        elif i - x > y - i:
            out[i] = b
        else:
            out[i] = int(any(w.lower() in STOP_WORDS for w in _WORD.findall(texts[i])))
    return out


def main_text(page: str | None) -> str:
    """The article of one page, blocks joined by a line feed."""
    found = [(b, t) for b in blocks(page or "") if (t := " ".join("".join(b.parts).split()))]
    inside = [(b, t) for b, t in found if b.article and not b.aside]
    chosen = inside or found
    labels = [_first_pass(b, t) for b, t in chosen]
    kept = _second_pass(labels, [t for _, t in chosen], TEXT if inside else BOILERPLATE)
    return "\n".join(t for (_, t), label in zip(chosen, kept, strict=True) if label)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep..., text: the main text of every page, in batches."""
    rows = pages.select(*keep, F.col(html_col).alias("whole page"))
    out = T.StructType([*rows.drop("whole page").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [f.name for f in out])

    return rows.mapInArrow(run, out)
