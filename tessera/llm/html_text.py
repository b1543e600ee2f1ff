"""Main text of web pages by two passes of block rules.

A page is read once, tag by tag, into blocks (paragraphs, headings, list items,
table rows). Scripts, styles and other non-text, and containers that say what
they are (menus, forms, notices and the like, by element, role, class or id),
give no blocks. Pass one decides blocks by link density, length and stop-word
density; short blocks, and long ones inside an article that the densities do not
settle, stay open. In pass two an open block takes the label of the nearest
decided block, before or after; with none decided, the place decides.

Defined results: null and empty pages have an empty text; broken markup is read
as far as it makes sense, and a container that is never closed is no container;
repeated rows are read each for itself; extra columns are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that was for on are with as by be this at from or an have not he his they which but you all were we there can had has
    de la le les et des en un une du que est pour qui dans par plus pas au sur se ne ce il sont avec elle ou mais son sa aux cette
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    el los las y del se con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay
    """.split()
)
# Elements that hold no text of the page.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "canvas", "audio", "video")
# Elements that are never the article.
APART = frozenset("head nav footer aside form menu dialog select button fieldset".split())
# Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html
    legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul""".split()
)
# Elements that are kept on the stack, since they hold blocks.
CONTAINERS = frozenset("article aside blockquote body button center details dialog div dl fieldset figure footer form head header main menu nav ol section select table ul".split())
# Words in a class or id that tell what a container is for.
HINTS = frozenset(
    """ad ads advert advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal
    overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social menu nav navbar navigation
    breadcrumb breadcrumbs pagination pager toolbar footer header masthead topbar comment comments respond replies disqus copyright disclaimer paywall teaser""".split()
)
# Roles that tell the same.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(SILENT)})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[^\W\d_]+")

SHORT_CHARS = 70
MAX_LINK_DENSITY = 0.4
MIN_STOP_DENSITY = 0.12


@dataclass
class Block:
    text: str
    linked: int  #: characters of it inside links
    inside: bool  #: in an article or main element
    heading: bool


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    if tag in APART:
        return True
    if tag == "header":
        return not inside
    if tag in ("html", "body", "main") or not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for name, value in MARK.findall(attributes):
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        if name.lower() == "role":
            if words & ROLES:
                return True
        elif (found := words & HINTS) and not (inside and found <= {"header"}):
            return True
    return False


def blocks_of(html: str) -> tuple[list[Block], bool]:
    """Blocks of a page in order, and whether it has an article or main element."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool]] = []  # containers, and whether each one starts what is apart
    apart = inside = links = 0
    has_article = heading = False
    lowered = None

    def close() -> None:
        nonlocal heading
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(" ".join(unescape("".join(linked)).split())), inside > 0, heading))
            parts.clear()
            linked.clear()
        heading = False

    last = 0
    for m in TOKEN.finditer(html):
        if not apart and m.start() > last:
            parts.append(html[last : m.start()])
            if links:
                linked.append(parts[-1])
        last = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br" or tag in ("td", "th"):
            if not apart and parts:
                parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in CONTAINERS:
            continue
        if tag in BLOCKS:
            close()
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag == "body" and not closing:  # a head that was not closed
            stack, apart = [], 0
        if tag == "title" and not apart and not closing:
            lowered = lowered or html.lower()
            end = lowered.find("</title", last)
            if end >= 0:
                stack.append((tag, True))
                apart += 1
            continue
        if tag not in CONTAINERS and tag != "title":
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack:
                    top, starts = stack.pop()
                    apart -= starts
                    inside -= top in ("article", "main")
                    if top == tag:
                        break
        elif not attributes.endswith("/"):
            starts = _apart(tag, attributes, inside > 0)
            if starts:
                lowered = lowered or html.lower()
                starts = lowered.find(f"</{tag}", last) >= 0
            stack.append((tag, starts))
            apart += starts
            if tag in ("article", "main"):
                inside += 1
                has_article = has_article or not apart
    if not apart and last < len(html):
        tail = html[last:]
        cut = re.search(r"<[a-z/!][^<>]*\Z", tail, re.I)  # a tag that was cut off
        parts.append(tail[: cut.start()] if cut else tail)
    close()
    return out, has_article


def decide(blocks: list[Block], has_article: bool) -> list[bool]:
    """Which blocks are main text."""
    labels: list[bool | None] = []
    for b in blocks:
        size = len(b.text)
        if b.linked > MAX_LINK_DENSITY * size and not b.heading and (size < 3 * SHORT_CHARS or not b.inside):
            labels.append(False)
        elif size < SHORT_CHARS:
            labels.append(None)
        else:
            found = WORD.findall(b.text.lower())
            dense = sum(w in STOP_WORDS for w in found) >= MIN_STOP_DENSITY * max(len(found), 1)
            if has_article and not b.inside:
                labels.append(False)
            elif dense:
                labels.append(True)
            else:
                labels.append(None)
    # pass two: the nearest decided block; of two as near, a good one
    n = len(blocks)
    before: list[int] = [-1] * n
    after: list[int] = [-1] * n
    at = -1
    for i in range(n):
        at = i if labels[i] is not None else at
        before[i] = at
    at = -1
    for i in range(n - 1, -1, -1):
        at = i if labels[i] is not None else at
        after[i] = at
    out = []
    for i, label in enumerate(labels):
        if label is None:
            p, q = before[i], after[i]
            if has_article and blocks[i].inside:  # only its own article's blocks are its neighbours
                p = p if p >= 0 and blocks[p].inside else -1
                q = q if q >= 0 and blocks[q].inside else -1
            if p < 0 and q < 0:
                label = blocks[i].inside or not has_article
            elif p < 0 or q < 0:
                label = bool(labels[max(p, q)])
            elif i - p == q - i:
                label = bool(labels[p] or labels[q])
            else:
                label = bool(labels[p] if i - p < q - i else labels[q])
            if has_article and not blocks[i].inside:
                label = False
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks, has_article = blocks_of(html)
    return "\n".join(b.text for b, good in zip(blocks, decide(blocks, has_article), strict=True) if good)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, rows: int = 512) -> DataFrame:
    """The main text of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(run, SCHEMA)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
