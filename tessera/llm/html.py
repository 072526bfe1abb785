"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at block-level tags.  The first pass decides
what it can from each block's length, link density and share of stop words;
parts that are marked as asides are bad, and short or middling blocks stay open.
A mark is a tag, a whole name in class or role (in id, where it names a common
part of a page), or a part of a compound one; the last kind gives way if no other
block of the page is good.  On headings names are no marks, and what else a
paragraph's or section's name says, an id above all, which may be a slug of its
heading, needs a second sign: links, or few stop words.
The second pass gives each open block the label of its nearest decided
neighbours.  <article> and <main> are evidence for it only: neighbours are
sought within the same one, and its end counts as no neighbour if it holds a
good block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, table

# Tags that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Parts of a page that are never its main text, by tag.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button select iframe object svg template".split())
SKIPPED = "head|script|style|noscript|textarea|title|svg|template|iframe|object|math"
# The same by class, id or role.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header masthead menu modal nav"
    " navbar navigation newsletter notice notices popup promo promoted related replies respond search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget contentinfo complementary alert".split()
)
# Parts of a compound name by which it speaks of something else, or of the page's layout.
NOT_ASIDE = frozenset("no not non without with has free hide hidden off less skip fixed sticky".split())
NAME_PARTS = re.compile(r"[-_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"br", "html", "body", "option"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

# Frequent short words of four languages.
STOP_WORDS = frozenset(
    "a about after all an and any are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our out she so"
    " than that the their there they this to up was we were what when which who will with would you"
    " als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie"
    " sind so über um und uns von vor war wie wir zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous"
    " al como con del desde el ella en era es esta este están fue ha hay la las lo los más me muy no o para pero por que se ser sin sobre su sus también un una y ya".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<skip>{SKIPPED})\b[^>]*?(?<!/)>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
# Elements of running text, whose names say little; and ids that tell a part of a page even so.
TEXT_TAGS = frozenset("p section blockquote li dd dt td th figure figcaption caption pre details summary".split())
PLAIN_IDS = frozenset("comment comments disqus respond replies sidebar header footer nav navbar navigation menu masthead breadcrumb breadcrumbs toolbar".split())
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")

# Thresholds of the first pass.
MOST_LINKS, MOSTLY_LINK = 0.2, 0.7
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.10, 0.22


WEAK, COMPOUND, MARKED = 1, 2, 3


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    aside: int  # 0: none, WEAK: by a name that needs a second sign, COMPOUND: by a part of a compound name, MARKED: by a tag, a whole name or as hidden
    article: int  # which <article> or <main> it stands in, the innermost; 0: none
    links: int  # how many links there are in it


def hidden(attrs: str) -> bool:
    """Whether a tag's attributes hide it: hidden, aria-hidden="true" or style with display: none."""
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def name_mark(attrs: str, tag: str, article: bool) -> int:
    """Whether a tag's class, id or role names an aside: as a whole name, or as a part of a compound name.

    A header within an article is the article's own.
    """
    if tag in HEADING:
        return 0
    mark, text = 0, tag in TEXT_TAGS
    for m in NAMED.finditer(attrs):
        for name in html.unescape(m[2] or m[3] or m[4] or "").lower().split():
            parts = set(NAME_PARTS.split(name))
            found = (parts & ASIDE_NAMES) - ({"header"} if article else set())
            if name in found:
                if text and m[1].lower() == "id" and name not in PLAIN_IDS:
                    mark = max(mark, WEAK)
                else:
                    return MARKED
            elif found and not parts & NOT_ASIDE:
                mark = max(mark, WEAK if text else COMPOUND)
    return mark


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order; what stands in skipped elements and comments of the markup is no text."""
    out: list[Block] = []
    parts: list[str] = []
    links = n_links = at = 0
    open_tags: list[tuple[str, int, int]] = []  # tag, how far in an aside, number of the article
    anchors = articles = 0
    block_tag = "body"

    def state() -> tuple[int, int]:
        return open_tags[-1][1:] if open_tags else (0, 0)

    def flush() -> None:
        nonlocal parts, links, n_links
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, links, block_tag, *state(), n_links))
        parts, links, n_links = [], 0, 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw)
        parts.append(text)
        if anchors:
            links += len(text.strip())

    for found in TOKEN.finditer(page):
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["close"]:
            if tag in BLOCK_TAGS or tag in ASIDE_TAGS:
                flush()
            depth = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag), None)
            if depth is not None:
                for gone, _, _ in open_tags[depth:]:
                    anchors -= gone == "a"
                del open_tags[depth:]
            if tag in BLOCK_TAGS:
                block_tag = next((t for t, _, _ in reversed(open_tags) if t in BLOCK_TAGS), "body")
            continue
        if tag in BLOCK_TAGS or tag in ASIDE_TAGS:
            flush()
            if tag in CLOSES_P:  # an unclosed paragraph, and what is open in it, ends here
                depth = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == "p"), None)
                if depth is not None and not any(t in ASIDE_TAGS or t in ("div", "section", "article", "table", "td", "li") for t, _, _ in open_tags[depth:]):
                    for gone, _, _ in open_tags[depth:]:
                        anchors -= gone == "a"
                    del open_tags[depth:]
        if tag in VOID or found["attrs"].endswith("/"):
            continue
        aside, article = state()
        attrs = found["attrs"]
        if (tag in ASIDE_TAGS and not (tag == "header" and article)) or (attrs and hidden(attrs)):
            aside = MARKED
        elif attrs and tag not in ("html", "body", "article", "main"):
            aside = max(aside, name_mark(attrs, tag, article > 0))
        if tag in ("article", "main"):
            articles += 1
            article = articles
        open_tags.append((tag, aside, article))
        if tag in BLOCK_TAGS:
            block_tag = tag
        anchors += tag == "a"
        n_links += tag == "a"
    if at < len(page):
        say(page[at:])
    flush()
    return out


def first_pass(b: Block, marks: int = COMPOUND) -> str:
    """good, bad, or open ("near" for middling, "short" for short blocks); marks as strong as ``marks`` count.

    Within an article a sign of copyright is a matter of the text, and one link
    in a sentence with stop words leaves the block open.
    """
    density = b.link_chars / len(b.text)
    words = WORDS.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    sentence = b.article > 0 and b.links == 1 and density < MOSTLY_LINK and stops >= FEW_STOPS and b.tag not in HEADING
    if b.aside >= marks or (b.aside == WEAK and (b.links or stops < FEW_STOPS)):
        return "bad"
    if (density > MOST_LINKS and not sentence) or (not b.article and "©" in b.text and len(b.text) < LONG):
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if density > 0 and stops < FEW_STOPS else "short"
    if stops >= MANY_STOPS:
        return "good" if len(b.text) > LONG else "near"
    if stops >= FEW_STOPS:
        return "near"
    return "short" if b.article else "bad"


def nearest(blocks: list[Block], first: list[str]) -> list[str]:
    """The decided label before each block, of the same article or, outside of articles, of none; "" where there is none."""
    out, last = [], {}
    for b, label in zip(blocks, first):
        out.append(last.get(b.article, ""))
        if label in ("good", "bad"):
            last[b.article] = label
    return out


def labels_of(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    first = [first_pass(b) for b in blocks]
    if "good" not in first and any(b.aside == COMPOUND for b in blocks):  # a compound name gives way where all the prose bears it
        first = [first_pass(b, MARKED) for b in blocks]
    before, after = nearest(blocks, first), nearest(blocks[::-1], first[::-1])[::-1]
    holding = {b.article for b, label in zip(blocks, first) if label == "good"}
    out = []
    for b, label, left, right in zip(blocks, first, before, after):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif not holding:  # nothing decided good on the whole page: its articles if any, else middling blocks
            out.append(label == "near" or b.article > 0)
        else:
            end = "good" if b.article and b.article in holding else "bad"
            sides = {left or end, right or end}
            heading = b.tag in HEADING and right == "good"
            out.append(sides == {"good"} or (label == "near" and "good" in sides) or heading)
    return out


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in order, joined by two line ends; empty if there is none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, good in zip(blocks, labels_of(blocks)) if good)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...).

    Null html counts as empty, and gives empty text; repeated rows stay; other
    columns are not read; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extracted(table(spark, sf_dir, "pages"))
