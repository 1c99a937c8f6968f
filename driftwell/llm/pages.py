"""Main content of web pages by layout-aware rendering (problem 5).

*Rendering.* A tree builder reads each page once, with the tags that HTML leaves out put in (a paragraph
ends at the next block, a list item at the next item, a cell at the next cell) and without what a browser
would not show. It emits every visible block of text with its place in the layout; from these blocks come
the text of the whole page (block spacing, list marks, aligned table cells) and the article.

*Content model.* No phrase, class name or site rule is used; a block is judged by

* layout: the container that holds most of the page's prose, navigation and side elements, the share of
  a block's letters that are links, the heading that the page's own title repeats, the short dated line
  beside the heading (the byline);
* repetition: a text (numbers left out) that a fifth of a site's differently titled pages show is the
  site's, not the article's. Pages of one title count once, so an article that was captured often does
  not become a notice;
* titles: a short opening followed by the title of another page of the site is a pointer to it. Titles
  are compared without the names in them.

The article is the run of blocks with the greatest sum of evidence (maximum subsequence segmentation:
prose counts for it, links and repeated texts against it), from the heading on, less the blocks that are
themselves not the article's. A list of other pages inside it does not end it.

Pages are parsed once; what was parsed is kept, and read again when the counts are known. Counts are
per site and text hash, made distinct before they are added up; a site's profile holds only texts above
a share of its pages, so its size is bounded by the blocks of a page, not by the pages. Profiles are broadcast
while they are small (counted), else joined by site and a salt, so a site with a third of all pages is spread over SALT keys.

Defined results: a null or blank body has no article; a page without heading or byline has one, and so has a page that
is alone on its site (nothing is known to be repeated there); equal blocks of a page count once in ``p5_found``;
bodies of any length are read whole; a null site is a site of its own.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: Share of a site's pages that a text must stand on to be the site's own, and pages of different titles that must show it.
REPEATED, REPEATED_PAGES = 0.2, 3
#: Share of a site's pages on which a title (without names) must be seen, as title, heading or link.
TITLE_SHARE = 0.01
#: Profiles of at most so many hashes of 8 bytes are broadcast; larger ones are joined by site and salt, over SALT keys a site.
BROADCAST_HASHES, SALT = 1_000_000, 32

# Block-level tags, tags whose content is not shown, tags without content, side elements, tags that a start tag ends.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("noscript template head title svg iframe object textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav aside footer menu dialog form search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd caption".split())
ROWS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"caption"}, {"table"}),
}

_SPACE = re.compile(r"[\s​﻿]+")
# no alternative can go back over another, so any markup is read in one pass
_UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|[!?/][^<>]*>)")
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_UNSHOWN = re.compile(r"(?:\A|\s)hidden(?:[\s=/]|\Z)|style\s*=[^<>]*?(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_STOP = re.compile(r"[.!?。！？][\"'»”」』)\]]*\Z")
_CJK = re.compile("[぀-ヿ㐀-鿿々〆]")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(
    r"\d{1,4}\s?[/.\-年]\s?\d{1,2}\s?[/.\-月]\s?\d{1,4}日?|\b\d{1,2}(?:st|nd|rd|th|er|º|\.)?\s+(?:de\s+)?[^\W\d_]{3,12}\.?,?\s+(?:de\s+)?\d{4}\b|\b[^\W\d_]{3,12}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
)
_OPENING = re.compile(r"([^:：.!?。！？]{2,40}?)(?:\s?[:：]\s*|(?<=[぀-ヿ㐀-鿿])\s)(?=\S)")


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    containers: tuple[int, ...]  # numbers of the open block elements, outermost first
    cell: int = 0  # column in its row, from 1
    linked: float = 0.0  # share of the letters that are links
    side: bool = False


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    title: str = ""
    links: list[str] = field(default_factory=list)
    flat: frozenset[int] = frozenset()  # numbers of containers that only hold the whole page
    rows: frozenset[int] = frozenset()  # numbers of lists, tables and their rows


def is_text(path: str | None) -> bool:
    return (path or "").lower().endswith(".txt")


def _tidy(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def read(body: str | None, text: bool = False) -> Page:
    """All visible blocks of a page, in order."""
    if not body:
        return Page([])
    if text:
        lines = (_tidy(line) for line in body.split("\n"))
        return Page([Block(line, "line", ()) for line in lines if line])
    body = _CUT_TAG.sub("", _UNREAD.sub("", body))
    out: list[Block] = []
    links: list[str] = []
    opened: list[tuple[str, int]] = []
    words: list[str] = []
    link_words: list[str] = []
    shut: list[str] = []  # open elements that are not shown
    flat: set[int] = {0}
    row_like: set[int] = set()
    title: list[str] = []
    number = cells = link_from = 0
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked, link_from
        block = _tidy("".join(words))
        words.clear()
        if in_link:
            linked += sum(map(len, link_words[link_from:]))
            link_from = len(link_words)
        if block:
            tag = opened[-1][0] if opened else ""
            names = {t for t, _ in opened}
            side = bool(names & SIDE) or ("header" in names and not names & {"article", "main"})
            out.append(Block(block, tag, tuple(n for _, n in opened), cells if tag in ("td", "th") else 0, min(1.0, linked / len(block)), side))
        linked = 0

    def end_link() -> None:
        nonlocal in_link, linked
        if in_link:
            in_link = False
            linked += sum(map(len, link_words[link_from:]))
            if name := _tidy("".join(link_words)):
                links.append(name)
            link_words.clear()

    at = 0
    for m in _TAG.finditer(body):
        if m.start() > at:
            data = body[at : m.start()]
            if "&" in data:
                data = html.unescape(data)
            if not shut:
                words.append(data)
                if in_link:
                    link_words.append(data)
            elif shut[-1] == "title" and len(shut) <= 2 and "svg" not in shut:
                title.append(data)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):  # an end tag
            if shut:
                if tag == shut[-1]:
                    shut.pop()
            elif tag == "a":
                end_link()
            elif tag in BLOCKS:
                flush()
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i][0] == tag:
                        del opened[i:]
                        break
                    if opened[i][0] in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "body", "html"):
                        break  # a stray end tag does not leave its cell
            continue
        attributes = m.group(3)
        if shut:
            if tag == "body":
                shut.clear()
            elif tag == "title":
                shut.append(tag)
                continue
            else:
                if tag == shut[-1] and tag not in VOID:
                    shut.append(tag)
                continue
        if tag not in VOID and (tag in HIDDEN or (attributes and _UNSHOWN.search(attributes))):
            if tag in BLOCKS:
                flush()
            if not attributes.endswith("/"):
                shut.append(tag)
            continue
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            end_link()
            in_link, link_from = True, 0
        if tag not in BLOCKS:
            continue
        flush()
        if opened and opened[-1][0] == "p":
            opened.pop()
        if tag in ENDS:
            tags, stops = ENDS[tag]
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] in stops:
                    break
                if opened[i][0] in tags:
                    del opened[i:]
                    break
        cells = 0 if tag == "tr" else cells + 1 if tag in ("td", "th") else cells
        if tag not in VOID:
            number += 1
            if tag in ("html", "body", "center") and all(n in flat for _, n in opened):
                flat.add(number)
            elif tag in ROWS:
                row_like.add(number)
            opened.append((tag, number))
    if not shut:
        words.append(html.unescape(body[at:]))
    end_link()
    flush()
    return Page(out, _tidy("".join(title)), links, frozenset(flat), frozenset(row_like))


def render(found: list[Block]) -> str:
    """Blocks as text: a blank line between blocks, marks before list items, cells of a row in columns."""
    out: list[str] = []
    widths: dict[int, int] = {}
    for b in found:
        if b.cell:
            widths[b.cell] = max(widths.get(b.cell, 0), len(b.text))
    before = ""
    for b in found:
        if b.cell > 1 and before in ("td", "th") and out:
            out[-1] = out[-1].ljust(sum(widths.get(k, 0) + 2 for k in range(1, b.cell))) + b.text
        else:
            if out and not (b.tag == before and b.tag in ("li", "td", "th", "line")):
                out.append("")
            out.append(f"- {b.text}" if b.tag == "li" else b.text)
        before = b.tag
    return "\n".join(out)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def mask(text: str) -> int:
    """Hash of a text without its numbers."""
    return _hash(_DIGITS.sub("#", text).lower())


def title_mask(text: str) -> int:
    """Hash of the first words of a title that are no names or numbers; 0 if too little is left to know it by."""
    if _CJK.search(text):
        tail = "".join(_CJK.findall(text))[-4:]  # names stand before: the end of a Japanese title is its verb
        return _hash("ja:" + tail) if len(tail) == 4 else 0
    found = _WORD.findall(text)
    kept = [w.lower() for i, w in enumerate(found) if i == 0 or w[0].islower()]
    return _hash("t:" + " ".join(kept[:3])) if len(kept) > 1 else 0  # names further on have small words of their own


def prose(text: str) -> bool:
    return _STOP.search(text[-12:]) is not None or len(text) >= (40 if _CJK.search(text) else 80)


def byline(b: Block) -> bool:
    """A short line of a date and names."""
    if len(b.text) > 120 or b.tag in HEADINGS or b.tag in ITEMS or _STOP.search(b.text) or not (m := _DATE.search(b.text)):
        return False
    rest = b.text[: m.start()] + " " + b.text[m.end() :]
    return not any(w[0].islower() and len(w) > 3 for w in _WORD.findall(rest)) and len(_CJK.findall(rest)) <= 8


#: What is noted of a block: in the main container, prose, link, side element, byline, heading that the title repeats, heading tag, item, loose (in no container of its own).
INSIDE, PROSE, LINK, SIDE_, BYLINE, TITLED, HEADING, ITEM, LOOSE = (1 << k for k in range(9))


def notes(page: Page) -> list[int]:
    """Place and shape of every block."""
    mass: dict[int, int] = defaultdict(int)
    found = page.blocks
    is_prose = [prose(b.text) for b in found]
    for b, p in zip(found, is_prose, strict=True):
        if p and b.linked < 0.5 and not b.side:
            for n in b.containers[:-1] or (0,):
                if n not in page.rows:  # a list is part of what it stands in
                    mass[n] += len(b.text)
    whole = max(mass.values(), default=0)
    home = max((n for n, x in mass.items() if x >= 0.7 * whole), default=0)
    loose = home in page.flat
    title = page.title.lower()
    titled = max((b for b in found if len(b.text) > 3 and b.linked < 0.5 and title.startswith(b.text.lower())), key=lambda b: len(b.text), default=None) if title else None
    first = next((i for i, (b, p) in enumerate(zip(found, is_prose, strict=True)) if p and (not home or home in b.containers) and b.linked < 0.5), len(found))
    if titled is None:  # else the last main heading before the prose, or in it
        titled = next((b for b in reversed(found[: first + 1]) if b.tag == "h1" and b.linked < 0.5), None) or next((b for b in found[first:] if b.tag == "h1"), None)
    out = []
    for b, p in zip(found, is_prose, strict=True):
        inside = not home or home in b.containers
        out.append(
            inside * INSIDE | p * PROSE | (b.linked >= 0.5) * LINK | b.side * SIDE_ | byline(b) * BYLINE | (b is titled) * TITLED | (b.tag in HEADINGS) * HEADING | (b.tag in ITEMS) * ITEM | loose * LOOSE
        )
    return out


def pointer(text: str) -> int:
    """title_mask() of what follows a short opening in a text that is no sentence; else 0."""
    if len(text) > 300 or _STOP.search(text[-12:]) or not (m := _OPENING.match(text)):
        return 0
    return title_mask(text[m.end() :])


def own_title(text: str) -> int:
    """title_mask() of a text that is no sentence; else 0."""
    return 0 if len(text) > 300 or _STOP.search(text[-12:]) else title_mask(text)


def choose(texts: list[str], note: list[int], masks: list[int], pointers: list[int], own: list[int], repeated: set[int], titles: set[int]) -> list[int]:
    """Numbers of the article's blocks. masks, pointers and own: mask(), pointer() and own_title() of each."""
    n = len(texts)
    out = [bool(note[i] & (LINK | SIDE_)) or masks[i] in repeated or (pointers[i] != 0 and pointers[i] in titles) for i in range(n)]
    worth = []
    for i in range(n):
        if not note[i] & INSIDE or out[i]:
            worth.append(-0.25 if note[i] & INSIDE and not note[i] & LOOSE else -1.0)  # a container of its own holds the article together
        elif note[i] & PROSE and not (own[i] and own[i] in titles):
            worth.append(1 + min(300, len(texts[i]) * (2 if _CJK.search(texts[i]) else 1)) / 20)
        else:
            worth.append(0.0 if not note[i] & LOOSE or note[i] & HEADING else -0.5)
    best, lo, hi, total, start = 0.0, 0, -1, 0.0, 0
    for i in range(n):  # the greatest sum; of equal ones the longest
        if total < 0:
            total, start = 0.0, i
        total += worth[i]
        if total > 0 and total >= best:
            best, lo, hi = total, start, i
    if hi < 0:
        return []
    first = next(i for i in range(lo, hi + 1) if worth[i] > 0)
    head = next((i for i in range(n) if note[i] & TITLED), None)
    by = None
    if head is None:
        # without a marked heading: the line before the byline, else before the prose
        by = next((i for i in range(first - 1, -1, -1) if note[i] & BYLINE), None)
        head = next((i for i in range((first if by is None else by) - 1, -1, -1) if not out[i] and not note[i] & ITEM and (own[i] or not note[i] & PROSE)), None)
        if head is not None and by is None and first - head > 3:
            head = None
    elif head > hi:
        head = None
    elif note[head] & SIDE_:
        out[head] = False  # a page's own heading in its header
    if head is not None:
        out[head] = masks[head] in repeated and not note[head] & TITLED
        lo = head
        by = next((i for i in (*range(head + 1, min(n, head + 4)), head - 1) if i >= 0 and note[i] & BYLINE), by)
    else:
        lo = next((i for i in range(lo, hi + 1) if not out[i]), lo)
        by = next((i for i in range(lo, min(n, lo + 3)) if note[i] & BYLINE), by)
    kept = [i for i in range(lo, hi + 1) if i != by and not out[i] and (note[i] & INSIDE or i == head)]
    # the heading of a list of links goes with the list
    dropped = set()
    for k, i in enumerate(kept):
        if note[i] & HEADING and i != head:
            until = kept[k + 1] if k + 1 < len(kept) else hi + 1
            if sum(bool(note[j] & LINK and note[j] & ITEM) for j in range(i + 1, until)) > 1:
                dropped.add(i)
    kept = [i for i in kept if i not in dropped]
    while kept and note[kept[-1]] & HEADING and kept[-1] != head:  # what it heads is not the article's
        kept.pop()
    return kept


def article(page: Page, repeated: frozenset[int] | set[int] = frozenset(), titles: frozenset[int] | set[int] = frozenset()) -> list[Block]:
    """The article's blocks of one page, given what is known of its site."""
    found = page.blocks
    if not found:
        return []
    return [found[i] for i in choose([b.text for b in found], notes(page), [mask(b.text) for b in found], [pointer(b.text) for b in found], [own_title(b.text) for b in found], set(repeated), set(titles))]


def parsed(pages: DataFrame, key: str, site: str | None, whole: bool = False) -> DataFrame:
    """key, site, page and arrays of what parsing showed: one row for each page with visible text (for each page with *whole*)."""
    schema = f"`{key}` {dict(pages.dtypes)[key]}, site string, page bigint, rendered string, texts array<string>, tags array<string>, cells array<int>, note array<int>, masks array<bigint>, pointers array<bigint>, own array<bigint>, shown array<bigint>, titles array<bigint>"
    names = [key, "site", "page", "rendered", "texts", "tags", "cells", "note", "masks", "pointers", "own", "shown", "titles"]
    strings, ints, longs = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())
    types = [None, pa.string(), pa.int64(), pa.string(), strings, strings, ints, ints, longs, longs, longs, longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 64):  # bounds the memory of long pages
                rows = []
                for k, s, body in zip(*(batch.slice(at, 64).column(i).to_pylist() for i in range(3)), strict=True):
                    page = read(body, is_text(k) if isinstance(k, str) else False)
                    found = page.blocks
                    if not found and not whole:
                        continue
                    masks = [mask(b.text) for b in found]
                    shown = list({m for m, b in zip(masks, found, strict=True) if b.linked < 0.5})
                    heads = {title_mask(x) for x in (page.title, *page.links, *(b.text for b in found if b.tag in HEADINGS))} - {0}
                    # pages of one title are one page to the counts; a page without title stands for itself
                    same = _hash(page.title) if page.title else _hash("\0" + "\0".join(b.text for b in found))
                    rows.append((k, s or "", same, render(found) if whole else None, [b.text for b in found], [b.tag for b in found], [b.cell for b in found], notes(page), masks, [pointer(b.text) for b in found], [own_title(b.text) for b in found], shown, list(heads)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return pages.select(key, F.col(site).cast("string").alias("site") if site else F.lit("").alias("site"), "body").mapInArrow(run, schema)


def profiles(found: DataFrame) -> DataFrame:
    """site, repeated, known: hashes of texts that are the site's own, and of titles of its pages. found: parsed()."""
    each = found.select("site", "page", F.inline(F.concat(*[F.expr(f"transform({c}, x -> named_struct('title', {t}, 'hash', x))") for c, t in (("shown", "false"), ("titles", "true"))])))
    counts = each.groupBy("site", "title", "hash").agg(F.count_distinct("page").alias("pages"))
    total = found.groupBy("site").agg(F.count_distinct("page").alias("all"))
    enough = F.when(F.col("title"), F.col("pages") >= TITLE_SHARE * F.col("all")).otherwise((F.col("pages") >= REPEATED * F.col("all")) & (F.col("pages") >= REPEATED_PAGES))
    kept = counts.filter(F.col("title") | (F.col("pages") >= REPEATED_PAGES)).join(total, "site").filter(enough)
    return kept.groupBy("site").agg(F.collect_list(F.when(~F.col("title"), F.col("hash"))).alias("repeated"), F.collect_list(F.when(F.col("title"), F.col("hash"))).alias("known"))


def _picked(pages: DataFrame, key: str, site: str | None, whole: bool) -> DataFrame:
    """Parsed pages with the hashes that their site's profile knows: hits (repeated texts) and aims (titles)."""
    found = cut_lineage(parsed(pages, key, site, whole))  # read for the counts and for the choice; pages are parsed once
    known = cut_lineage(profiles(found))
    if (known.agg(F.sum(F.size("repeated") + F.size("known"))).first()[0] or 0) <= BROADCAST_HASHES:
        rows = found.join(F.broadcast(known), "site", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = found.withColumn("salt", F.pmod(F.xxhash64(key, "page"), F.lit(SALT)).cast("int")).join(salted, ["site", "salt"], "left")
    none = F.array().cast("array<bigint>")
    return rows.withColumns({"hits": F.array_intersect("masks", F.coalesce("repeated", none)), "aims": F.array_intersect(F.concat("pointers", "own"), F.coalesce("known", none))})


def _chosen(row: tuple) -> list[int]:
    texts, note, masks, pointers, own, hits, aims = row
    return choose(texts, note, masks, pointers, own, set(hits), set(aims)) if texts else []


def article_blocks(pages: DataFrame, key: str = "raw_path", site: str | None = "source_id") -> DataFrame:
    """key, n, tag, text, block_md5 of every block of every page's article, n counting from 1."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count, tag, text, md5 = [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 9)]
            for i, (texts, tags, *rest) in enumerate(zip(*columns, strict=True)):
                for n, k in enumerate(_chosen((texts, *rest)), 1):
                    at.append(i), count.append(n), tag.append(tags[k]), text.append(texts[k])
                    md5.append(hashlib.md5(texts[k].encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(count, pa.int32()), pa.array(tag, pa.string()), pa.array(text, pa.string()), pa.array(md5, pa.string())], names=[key, "n", "tag", "text", "block_md5"])

    rows = _picked(pages, key, site, False).select(key, "texts", "tags", "note", "masks", "pointers", "own", "hits", "aims")
    return rows.mapInArrow(run, f"`{key}` {kind}, n int, tag string, text string, block_md5 string")


def rendered(pages: DataFrame, key: str = "raw_path", site: str | None = "source_id") -> DataFrame:
    """key, rendered, article: all visible text of every page, and the article alone."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, tags, cells, *rest in zip(*(batch.column(i).to_pylist() for i in range(2, 11)), strict=True):
                out.append(render([Block(texts[k], tags[k], (), cells[k]) for k in _chosen((texts, *rest))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, "rendered", "article"])

    rows = _picked(pages, key, site, True).select(key, "rendered", "texts", "tags", "cells", "note", "masks", "pointers", "own", "hits", "aims")
    return rows.mapInArrow(run, f"`{key}` {kind}, rendered string, article string")
