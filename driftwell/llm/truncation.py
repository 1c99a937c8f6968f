"""Texts cut off by a field limit or in transfer (problem 1).

Two kinds of evidence are joined.

*Endings.* The corpus itself shows how complete sentences end: every sentence that another one follows
in its text is complete. Its ending (the last words without numbers and names, and the last word) goes
into a table of endings with the number of texts it was seen in. A text's last sentence is complete if
its ending is in that table; it is cut if it stops elsewhere, in a broken entity, tag, escape or
character, or at a mark of omission. Places in brackets are complete, and so are addresses and short labels
that a share of the corpus's items have: copies of an item count once, and the share, unlike a number, is not
reached by stock sentences cut at the same place as the corpus grows. A full stop alone proves nothing: some feeds put one after a cut.

*Limits.* For every text the length is computed under several encodings: characters, UTF-8 bytes,
UTF-16 units, HTML entities, JSON escapes, line ends of two characters. Per source and encoding, a
length that far more texts have than its neighbours, and at which most texts stop inside a
sentence, is a hidden limit. A text at a limit that happens to end with its sentence is cut if more
such texts stand there than at the lengths around it.

Tables of endings are joined by key, never broadcast by decree; counts are made within the batches
first. Defined results: null, empty and blank texts are not cut and are not counted; equal rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.joins import look_up
from driftwell.llm.lookalikes import LOOK_ALIKE
from driftwell.session import cut_lineage

#: Texts in which an ending must have been seen, and items in which a label or address must stand: so many, and such a share of all.
SEEN, LABEL_SEEN, LABEL_SHARE = 2, 3, 1e-4
#: Letters that a label has at most: a longer text that stops without a stop is no label.
LABEL_LENGTH = 40
#: Texts that a limit needs to be told from chance, and times that it must exceed the mean of the 30 lengths around it.
LIMIT_TEXTS, LIMIT_TIMES = 6, 4
#: Texts that a limit in a second encoding needs besides those at the first.
SECOND_TEXTS = 12

_FOLD = str.maketrans({a: b for x, y in LOOK_ALIKE.values() for a, b in zip(x, y, strict=True)})
_CJK = "぀-ヿ㐀-鿿豈-﫿々〆ー"
# What stands for omitted text, and calls to read the rest.
_OMITTED = re.compile(r"(?:…|\.\.\.|&hellip;|&#8230;|&#x2026;)[\s\]\)\"'»>]*\Z|[\[(](?:…|\.\.\.|&hellip;|&#8230;)[\])]?\s*\Z", re.I)
_MORE = re.compile(
    r"(?:leia mais|ler mais|saiba mais|continue lendo|continuar lendo|read more|continue reading|lire la suite|lire plus|en savoir plus|leer m[áa]s|seguir leyendo|sigue leyendo|ver m[áa]s|weiterlesen|mehr lesen|lesen sie mehr|続きを読む|続きはこちら|もっと読む)[\s\]\).…»>→]*\Z",
    re.I,
)
_BROKEN = re.compile(r"(?:&(?:[a-z]{1,8}|#x?[0-9a-f]{0,6})?|<[^<>]{0,80}|\\u[0-9a-f]{0,4}|\\x?[0-9a-f]{0,2}|%[0-9a-f]?|�+)\Z", re.I)
_COPY = re.compile(r"(?:\s*(?:\*|\(\d\)|再掲)|\s+bis)\s*\Z")
_URL = re.compile(r"(?:https?://|www\.)\S+\Z|\S+@\S+\Z")
_STOP = re.compile(r"[.!?。．！？]+[\"'»”)\]]*\Z")
_SENTENCE = re.compile(r"[.!?][\"'»”)]*\s+|[。！？]+|\n+")
_CJK_START = re.compile(f"[{_CJK}]")
_TOKEN = re.compile(rf"[{_CJK}]|\d+(?:[.,]\d+)*|[^\W\d_{_CJK}]+")


_OTHER_SCRIPT = re.compile("[\u0370-\u04ff]")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_TAGS = re.compile(r"(?:\s*</?[a-z][a-z0-9]{0,9}(?:\s[^<>]{0,80})?/?>)+\Z", re.I)
#: Last letters of what _TAGS and _COPY match.
_MAYBE_COPY = frozenset("*)>掲s")
#: Letters of a sentence's end that are looked at.
TAIL = 56


def plain(text: str) -> str:
    if text.isascii():
        return text
    if _OTHER_SCRIPT.search(text):
        text = text.translate(_FOLD)
    text = _UNSEEN.sub("", text)
    if not unicodedata.is_normalized("NFKC", text.replace("…", "")):
        text = unicodedata.normalize("NFKC", text.replace("…", "\0")).replace("\0", "…")
    return text


_MARKS = re.compile("[\u0300-\u036f]+")
_DIGIT = re.compile(r"\d")


def bare(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text)))


def _number(t: str) -> str:
    return f"#{len(t)}" if len(t) > 3 and t.isdigit() else "#"


@lru_cache(maxsize=200_000)
def _masked_keys(tail: str, whole: bool) -> tuple[str, str, str]:
    found = _TOKEN.findall(bare(tail))
    if not whole and found and not _CJK_START.match(found[0]):
        found = found[1:]  # the first word may be cut by the window
    if not found:
        return "", "", ""
    if _CJK_START.match(found[-1]):
        return "ja:" + "".join("#" if t[0].isdigit() else t for t in found[-7:]), "ja", ""
    latin = [t for t in found if not t[0].isdigit()]
    capitals = sum(t[0].isupper() for t in latin) > 0.6 * len(latin)
    lower = [_number(t) if t[0].isdigit() else t.lower() for t in found]
    as_capitals = "CAPS:" + " ".join(lower[-4:])
    last = "#" if found[-1][0].isdigit() else lower[-1]
    if capitals:
        return as_capitals, last, ""
    out: list[str] = []
    for i, t in enumerate(found):
        word = "N" if t[0].isupper() and not (i == 0 and whole) else lower[i]
        if word != "N" or not out or out[-1] != "N":
            out.append(word)
    return " ".join(out[-4:]), last, as_capitals


def _tail_keys(tail: str, whole: bool) -> tuple[str, str, str]:
    """(ending without numbers and names, last word, ending as it would be in capitals) of a sentence's last letters."""
    return _masked_keys(_DIGIT.sub("0", tail), whole)


def ends_of(raw: str) -> tuple[tuple[str, str, str, str], set[str]]:
    """((kind, key, key as a label or address, last word) of a text's end, keys of the complete endings that it shows).

    kind is cut, url, bracket, label, stop or open.
    """
    text = plain(raw.rstrip())
    # every pattern below is about the end: none may scan, or go back over, a long text
    head, tail = text[:-200], text[-200:]
    if tail[-1:] in _MAYBE_COPY:
        tail = _TAGS.sub("", _COPY.sub("", _TAGS.sub("", tail))).rstrip()
    body = head + tail
    seen: set[str] = set()
    at = 0
    for m in _SENTENCE.finditer(body):
        if m.end() >= len(body):
            break
        if m.group()[0] != "\n" and m.start() > at:
            sentence = body[max(at, m.start() - TAIL) : m.start()]
            key, last, as_capitals = _tail_keys(sentence.rstrip(), m.start() - at <= TAIL)
            if key:
                seen |= {key, "last:" + last, as_capitals} if as_capitals else {key, "last:" + last}
        at = m.end()
    final = body[at:]
    plain_stop = tail[-1:] in (".", "。") and tail[-2:] != ".."
    if _MORE.search(tail[-40:]) or (not plain_stop and (_OMITTED.search(tail[-24:]) or _BROKEN.search(tail[-100:]))):
        return ("cut", "", "", ""), seen
    word = tail[max(tail.rfind(c) for c in " \t\n　:：、。") + 1 :] if "://" not in tail else tail[tail.rfind("://") - 5 :].rpartition(" ")[2]
    if not plain_stop and _URL.search(word):
        word = word.rstrip(".,;)").lower()
        return ("url", "", "url:" + ("@" + word.rpartition(".")[2] if "@" in word else word.rpartition("/")[2]), ""), seen
    if final.endswith((")", "）")) and final.count("(") + final.count("（") == final.count(")") + final.count("）"):
        return ("bracket", "", "", ""), seen
    stop = _STOP.search(final[-40:])
    end = (final[: len(final) - len(final[-40:]) + stop.start()] if stop else final).rstrip()
    key, last, _ = _tail_keys(end[-TAIL:], len(end) <= TAIL)
    if not stop and len(body) <= LABEL_LENGTH and not at:
        return ("label", key, "label:" + body.lower(), last), seen
    return ("stop" if stop else "open", key, "", last), seen


def read_ends(rows: DataFrame) -> DataFrame:
    """Two kinds of rows from one reading of all texts.

    With ``seen`` null: key, source, lengths, kind, end_key, label_key, last of one text. Else: end_key and
    the number of texts of a batch that show this complete ending.
    """
    names = [f"n_{m}" for m in MEASURES]
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, source string, " + ", ".join(f"{n} int" for n in names) + ", kind string, end_key string, label_key string, last string, seen bigint"

    def counted(count: Counter, key_type: pa.DataType) -> pa.RecordBatch:
        n = len(count)
        nulls = [pa.nulls(n, key_type), pa.nulls(n, pa.string()), *(pa.nulls(n, pa.int32()) for _ in names), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array(list(count), pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(list(count.values()), pa.int64())], names=["key", "source", *names, "kind", "end_key", "label_key", "last", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            found = []
            for t in batch.column(2).to_pylist():
                end, seen = ends_of(t)
                found.append(end)
                count.update(seen)
            strings = [pa.array([f[i] for f in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(batch.column(3 + i) for i in range(len(names))), *strings, pa.nulls(len(found), pa.int64())], names=["key", "source", *names, "kind", "end_key", "label_key", "last", "seen"])
            if len(count) > 100_000:  # what a task holds stays bounded; the rest is added up after the shuffle
                yield counted(count, key_type)
                count = Counter()
        if count:
            yield counted(count, key_type)

    measured = rows.select("key", "source", "text", *[m(F.col("text")).cast("int").alias(f"n_{n}") for n, m in MEASURES.items()])
    return measured.mapInArrow(run, schema)


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _utf16(text: Column) -> Column:
    return F.floor((F.octet_length(F.encode(text, "UTF-16BE"))) / 2)


#: Encoding -> length of a text in it. HTML: & < > " become entities; JSON: " \ and controls are escaped.
MEASURES = {
    "characters": lambda t: F.char_length(t),
    "utf8": lambda t: F.octet_length(t),
    "utf16": _utf16,
    "html": lambda t: F.char_length(t) + 4 * _count(t, "&") + 3 * _count(t, "<>") + 5 * _count(t, '"') + 5 * _count(t, "'"),
    "html_utf8": lambda t: F.octet_length(t) + 4 * _count(t, "&") + 3 * _count(t, "<>") + 5 * _count(t, '"') + 5 * _count(t, "'"),
    "json": lambda t: F.char_length(t) + _count(t, '"\\\n\r\t') + 5 * (F.char_length(t) - F.char_length(F.regexp_replace(t, "[^\\x00-\\x7f]", ""))) + 6 * (_utf16(t) - F.char_length(t)),
    "crlf": lambda t: F.char_length(t) + _count(t, "\n") - (F.char_length(t) - F.char_length(F.replace(t, F.lit("\r\n"), F.lit("")))) / 2,
}


def judged(rows: DataFrame) -> DataFrame:
    """key, source, lengths, kind, and inside: whether the text stops inside a sentence or at a mark of omission."""
    both = cut_lineage(read_ends(rows))  # holds no texts; read three times below
    table = both.filter("seen is not null").groupBy("end_key").agg(F.sum("seen").alias("end_seen"))
    by_last = table.filter("end_key like 'last:%'").select(F.expr("substring(end_key, 6)").alias("last"), F.col("end_seen").alias("last_seen"))
    texts = both.filter("seen is null").drop("seen")
    item = F.struct("key")  # a null key is one as well
    by_label = texts.filter("label_key <> ''").groupBy("label_key").agg(F.count_distinct(item).alias("label_seen"))
    often = max(LABEL_SEEN, LABEL_SHARE * texts.agg(F.count_distinct(item)).first()[0])
    e = texts.distinct()
    for known, key, value in ((table, "end_key", "end_seen"), (by_last, "last", "last_seen"), (by_label, "label_key", "label_seen")):
        e = look_up(e, known, key, value)
    end, last, label = (F.coalesce(c, F.lit(0)) for c in ("end_seen", "last_seen", "label_seen"))
    # after a full stop a last word seen once is enough: half a name never ends a sentence
    known = (end >= SEEN) & (F.col("last").isin("#", "ja") | (last >= F.when(F.col("kind") == "stop", 1).otherwise(SEEN)))
    inside = (
        F.when(F.col("kind") == "cut", True)
        .when(F.col("kind") == "url", label < often)
        .when(F.col("kind") == "bracket", False)
        .when(F.col("kind") == "label", (label < often) & ~known)
        .otherwise(~known)
    )
    return e.withColumn("inside", inside).drop("end_seen", "last_seen", "label_seen", "end_key", "label_key", "last")


def _lengths(ends: DataFrame, *columns: str) -> DataFrame:
    """columns, measure, length: a row for each encoding."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"n_{m}").alias("length")) for m in MEASURES]))
    return ends.select(*columns, each)


def _spikes(histogram: DataFrame) -> DataFrame:
    """Lengths that far more texts have than their neighbours, most of them inside a sentence."""
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-15, 15)
    h = histogram.withColumns({
        "expected": (F.sum("texts").over(near) - F.col("texts")) / 30,
        "whole": F.col("texts") - F.col("inside"),
        "whole_expected": (F.sum(F.col("texts") - F.col("inside")).over(near) - (F.col("texts") - F.col("inside"))) / 30,
    })
    return h.filter((F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") > LIMIT_TIMES * F.col("expected") + 2) & (F.col("inside") * 2 > F.col("texts")))


def _sharpest(spikes: DataFrame, by: str) -> DataFrame:
    """Of each source the spikes in the encoding of its greatest one."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(MEASURES) for x in (m, i)])[F.col("measure")]
    best = Window.partitionBy("source").orderBy(F.desc(by), order)
    return spikes.withColumn("own", F.first("measure").over(best)).filter("measure = own").drop("own")


def limits(ends: DataFrame) -> DataFrame:
    """source, measure, length, texts, inside, expected, whole, whole_expected of every hidden limit. ends: judged(), written down.

    One limit shows in several encodings at once, blurred in all but its own: a source's sharpest encoding comes first. A
    spike in another one is a limit too if SECOND_TEXTS texts at it, and half of all there, stand at no limit found before.
    Each round settles one encoding of a source, so rounds are at most encodings. Spikes are few: lengths of sources.
    """
    histogram = _lengths(ends, "source", "inside").groupBy("source", "measure", "length").agg(F.count("*").alias("texts"), F.sum(F.col("inside").cast("int")).alias("inside"))
    spikes = cut_lineage(_spikes(histogram))
    found = _sharpest(spikes, "texts")
    for _ in MEASURES:
        others = spikes.join(found.select("source", "measure").distinct(), ["source", "measure"], "left_anti")
        at = found.groupBy("source").agg(F.collect_set(F.struct("measure", "length")).alias("__at"))
        here = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"n_{m}").alias("length")) for m in MEASURES])
        free = ends.join(F.broadcast(at), "source").filter(~F.arrays_overlap("__at", here))
        free = _lengths(free, "source").join(F.broadcast(others.select("source", "measure", "length")), ["source", "measure", "length"]).groupBy("source", "measure", "length").agg(F.count("*").alias("free"))
        new = cut_lineage(_sharpest(others.join(free, ["source", "measure", "length"]).filter((F.col("free") >= SECOND_TEXTS) & (F.col("free") * 2 >= F.col("texts"))), "free").select(*spikes.columns))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def truncated(rows: DataFrame) -> DataFrame:
    """key, source, cut, by_limit of every non-blank text; equal rows once. rows: rows_of().

    by_limit: the text ends with a whole sentence, and a limit alone tells that it was cut.
    """
    ends = cut_lineage(judged(rows))
    found = limits(ends).select("source", "measure", "length", (F.col("whole") > 2 * F.col("whole_expected") + 1).alias("crowded"))
    at = _lengths(ends.filter("not inside"), "key", "source", "kind").join(F.broadcast(found), ["source", "measure", "length"]).filter("crowded or kind = 'open'")
    # without a full stop at a limit: cut; with one: if more such texts stand there than around it
    at = at.select("key", "source").distinct().withColumn("at_limit", F.lit(True))
    limit = F.coalesce("at_limit", F.lit(False))
    return ends.join(at, ["key", "source"], "left").select("key", "source", (F.col("inside") | limit).alias("cut"), (~F.col("inside") & limit).alias("by_limit")).distinct()


def rows_of(items: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, text of every non-blank text."""
    return items.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).filter(F.col("text").rlike("(?U)[^\\s\\u200b\\ufeff]"))


def source_report(cut: DataFrame) -> DataFrame:
    """source, texts, cut, by_limit, share of every source. cut: truncated()."""
    return cut.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut"), F.sum(F.col("by_limit").cast("int")).alias("by_limit")).withColumn("share", F.col("cut") / F.col("texts"))
