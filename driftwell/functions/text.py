"""Text functions as columns: everything here stays in the JVM.

White space means Unicode white space (no-break and ideographic spaces too), the end of a text is
``\\z`` (never ``$``), and word boundaries are written out, so results do not depend on an engine's
idea of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
EDGES = r"(?U)\A\s+|\s+\z"

# What marks a title as a seminar or an event. The bare phrases need no boundary before them.
SEMINAR = r"(?:^|[^\p{L}\p{N}_])(?:stage|semin[aá]rio|seminar|workshop|curso|講習)|estágio de aikido"
EVENT = (
    r"(?:^|[^\p{L}\p{N}_])(?:embukai|taikai|demonstra|demonstration|encontro|conven[çc][ãa]o|festival|exame|memorial|celebra"
    r"|congresso|kagami biraki|calend[aá]rio de exame)|演武大会"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with *value* computed once: what occurs several times in a lambda is computed each time it occurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, EDGES, "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, WS, " "))


def strip_tags(html: Column) -> Column:
    """Tags become blanks, blanks are collapsed; null if nothing is left. Entities stay (see udfs.unescape)."""
    return F.nullif(collapse(F.regexp_replace(html, r"<[^>]+>", " ")), F.lit(""))


def hash16(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def text_hash(text: Column) -> Column:
    return hash16(strip(text))


def item_hash(title: Column, summary: Column, starts_at: Column, city: Column) -> Column:
    """Hash by which an item counts as changed. A null title counts as the word None, others as empty."""
    e = F.lit("")
    return hash16(F.concat_ws("|", F.coalesce(title, F.lit("None")), F.coalesce(summary, e), F.coalesce(starts_at, e), F.coalesce(city, e)))


def classify_type(title: Column) -> Column:
    """seminar, event or null. Lower case first: it folds accents as well."""
    low = F.lower(title)
    return F.when(low.rlike(SEMINAR), "seminar").when(low.rlike(EVENT), "event")


def cut500(text: Column) -> Column:
    return F.nullif(F.substring(text, 1, 500), F.lit(""))


def ellipsis200(text: Column) -> Column:
    """At most 200 characters, the last partial word dropped for an ellipsis."""
    short = F.regexp_replace(F.substring(text, 1, 200), r"[ \t\r\n]+[^ \t\r\n]*\z", "")
    return F.when(F.char_length(text) > 200, F.concat(short, F.lit("…"))).otherwise(text)


def ascii_lang(title: Column) -> Column:
    """A bilingual site's rule: ASCII titles are English, others Japanese."""
    return F.when(title.rlike(r"\A\p{ASCII}*\z"), "en").otherwise("ja")


def first_lang(langs: Column) -> Column:
    return F.get(langs, F.lit(0))


def host(url: Column) -> Column:
    """Host in lower case, without port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"\Awww\.", "")


def payload_kind(body: Column) -> Column:
    """json, xml or html by the first characters after white space."""
    head = F.substring(F.regexp_replace(body, r"(?U)\A\s+", ""), 1, 16)
    return F.when(head.rlike(r"\A[\[{]"), "json").when(F.substring(head, 1, 5).isin("<?xml", "<rss ", "<feed"), "xml").otherwise("html")


def failed(error: Column, status: Column) -> Column:
    """A fetch failed: an error text, or a status of 400 or more."""
    return (F.coalesce(error, F.lit("")) != "") | (F.coalesce(status, F.lit(0)) >= 400)


def succeeded(error: Column, status: Column) -> Column:
    """No error and a status under 400; a missing status is no success. 304 is one."""
    return (F.coalesce(error, F.lit("")) == "") & (F.coalesce(status, F.lit(0)) > 0) & (F.coalesce(status, F.lit(0)) < 400)


def join_parts(sep: str, *parts: Column) -> Column:
    """Non-empty parts joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed table, else *default*."""
    pairs = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))
    found = F.try_element_at(pairs, key)
    return F.coalesce(found, default) if default is not None else found
