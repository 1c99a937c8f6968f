"""One consistent form for text that looks the same (problem 2).

Each value is mapped, in the JVM, to a key without look-alikes: full-width and half-width forms, ligatures,
Roman numerals, look-alike letters of other scripts, all kinds of hyphens and blanks, characters that
cannot be seen. The keys are grouped under Spark's accent- and case-sensitive UNICODE collation, which also
makes composed and decomposed accents equal; the least stored member of a class (in binary order, so the choice is
deterministic) stands for it and is joined back. The key is only for grouping: what comes out is a text that was stored, so
a Russian or Greek text stays as it is.

Because collated comparisons are slow, rows are first blocked by a hash that all collation-equal keys share, and only
blocks with several stored forms go on, each form once. A form is told by 128 bits of hash.

Defined results: null and blank values have no class; case, accents, punctuation and wording keep
texts apart; equal copies of a row count once. Work is by distinct forms; rows are joined with what is known of their form
by broadcast up to a measured size, else by key and salt, so a text that a third of all rows share meets in no task.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.joins import SALTS, spread_join
from driftwell.session import cut_lineage

# Letters of other scripts that look like Latin ones, in their usual fonts.
LOOK_ALIKE = {
    "cyrillic": ("аеоісурхѕјһԁԛԝАВЕКМНОРСТХІЅЈУҮԌԚԜ", "aeoicypxsjhdqwABEKMHOPCTXISJYYGQW"),
    "greek": ("οανρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "oavpuABEZHIKMNOPTYXCj"),
    "armenian": ("օսհցՕՏԼ", "ouhgOSL"),
    "hyphens": ("‐‑", "--"),
}
# Ligatures of Latin letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: What cannot be seen: format characters, joiners, variation selectors, controls but for white space.
UNSEEN = "[\\p{Cf}\\u034f\\ufe00-\\ufe0f\\u115f\\u1160\\u3164\\uffa0\\x00-\\x08\\x0e-\\x1b\\x7f]+"
BLANKS = "(?U)[\\s\\u2800]+"


def _tables() -> tuple[str, str]:
    """From and to of one translate(): widths by Unicode's own mapping, look-alikes from the tables."""
    pairs = {a: b for x, y in LOOK_ALIKE.values() for a, b in zip(x, y, strict=True)}
    for code in (*range(0xFF01, 0xFFEF), *range(0x2160, 0x2180)):
        to = unicodedata.normalize("NFKC", chr(code))
        if unicodedata.category(chr(code)) != "Cn" and len(to) == 1 and to != chr(code):
            pairs.setdefault(chr(code), to)
    pairs["ﾞ"], pairs["ﾟ"] = "゙", "゚"  # half-width voice marks join the kana before them
    return "".join(pairs), "".join(pairs.values())


FROM, TO = _tables()
#: Signs that stand for several letters: ligatures, and Roman numerals by Unicode's own mapping.
SEVERAL = LIGATURES | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(c))) > 1}
#: Nothing is to be done for a text without any of these: all but the usual letters and signs of the Latin script and of Japanese, and odd blanks.
UNUSUAL = "[^\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f\\u3001-\\u30ff\\u4e00-\\u9fff]|  |\\A | \\z"


def mapped(text: Column) -> Column:
    """*text* without look-alikes, unseen characters and odd blanks; blank texts become null."""
    plain = F.translate(text, FROM, TO)
    apart = plain
    for a, b in SEVERAL.items():
        apart = F.replace(apart, F.lit(a), F.lit(b))
    plain = F.when(text.rlike(f"[{''.join(SEVERAL)}]"), apart).otherwise(plain)
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, UNSEEN, ""), BLANKS, " "))
    return F.nullif(F.when(text.rlike(UNUSUAL), plain).otherwise(text), F.lit(""))


def _bases() -> tuple[str, str]:
    """From and to of one translate() that drops what canonical composition adds: letter with mark -> letter."""
    pairs = {}
    for code in (*range(0xC0, 0xAC00), *range(0xF900, 0x30000)):
        to = unicodedata.normalize("NFD", chr(code))
        if to[0] != chr(code):
            pairs[chr(code)] = to[0]
    return "".join(pairs), "".join(pairs.values())


#: Whatever else a canonical form may compose or a collation may ignore: marks, Hangul and its parts, other scripts' letters with marks.
_VARIES = "[\\p{M}\\u0600-\\u1dff\\ua960-\\ua97f\\uac00-\\ud7ff\\ufb1d-\\ufb4f]+"


def skeleton(form: Column) -> Column:
    """Hash that is equal for all texts that the collation holds equal (and for some others): a blocking key."""
    plain = F.regexp_replace(F.translate(form, *_bases()), _VARIES, "")
    return F.xxhash64(F.when(form.rlike("[^\\x00-\\x7f]"), plain).otherwise(form))


def fields(items: DataFrame, key: str, names: list[str]) -> DataFrame:
    """field, key, text, mapped, form, block: one row for each non-blank value of the named columns."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])).alias("x")
    rows = items.select(F.col(key).alias("key"), each).select("key", "x.field", "x.text", F.inline(F.array(F.struct(mapped(F.col("x.text")).alias("mapped")))))
    form = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))  # 128 bits: two seeds
    return rows.filter("mapped is not null").select("field", "key", "text", "mapped", form.alias("form"), skeleton(F.col("mapped")).alias("block"))


def members(rows: DataFrame) -> DataFrame:
    """field, form, look: every stored form in blocks that hold several, with its class: the least stored member.

    All aggregates are partial before their shuffle: a text that a third of the rows share sends a row a task.
    """
    blocks = rows.groupBy("field", "block").agg((F.min("form") != F.max("form")).alias("several")).filter("several").select("field", "block")
    inside = spread_join(rows, blocks, ["field", "block"], "inner", ["key"])
    forms = cut_lineage(inside.groupBy("field", "form").agg(F.min("text").alias("text"), F.min("mapped").alias("mapped")))  # few: written once, read twice
    forms = forms.withColumn("look", F.expr("mapped collate UNICODE")).select("field", "form", "text", "look")
    least = forms.groupBy("field", "look").agg(F.min("text").alias("canonical"), F.count("*").alias("forms"))
    return forms.join(least, ["field", "look"]).select("field", "form", "canonical", "forms")


def canonical(rows: DataFrame) -> DataFrame:
    """field, key, canonical of every row of fields(); texts that look the same, and no others, are equal."""
    several = members(rows).filter("forms > 1").select("field", "form", "canonical")
    out = spread_join(rows.select("field", "key", "text", "form"), several, ["field", "form"], "left", ["key"])
    return out.select("field", "key", F.coalesce("canonical", "text").alias("canonical")).distinct()


def _odd(rows: DataFrame) -> DataFrame:
    """field, key, form, class of the rows whose class has several stored forms; equal rows once. class: 128 bits of the canonical text."""
    several = members(rows).filter("forms > 1").select("field", "form", F.struct(F.xxhash64("canonical").alias("a"), F.xxhash64(F.lit(1), "canonical").alias("b")).alias("class"), "canonical")
    return cut_lineage(spread_join(rows.select("field", "key", "form"), several, ["field", "form"], "inner", ["key"]).distinct())


def classes(rows: DataFrame) -> DataFrame:
    """field, canonical, forms, keys, links of every class with several stored forms.

    links: pairs of different keys with different forms, counted and not listed; the form for scale of seen_equal().
    """
    each = _odd(rows).groupBy("field", "class", "form").agg(F.min("canonical").alias("canonical"), F.count("*").alias("n"))
    out = each.groupBy("field", "class").agg(F.min("canonical").alias("canonical"), F.count("*").alias("forms"), F.sum("n").alias("keys"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("links"))
    return out.select("field", "canonical", "forms", "keys", "links")


def seen_equal(rows: DataFrame) -> DataFrame:
    """field, key_a, key_b: different keys whose values look the same but are stored differently.

    Only classes with several stored forms are paired, and equal forms are never paired. The most frequent form of a
    class is spread over salts, and the others are repeated for each: a hot text with an odd copy is no hot task.
    """
    inside = _odd(rows).drop("canonical")
    counts = inside.groupBy("field", "class", "form").agg(F.count("*").alias("n"))
    most = counts.groupBy("field", "class").agg(F.max_by("form", F.struct("n", "form")).alias("most"))
    inside = spread_join(inside, most, ["field", "class"], "inner", ["key"])
    big = inside.filter("form = most").select("field", "class", F.col("key").alias("one"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    rest = inside.filter("form <> most").select("field", "class", F.col("key").alias("two"), "form")
    spread = rest.select("field", "class", "two", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    crossed = big.join(spread, ["field", "class", "salt"]).filter("one <> two").select("field", "one", "two")
    a, b = rest.alias("a"), rest.alias("b")
    on = [F.col("a.field") == F.col("b.field"), F.col("a.class") == F.col("b.class"), F.col("a.two") < F.col("b.two"), F.col("a.form") != F.col("b.form")]
    among = a.join(b, on).select("a.field", F.col("a.two").alias("one"), F.col("b.two").alias("two"))
    return crossed.unionByName(among).select("field", F.least("one", "two").alias("key_a"), F.greatest("one", "two").alias("key_b")).distinct()
