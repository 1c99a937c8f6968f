"""Freely typed cities and countries to entries of reference lists (problem 3).

One automaton holds all names of all places (city, native name, other names) and the short forms
that a rule makes of them; it finds every mention embedded in a typed value in one pass. The
longest mentions that do not overlap win. Values in which no mention explains the words go to
token-set similarity: every word of an entry must have a partner in the value, equal or one typing
error away. Entries of one name are told apart by the typed country, then by a country or state in
the value itself, then by the zone typed beside it.

The reference lists are fixed (hundreds of rows; checked against LIST_BOUND before they are sent to
the tasks); events are matched where they are read, each distinct value once a task.

Defined results: null and blank cities are no case; a value that means no entry has place_id 0;
country_code is the typed country's code, else the place's country, else the empty string; a typed country that means
none is reported as such even if the place is known; equal rows count once.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.lookalikes import LOOK_ALIKE

#: Most rows a reference list may have to be sent to every task.
LIST_BOUND = 200_000
#: Share of a value's words that an entry must explain for a similar (not equal) value.
SIMILAR = 0.6

_FOLD = str.maketrans({a: b for x, y in LOOK_ALIKE.values() for a, b in zip(x, y, strict=True)})
# Short forms of the first word of a place's name.
SHORT = {
    "nova": "n", "novo": "n", "new": "n", "neu": "n", "north": "n", "porto": "pto p", "puerto": "pto p", "port": "pt p", "saint": "st", "sainte": "ste",
    "san": "s sn", "santa": "s sta", "santo": "s sto", "sao": "s", "vila": "v vl", "villa": "v vl", "mount": "mt", "mont": "mt", "monte": "mte mt", "fort": "ft",
    "bad": "b", "colonia": "col", "sint": "st", "south": "s", "east": "e", "west": "w", "ville": "v", "villeneuve": "vve vlle",
}


def fold(text: str) -> str:
    """Lower-case words without accents and signs, divided by single blanks; kana and Chinese letters stay."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text.translate(_FOLD)).casefold()).replace("ß", "ss").replace("œ", "oe")
    kept = (unicodedata.normalize("NFC", "".join(c for c in text if unicodedata.category(c) not in ("Cf",) and (unicodedata.category(c) != "Mn" or c in "゙゚"))))
    return " ".join(re.sub(r"[\W_]+", " ", kept).split())


def near(a: str, b: str) -> bool:
    """Whether one typing error at most (insertion, deletion, substitution, transposition) divides a and b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _cjk(word: str) -> bool:
    return bool(word) and "぀" <= word[0] <= "鿿"


class Countries:
    def __init__(self, rows: list[dict]):
        self.exact: dict[str, str] = {}
        self.names: list[tuple[str, str]] = []
        for r in rows:
            for name in (r["code"], r["iso3"], r["name_en"], r["name_local"], r["name_pt"]):
                if name and (key := fold(name)):
                    self.exact.setdefault(key, r["code"])
                    if len(key) > 3 and not _cjk(key):
                        self.names.append((key, r["code"]))
        self.exact.setdefault("uk", "GB") if "GB" in self.exact.values() else None

    def code(self, typed: str | None) -> str:
        """Code that a typed country means; empty if none."""
        if not typed:
            return ""
        flag = [chr(ord(c) - 0x1F1E6 + 65) for c in typed if 0x1F1E6 <= ord(c) <= 0x1F1FF]
        key = fold("".join(flag)) if len(flag) == 2 else fold(typed)
        if (code := self.exact.get(key) or self.exact.get(key.replace(" ", ""))) or len(key) < 4:
            return code or ""
        close = {code for name, code in self.names if near(key, name)}
        return close.pop() if len(close) == 1 else ""


class Places:
    def __init__(self, places: list[dict], countries: list[dict], zones: dict[str, str]):
        import ahocorasick

        self.countries = Countries(countries)
        self.rows = {p["place_id"]: p for p in places}
        self.zone_country = zones  # folded zone name -> country
        entries: dict[str, set[int]] = defaultdict(set)
        for p in places:
            for name in (p["city"], p["local_name"], *(p["other_names"] or [])):
                if name and (key := fold(name)):
                    entries[key].add(p["place_id"])
        short: dict[str, set[int]] = defaultdict(set)
        for key, ids in entries.items():
            head, _, tail = key.partition(" ")
            for s in SHORT.get(head, "").split() if tail else ():
                if f"{s} {tail}" not in entries:
                    short[f"{s} {tail}"] |= ids
            if key.startswith(("vila nova ", "villa nueva ")):
                tail = key.split(" ", 2)[2]
                for s in ("vn", "v n"):
                    for t in {tail, re.sub(r"^(?:de|da|do|del) ", "", tail)}:
                        if f"{s} {t}" not in entries:
                            short[f"{s} {t}"] |= ids
        self.entries = {**short, **entries}
        self.automaton = ahocorasick.Automaton()
        for key in self.entries:
            self.automaton.add_word(key, key)
        if self.entries:
            self.automaton.make_automaton()
        self.states = {fold(p["state"]): p["country"] for p in places if p["state"]}
        # words of the entries, by length and by each letter left out: partners one error away are found by lookup
        self.by_word: dict[str, set[str]] = defaultdict(set)
        for key in self.entries:
            for word in key.split():
                for part in self._parts(word):
                    self.by_word[part].add(key)

    @staticmethod
    def _parts(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 4 else {word}

    def mentions(self, value: str) -> list[str]:
        """Longest non-overlapping mentions in a folded value; the first of equal length wins."""
        found = []
        for end, key in self.automaton.iter(value) if self.entries else ():
            start = end - len(key) + 1
            bounded = (start == 0 or value[start - 1] == " ") and (end + 1 == len(value) or value[end + 1] == " ")
            if bounded or _cjk(key):
                found.append((len(key), start, key))
        taken, out = [], []
        for n, start, key in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(start + n <= a or start >= b for a, b in taken):
                taken.append((start, start + n))
                out.append(key)
        return out

    def similar(self, value: str) -> list[tuple[float, str]]:
        """(share of the value's letters, key) of entries whose every word has a partner in the value."""
        words = value.split()
        out = []
        for key in {k for w in words for part in self._parts(w) for k in self.by_word.get(part, ())}:
            rest, hit, changed = list(words), 0, 0
            names = key.split()
            for name in names:
                partner = next((w for w in rest if w == name), None) or next((w for w in rest if len(name) >= 3 and len(w) >= 3 and near(w, name)), None)
                if partner is None:
                    break
                rest.remove(partner)
                changed += partner != name
                hit += len(partner)
            else:
                if changed <= 1:
                    out.append((hit / max(1, len(value.replace(" ", ""))), key))
        glued = value.replace(" ", "")
        if not out and len(glued) >= 5:  # an error in the blanks themselves
            out = [(1.0, key) for part in self._parts(glued) for key in self.by_glued.get(part, ()) if near(glued, key.replace(" ", ""))]
        return sorted(set(out), key=lambda x: (-x[0], -len(x[1]), x[1]))

    @property
    def by_glued(self) -> dict[str, set[str]]:
        if not hasattr(self, "_glued"):
            self._glued = defaultdict(set)
            for key in self.entries:
                if " " in key:
                    for part in self._parts(key.replace(" ", "")):
                        self._glued[part].add(key)
        return self._glued

    def choose(self, key: str, value: str, country: str, zone: str | None) -> int:
        """Entry of a name that several places may share."""
        ids = sorted(self.entries[key])
        if len(ids) > 1:
            words = value.split()
            hints = [country, *(self.countries.exact.get(w, "") for w in words), *(self.states.get(w, "") for w in words), self.zone_country.get(fold(zone), "") if zone else ""]
            for hint in hints:
                if hint and (of := [i for i in ids if self.rows[i]["country"] == hint]):
                    return of[0]
        return ids[0]

    def match(self, city: str, country: str | None, zone: str | None = None) -> tuple[int, str, bool]:
        """(place_id or 0, country code or '', whether a country was typed that means none)."""
        code, value = self.countries.code(country), fold(city)
        place = 0
        if value:
            if value in self.entries:
                key = value
            else:
                found = self.mentions(value)
                key = found[0] if found else None
                close = self.similar(value)
                # a similar entry that explains more of the value than the mention: "X am Weider" is not "X"
                if close and close[0][0] >= SIMILAR and (key is None or len(close[0][1]) > len(key) + 1):
                    key = close[0][1]
                elif key is None and close and any(len(w) >= 5 for w in close[0][1].split()):
                    key = close[0][1]
            if key:
                place = self.choose(key, value, code, zone)
        return place, code or (self.rows[place]["country"] if place else ""), not code and bool(country and fold(country))


@dataclass(frozen=True)
class _Lists:
    sent: object  # a broadcast
    id: str  # the same in every task of a query

    @property
    def value(self) -> tuple:
        return self.sent.value


_MATCHERS: dict[str, Places] = {}


def _matcher(lists) -> Places:
    """One matcher a Python worker, however many tasks it runs."""
    if lists.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[lists.id] = Places(*lists.value)
    return _MATCHERS[lists.id]


def match_events(events: DataFrame, places: DataFrame, countries: DataFrame, key: str = "item_id") -> DataFrame:
    """key, city, country, place_id, country_code, matched, country_matched of every event whose city is neither null nor blank.

    matched: the city means an entry. country_matched: the typed country means one, or none was typed.
    """
    names = places.select("place_id", "city", "local_name", "country", "state", "tz", "other_names").limit(LIST_BOUND + 1).collect()
    codes = countries.select("code", "iso3", "name_en", "name_local", "name_pt").limit(LIST_BOUND + 1).collect()
    if max(len(names), len(codes)) > LIST_BOUND:
        raise ValueError(f"a reference list has more than {LIST_BOUND} rows")
    names, codes = sorted((r.asDict() for r in names), key=lambda r: r["place_id"]), [r.asDict() for r in codes]
    zones: dict[str, str] = {}
    for p in names:
        if p["tz"]:
            zones.setdefault(fold(p["tz"]), p["country"])
            zones.setdefault(fold(p["tz"].rpartition("/")[2]), p["country"])
    sent = events.sparkSession.sparkContext.broadcast((names, codes, zones))
    lists = _Lists(sent, uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, memo = _matcher(lists), {}
        for batch in batches:
            ids, cities, typed, zone = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for x in zip(cities, typed, zone, strict=True):
                if x not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[x] = matcher.match(*x)
                rows.append(memo[x])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[0] > 0 for r in rows], pa.bool_()), pa.array([not r[2] for r in rows], pa.bool_())], names=[key, "city", "country", "place_id", "country_code", "matched", "country_matched"])

    kind = dict(events.dtypes)[key]
    some = events.filter(F.col("city").rlike("(?U)[^\\s\\u200b-\\u200f\\u2060\\ufeff]")).select(key, "city", "country", "tz").distinct()
    return some.mapInArrow(run, f"`{key}` {kind}, city string, country string, place_id int, country_code string, matched boolean, country_matched boolean")
