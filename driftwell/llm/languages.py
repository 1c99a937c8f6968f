"""Language of each title and of each segment of a mixed one (problem 4).

Hierarchical discrimination. One-versus-one linear support vector machines over the language families come
first: they alone decide the family of each word run. Then, within each run, the one-versus-one machines of
that family alone decide the language; machines of other families have no say. Features are the character
n-grams of single words, so a machine's margin over a text is the sum of its words' margins, and the best
segmentation at either level is the path through the words with the greatest sum of margins less a price for
each change, lower at a separator. The script decides between the Japanese family and the others; Chinese
letters without kana are Japanese only if the labelled Japanese titles use them all.

A segment's confidence is calibrated: a logistic curve over the smaller of its two margins (of the family and
of the language over their runners-up), fitted on labelled titles that the machines were not fitted on. Some of these
labels are wrong, so the curve has a ceiling, the share of right labels; the confidence is the curve without it.

The machines are fitted at run time on at most TRAIN_ROWS titles whose labels name a language
(taken in the order of a hash, so the choice does not depend on the layout of the table), twice:
titles that the first fit holds mixed or mislabelled are left out of the second. All titles are then
classified where they are read; there is no shuffle but the one that makes equal copies one.

Defined results: a null, blank or wordless title, and one in a script of none of the languages, has no segment and is no
case; a code is compared without its region and in its two- and three-letter forms.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.lookalikes import LOOK_ALIKE

LANGUAGES = ("pt", "en", "fr", "es", "de", "ja")
FAMILIES = {"romance": ("pt", "fr", "es"), "germanic": ("en", "de"), "japonic": ("ja",)}
# What a label may call each language.
CODES = {
    "pt": "pt por portuguese português portugues", "en": "en eng english inglês ingles", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "de": "de deu ger german deutsch", "ja": "ja jpn jp japanese 日本語",
}
CODE_OF = {name: code for code, names in CODES.items() for name in names.split()}

#: Bound of the fit: at most so many labelled titles.
TRAIN_ROWS = 5000
WIDTH = 1 << 16
#: Share of the labelled titles (by hash) that calibrate the confidence.
HELD_OUT = 0.2
#: Price of a change of family, and of language within a family: inside a text, and at a separator.
CHANGE_FAMILY, CHANGE = (5.0, 3.0), (8.0, 5.0)
#: A single word's margin in one machine counts up to this.
LIMIT = 1.5
#: Weight of a word inside a name: names keep the spelling of their own language.
NAME_WEIGHT = 0.4
# Words that join the parts of a place's name.
JOINS = frozenset("de do da dos das del la le les los las sur sul am en el aux bains vieux".split())

_FOLD = str.maketrans({a: b for x, y in LOOK_ALIKE.values() for a, b in zip(x, y, strict=True)})
_CJK = "぀-ヿ㐀-鿿豈-﫿々〆ー"
_WORD = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
# a number of a notice at the end, in brackets, after a dash or (in Japanese) after a dot; marks of a second copy
_REFERENCE = re.compile(rf"(?:\s*[\[(][^\[\]()]{{0,30}}\d{{3,}}[^\[\]()]{{0,6}}[\])]|\s+[-–—]\s*[^\W\d]{{3,14}}\.?\s*\d{{3,}}|\s*・[{_CJK}]{{1,6}}\s*\d{{3,}}|\s*\*|\s+bis|\s*再掲|\s*\(\d\))\s*\Z", re.I)


def plain(title: str) -> str:
    """Without look-alikes, unseen characters and what follows the title proper."""
    if not title.isascii():
        title = unicodedata.normalize("NFKC", title.translate(_FOLD))
        title = "".join(c for c in title if unicodedata.category(c) != "Cf")
    if not title or not (title[-1] in "])*掲" or title[-1].isdigit() or title[-3:].lower() == "bis" or title[-1].isspace()):
        return title
    while (shorter := _REFERENCE.sub("", title)) != title:
        title = shorter
    return title


def label(code: str | None) -> str | None:
    """Language that a label names; null if it names none."""
    return CODE_OF.get(re.split(r"[-_]", code.strip().lower())[0]) if code else None


def ngrams(word: str) -> np.ndarray:
    """Feature numbers of a word: itself, its n-grams, its script."""
    if "぀" <= word[0]:
        parts = {"script:cjk", *word, *(word[i : i + 2] for i in range(len(word) - 1))}
    else:
        w = f"<{word}>"
        parts = {w, "script:latin", *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))}
    return np.array(sorted({zlib.crc32(p.encode()) % WIDTH for p in parts}), dtype=np.int64)


def words(text: str) -> list[tuple[str, bool]]:
    """(word in lower case, whether a separator stands before it) in order."""
    out, end = [], 0
    for m in _WORD.finditer(text):
        gap = text[end : m.start()]
        out.append((m.group().lower(), any(c in gap for c in "/|()[]:;·–—•><»«~+=") or " - " in gap or (end > 0 and ("぀" <= text[end - 1]) != ("぀" <= m.group()[0]))))
        end = m.end()
    return out


def name_weights(text: str) -> list[float]:
    """NAME_WEIGHT for capitalised words inside a text and the short words that join them, else 1.

    A text in which nearly all words are capitalised says nothing about names.
    """
    raw = [m.group() for m in _WORD.finditer(text)]
    big = [w[0].isupper() for w in raw]
    if not raw or sum(big) > 0.7 * sum("぀" > w[0] for w in raw):
        return [1.0] * len(raw)
    n = len(raw)
    inside = [big[i] and i > 0 for i in range(n)]
    joins = [raw[i] in JOINS and any(big[max(0, i - 2) : i]) and any(big[i + 1 : i + 3]) for i in range(n)]
    return [NAME_WEIGHT if inside[i] or joins[i] else 1.0 for i in range(n)]


def kana(text: str) -> bool:
    return any("぀" <= c <= "ヿ" for c in text)


def han(texts: list[str]) -> frozenset[str]:
    """Chinese letters of texts that have kana as well."""
    return frozenset(c for t in texts if kana(t) for c in t if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "々〆")


def best_path(each: list[tuple[float, ...]], breaks: list[bool], price: tuple[float, float]) -> list[int]:
    """The choice for each place with the greatest sum, less a price for every change (price[1] at a break)."""
    n = range(len(each[0]))
    best, back = list(each[0]), []
    for k in range(1, len(each)):
        top = max(n, key=best.__getitem__)
        switch = best[top] - price[breaks[k]]
        back.append([j if best[j] >= switch else top for j in n])
        best = [max(best[j], switch) + each[k][j] for j in n]
    at = max(n, key=best.__getitem__)
    path = [at]
    for row in reversed(back):
        at = row[at]
        path.append(at)
    return path[::-1]


def _over_runner_up(each: list[tuple[float, ...]], at: int) -> float:
    sums = [sum(x) for x in zip(*each, strict=True)]
    return sums[at] - max((s for j, s in enumerate(sums) if j != at), default=-math.inf)


class Machines:
    """One-versus-one linear machines: of the families, and of the languages in each family."""

    def __init__(self) -> None:
        self.families = list(FAMILIES)
        of_family = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        # the script tells the Japanese family from the others; its machines need no fit
        self.between = of_family([f for f in self.families if f != "japonic"])
        self.within = {f: of_family(langs) for f, langs in FAMILIES.items()}
        self.pairs = [(FAMILIES[a], FAMILIES[b]) for a, b in self.between] + [((a,), (b,)) for f in self.families for a, b in self.within[f]]
        self.weights = np.zeros((len(self.pairs), WIDTH), dtype=np.float32)
        self.curve = (1.0, 0.0)  # slope and offset of the confidence
        self.han: frozenset[str] = frozenset()  # letters that Japanese titles use
        self.known: dict[str, tuple[tuple[float, ...], dict[str, tuple[float, ...]]]] = {}

    def fit(self, texts: list[list[np.ndarray]], labels: list[str], epochs: int = 3, rate: float = 0.3, decay: float = 2e-4) -> "Machines":
        """Stochastic subgradient descent on the hinge loss, averaged; the order of the rows is fixed.

        The examples are the single words and the pairs of neighbours of each text, so that a margin
        means something for a few words; each side of a machine has the same total weight, so that
        words of no language (names) end near zero.
        """
        rows, ys = [], []
        for text, y in zip(texts, labels, strict=True):
            pairs = [np.concatenate(x) for x in zip(text[::2], text[1::2], strict=False)]
            rows += text + pairs
            ys += [y] * (len(text) + len(pairs))
        for k, (plus, minus) in enumerate(self.pairs):
            mine = [(r, 1.0 if y in plus else -1.0) for r, y in zip(rows, ys, strict=True) if y in plus or y in minus]
            ups = sum(y > 0 for _, y in mine)
            weight = {1.0: len(mine) / 2 / max(1, ups), -1.0: len(mine) / 2 / max(1, len(mine) - ups)}
            w, total, scale = np.zeros(WIDTH), np.zeros(WIDTH), 1.0
            rng = np.random.default_rng(k)
            for epoch in range(epochs):
                step = rate / (1 + 2 * epoch)
                for i in rng.permutation(len(mine)):
                    r, y = mine[i]
                    scale *= 1 - decay * step
                    if y * scale * w[r].sum() / len(r) < 1:
                        w[r] += step * y * weight[y] / scale
                total += w * scale
            self.weights[k] = total / epochs
        self.known = {}
        return self

    def margins(self, word: str) -> tuple[tuple[float, ...], dict[str, tuple[float, ...]]]:
        """Of one word: by family, and for each family by its languages."""
        if (known := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            japonic = "぀" <= word[0]
            raw = np.zeros(len(self.pairs)) if japonic else np.clip(self.weights[:, ngrams(word)].mean(axis=1), -LIMIT, LIMIT)
            vote = dict.fromkeys(self.families, -LIMIT if japonic else LIMIT) | {"japonic": 2 * LIMIT if japonic else -2 * LIMIT}
            for x, (a, b) in zip(raw, self.between, strict=False):
                vote[a] += float(x)
                vote[b] -= float(x)
            at, inside = len(self.between), {}
            for f, langs in FAMILIES.items():
                sums = dict.fromkeys(langs, 0.0)
                for a, b in self.within[f]:
                    sums[a] += float(raw[at])
                    sums[b] -= float(raw[at])
                    at += 1
                inside[f] = tuple(sums.values())
            known = self.known[word] = (tuple(vote.values()), inside)
        return known

    def scored(self, title: str | None) -> list[tuple[str, float, float]]:
        """(language, margin of its family, margin within the family) of each segment in order of appearance."""
        text = plain(title) if title else ""
        found = words(text)
        if not found:
            return []
        with_kana = kana(text)
        # a run of Japanese script stands for as many words as its length suggests
        weights = [max(1.0, len(w) / 2) if "぀" <= w[0] else v for (w, _), v in zip(found, name_weights(text), strict=True)]
        kept = [k for k, (w, _) in enumerate(found) if w[0] < "぀" or with_kana or self.han.issuperset(w)]
        if not kept:
            return []
        margins = [self.margins(found[k][0]) for k in kept]
        breaks, weights = [found[k][1] for k in kept], [weights[k] for k in kept]
        scaled = lambda m, v: m if v == 1 else tuple(v * x for x in m)
        each = [scaled(m[0], v) for m, v in zip(margins, weights, strict=True)]
        families = best_path(each, breaks, CHANGE_FAMILY)
        out, start = [], 0
        for k in range(1, len(kept) + 1):
            if k < len(kept) and families[k] == families[start]:
                continue
            # the family is settled: only its own machines speak now
            family = self.families[families[start]]
            inside = [scaled(m[1][family], v) for m, v in zip(margins[start:k], weights[start:k], strict=True)]
            path = best_path(inside, breaks[start:k], CHANGE)
            first = 0
            for j in range(1, len(path) + 1):
                if j == len(path) or path[j] != path[first]:
                    out.append((FAMILIES[family][path[first]], _over_runner_up(each[start + first : start + j], families[start]), _over_runner_up(inside[first:j], path[first])))
                    first = j
            start = k
        return out

    def confidence(self, family: float, language: float) -> float:
        slope, offset = self.curve
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, slope * min(family, language) + offset))))

    def segments(self, title: str | None) -> list[tuple[str, float]]:
        """(language, confidence) of each segment in order of appearance."""
        return [(name, self.confidence(f, m)) for name, f, m in self.scored(title)]

    def calibrate(self, titles: list[str], labels: list[str]) -> "Machines":
        """Curve of the confidence from held-out titles: right with a probability of ceiling x logistic(margin)."""
        seen = [(min(30.0, found[0][1], found[0][2]), found[0][0] == y) for t, y in zip(titles, labels, strict=True) if len(found := self.scored(t)) == 1]
        if len(seen) < 50:
            return self
        x, right = np.array([m for m, _ in seen]), np.array([float(r) for _, r in seen])
        least = math.inf
        for ceiling in np.linspace(0.8, 1.0, 41):
            for slope in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0):
                for offset in np.linspace(-2.0, 4.0, 13):
                    p = np.clip(ceiling / (1 + np.exp(-(slope * x + offset))), 1e-6, 1 - 1e-6)
                    loss = -float(np.sum(right * np.log(p) + (1 - right) * np.log(1 - p)))
                    if loss < least:
                        least, self.curve = loss, (slope, float(offset))
        return self


def train(items: DataFrame, title: str = "title", lang: str = "lang", rows: int = TRAIN_ROWS) -> Machines:
    """Machines fitted on at most *rows* labelled titles; titles found mixed or mislabelled are left out."""
    named = F.col(title).isNotNull() & F.lower(F.regexp_extract(F.trim(F.col(lang)), r"^[^-_]*", 0)).isin(list(CODE_OF))
    labelled = items.select(title, lang).filter(named)
    span = 2**62
    order = F.pmod(F.xxhash64(title, lang), F.lit(span))
    # a share of the hash range first: no task hands on more than the fit needs, however many there are
    share = int(span * min(1.0, 2.0 * rows / max(1, labelled.count())))
    some = [(r[0], label(r[1])) for r in labelled.filter(order <= share).orderBy(order, title, lang).limit(rows).collect()]
    some = [(t, y) for t, y in some if y]
    # the order is that of a hash, so the last ones are a sample as good as any
    held, some = some[len(some) - int(HELD_OUT * len(some)) :], some[: len(some) - int(HELD_OUT * len(some))]
    features = [[ngrams(w) for w, _ in words(plain(t))] for t, _ in some]
    first = Machines().fit(features, [y for _, y in some])
    kept = [i for i, (t, y) in enumerate(some) if [s[0] for s in first.segments(t)] == [y]]
    second = Machines().fit([features[i] for i in kept], [some[i][1] for i in kept])
    second.han = han([plain(some[i][0]) for i in kept if some[i][1] == "ja"])
    return second.calibrate([t for t, _ in held], [y for _, y in held])


def segments(items: DataFrame, key: str = "id", title: str = "title", lang: str = "lang", machines: Machines | None = None) -> DataFrame:
    """key, seg, lang, confidence, case of every segment of every title.

    case: the title mixes languages, or the label is missing or names another language.
    """
    machines = machines or train(items, title, lang)
    shared = items.sparkSession.sparkContext.broadcast((machines.weights, machines.curve, machines.han))  # a fixed size: pairs x WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machines()
        m.weights, m.curve, m.han = shared.value
        memo: dict[str, list[tuple[str, float]]] = {}
        for batch in batches:
            keys, segs, langs, sure, cases = [], [], [], [], []
            for k, t, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not t:
                    continue
                if (found := memo.get(t)) is None:
                    if len(memo) > 50_000:
                        memo.clear()
                    found = memo[t] = m.segments(t)
                case = len(found) > 1 or (found and label(code) != found[0][0])
                for n, (name, p) in enumerate(found, 1):
                    keys.append(k), segs.append(n), langs.append(name), sure.append(p), cases.append(bool(case))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(segs, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(cases, pa.bool_())], names=[key, "seg", "lang", "confidence", "case"])

    kind = dict(items.dtypes)[key]
    return items.select(key, title, lang).mapInArrow(run, f"`{key}` {kind}, seg int, lang string, confidence double, `case` boolean").distinct()
