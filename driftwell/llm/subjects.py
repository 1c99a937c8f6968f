"""Subject areas of documents (problem 9).

1. A complement naive Bayes classifier is trained from the labelled examples, sentence by sentence.
2. It is refined by expectation-maximisation over unlabelled documents. The hidden variable is the
   class of each kind of sentence (numbers, names and openings left out): a subject, or none. The
   expectation joins what the words say with what the other sentences of the documents say in which
   the kind occurs; a kind that goes with every subject alike (greetings, office news) is none. The
   maximisation fits the classifier again on examples and expected classes.
3. Each subject's posterior is calibrated on its own: a logistic curve over the margin of the
   subject's score, fitted on the kinds of sentences.

A document is about a subject if the sentences that are surely of that subject make up SHARE of its
text or more by length; a single sentence has to make up SINGLE, so one in passing does not count.

The fit takes all documents, and all examples up to EXAMPLES_BOUND. A text is read once: tasks note each
document as kinds of sentences and their lengths. Every round is a pass over these notes, which adds up
(in whole numbers, so in any order alike) what the documents say about each kind. The driver keeps the
kinds that differ, as arrays; it never gets a document.

Defined results: null, empty and wordless texts are about nothing; so are texts of greetings.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.lookalikes import LOOK_ALIKE
from driftwell.session import cut_lineage

#: Bound of the fit: at most so many labelled examples, in the order of a hash, so the choice does not depend on the layout of the table.
EXAMPLES_BOUND = 20_000
ROUNDS = 4
#: Least share of a document's text for a subject (SINGLE: if one sentence is all there is of it), and least posterior for a sentence to count.
SHARE, SINGLE, SURE = 0.15, 0.25, 0.9
#: How far (as a logarithm) a subject must stand out in the documents of a kind of sentence.
APART = 0.7
#: What is added up over documents is counted in units of 1 / UNIT.
UNIT = 2**30
#: Rows of a block of kinds that the driver works on at a time, and entries that a task's tables hold.
BLOCK, HELD = 50_000, 100_000

_FOLD = str.maketrans({a: b for x, y in LOOK_ALIKE.values() for a, b in zip(x, y, strict=True)})
_CJK = "぀-ヿ㐀-鿿豈-﫿々〆ー"
_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:[a-z]{2,8}|#\d{2,6});", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"'»)\]]+|(?<=[。！？])|\n+|[•|]+")
_OPENING = re.compile(rf"\A(?:[^:.]{{2,60}}?\s?[:：]\s+(?=\S)|[{_CJK}]{{1,6}}[:：]|なお、|[{_CJK}]{{1,10}}(?:より|によると)、|[{_CJK}]{{1,8}}、\d+年\d+月、)")
_OTHER_SCRIPT = re.compile("[\u0370-\u04ff]")
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text without markup, in one form of characters."""
    if not text:
        return []
    if not text.isascii():
        if _OTHER_SCRIPT.search(text):
            text = text.translate(_FOLD)
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[­​-‏⁠﻿]", "", text)
    return [s for part in _SENTENCE.split(_MARKUP.sub(" ", text)) if (s := part.strip())]


def told(sentence: str) -> str:
    """The sentence without its opening, numbers as one digit: sentences that are equal in this have equal tokens()."""
    return _NUMBER.sub("0", _OPENING.sub("", sentence))


def tokens(sentence: str) -> list[str]:
    """Lower-case words without numbers, names and an opening; pairs of letters of Japanese runs."""
    return tokens_of(told(sentence))


def tokens_of(body: str) -> list[str]:
    """tokens() of what told() left."""
    raw = _TOKEN.findall(body)
    latin = [w for w in raw if w[0] < "぀"]
    keep_big = sum(w[0].isupper() for w in latin) > 0.35 * len(latin)  # German, or capitals throughout
    out = []
    for i, w in enumerate(raw):
        if w[0] >= "぀":
            out += [w[k : k + 2] for k in range(len(w) - 1)] or [w]
        elif keep_big or i == 0 or not w[0].isupper():
            out.append(w.lower())
    return out


class Model:
    """Complement naive Bayes over subjects and none, with a logistic curve a subject."""

    def __init__(self, names: list[str]):
        self.names = names
        self.words: dict[str, np.ndarray] = {}
        self.slope, self.offset = np.full(len(names), 4.0), np.zeros(len(names))

    def fit(self, bags: "Bags", classes: np.ndarray) -> "Model":
        """classes: a row of class weights (subjects, then none) for each bag."""
        counts = np.zeros((len(bags.words), classes.shape[1]))
        for lo, hi, cols, rows in bags.blocks():
            for c in range(classes.shape[1]):
                counts[:, c] += np.bincount(cols, weights=classes[lo:hi, c][rows], minlength=len(counts))
        share = counts / np.maximum(counts.sum(axis=0), 1e-9)  # of each class, so that large classes do not drown others
        total = share.sum(axis=1, keepdims=True)
        smooth = 0.3 / max(1.0, counts.sum()) * classes.shape[1]
        complement = (total - share + smooth) / (classes.shape[1] - 1)
        own = share + smooth
        self.weight = np.log(own) - np.log(complement)
        self.words = {w: self.weight[k] for w, k in bags.words.items()}
        return self

    def scores(self, bags: "Bags") -> np.ndarray:
        """score() of all bags that were fitted."""
        out = np.zeros((len(bags), len(self.names) + 1))
        for lo, hi, cols, rows in bags.blocks():
            n = np.bincount(rows, minlength=hi - lo)
            for c in range(out.shape[1]):
                out[lo:hi, c] = np.bincount(rows, weights=self.weight[cols, c], minlength=hi - lo) / np.sqrt(n * np.maximum(4, n))
        return out

    def score(self, bag: list[str]) -> np.ndarray:
        """Mean weight by class (subjects, then none); zeros for a bag without known words."""
        known = [w for x in set(bag) if (w := self.words.get(x)) is not None]
        return np.sum(known, axis=0) / math.sqrt(len(known) * max(4, len(known))) if known else np.zeros(len(self.names) + 1)

    def margins(self, score: np.ndarray) -> np.ndarray:
        """Of each subject over the best other class; rows of scores give rows."""
        n = len(self.names)
        order = np.argsort(score, axis=-1)
        best, second = (np.take_along_axis(score, order[..., k : k + 1 or None], -1) for k in (-1, -2))
        return score[..., :n] - np.where(np.arange(n) == order[..., -1:], second, best)

    def posteriors(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(score) + self.offset, -30, 30)))

    def posterior(self, bag: list[str]) -> np.ndarray:
        """Of each subject on its own."""
        return self.posteriors(self.score(bag))

    def calibrate(self, bags: "Bags", truth: np.ndarray, weight: np.ndarray) -> None:
        """Logistic curves over the margins: slope and threshold of the least log loss on a grid."""
        margin = self.margins(self.scores(bags))
        for c in range(len(self.names)):
            x, y = margin[:, c], truth == c
            spread = max(1e-6, float(np.std(x)))
            best = np.inf
            for slope in (2.0, 4.0, 8.0, 16.0):
                for threshold in np.linspace(-0.5, 1.0, 16):
                    z = np.clip(slope * (x / spread - threshold), -30, 30)
                    loss = float(np.sum(weight * np.log1p(np.exp(np.where(y, -z, z)))))
                    if loss < best:
                        best = loss
                        self.slope[c], self.offset[c] = slope / spread, -slope * threshold


class Bags:
    """Bags of words as arrays: the different words of each."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.cols, self.ends = array("i"), array("q")

    def add(self, bag: Iterable[str]) -> None:
        self.cols.extend(self.words.setdefault(w, len(self.words)) for w in dict.fromkeys(bag))
        self.ends.append(len(self.cols))

    def __len__(self) -> int:
        return len(self.ends)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First bag, bag after the last, words, and the bag (counted from the first) of each word."""
        ends = np.concatenate([[0], np.frombuffer(self.ends, np.int64)]) if len(self) else np.zeros(1, np.int64)
        for lo in range(0, len(self), BLOCK):
            hi = min(len(self), lo + BLOCK)
            yield lo, hi, np.frombuffer(self.cols, np.int32)[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))


def kind_of(bag: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(bag).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def kinds_of(text: str | None, memo: dict[str, tuple[int, str] | None]) -> list[tuple[int, str, int]]:
    """(kind, bag, length) of every sentence that has words."""
    out = []
    for s in sentences(text):
        plain = told(s)  # sentences that differ in numbers and openings alone are read once
        if plain not in memo:
            if len(memo) > 2 * HELD:
                memo.clear()
            bag = tokens_of(plain)
            memo[plain] = (kind_of(bag), " ".join(bag)) if bag else None
        if found := memo[plain]:
            out.append((*found, len(s)))
    return out


def context(ids: np.ndarray, belief: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What documents say about the kinds in them: (places in *ids*, a row of sums for each; sums of the documents), in UNITs.

    ids: all kinds, sorted. belief: a row for each, by subject. kinds, lengths: sentences of documents that have *sizes* sentences.
    """
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros((0, belief.shape[1]), np.int64), np.zeros(belief.shape[1], np.int64)
    at = np.searchsorted(ids, kinds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.stack([np.bincount(doc, weights=b[at] * lengths, minlength=len(sizes)) for b in belief.T], axis=1)
    base = np.rint(total / np.maximum(1e-9, total.sum(axis=1, keepdims=True)) * UNIT).astype(np.int64).sum(axis=0)
    # the other sentences of each document that has the kind
    pair, which = np.unique(at * len(sizes) + doc, return_inverse=True)
    own, doc = pair // len(sizes), pair % len(sizes)
    rest = total[doc] - belief[own] * np.bincount(which, weights=lengths)[:, None]
    mass = rest.sum(axis=1)
    some = mass > 20
    if not some.any():
        return np.zeros(0, np.int64), np.zeros((0, belief.shape[1]), np.int64), base
    own, rows = own[some], np.rint(rest[some] / mass[some, None] * UNIT).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(rows, first, axis=0), base


Around = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def learn(examples: list[tuple[str, str]], kinds: Iterable[tuple[int, str, int]], around_of: Around, rounds: int = ROUNDS) -> tuple[Model, np.ndarray, np.ndarray]:
    """Model, kinds, and the subject that each is surely of (-1: none).

    examples: (subject, text). kinds: (kind, bag, documents that have it) of all unlabelled documents, sorted.
    around_of: context() added up over all documents, as a row for each kind, and the sums of the documents.
    """
    names = sorted({s for s, _ in examples})
    n = len(names)
    model = Model(names)
    gold, gold_class = [], []
    for subject, text in examples:
        for s in sentences(text):
            if bag := tokens(s):
                gold.append(bag), gold_class.append(names.index(subject))
    if not gold:
        return model, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread = defaultdict(set)
    for bag, c in zip(gold, gold_class, strict=True):
        for w in bag:
            spread[w].add(c)
    common = {w for w, cs in spread.items() if len(cs) > 3}
    known = {kind_of(b): c for b, c in zip(gold, gold_class, strict=True)}
    bags = Bags()
    for bag in gold:
        bags.add(bag)
    ids, size, fixed, covered = array("q"), array("d"), array("q"), array("d")
    for kind, joined, documents in kinds:
        bags.add(bag := joined.split(" "))
        ids.append(kind), size.append(documents), fixed.append(known.get(kind, -1))
        covered.append(sum(w in spread for w in bag if w not in common) / max(1, sum(w not in common for w in bag)))
    ids, size, fixed, covered = np.array(ids, np.int64), np.array(size), np.array(fixed, np.int64), np.array(covered)
    g, classes = len(gold), np.zeros((len(bags), n + 1))
    classes[np.arange(g), gold_class] = 1.0
    classes[g:, n] = 0.02
    model.fit(bags, classes)
    for turn in range(rounds):
        scores = model.scores(bags)[g:]
        words = np.exp(3.0 * (scores - scores.max(axis=1, keepdims=True, initial=-np.inf)))
        words /= np.maximum(words.sum(axis=1, keepdims=True), 1e-12)
        if turn == 0:
            # at first a kind is believed as far as its words are words that the examples tie to few subjects
            words[:, n] = 0  # nothing is known of none yet
            words /= np.maximum(words.sum(axis=1, keepdims=True), 1e-12)
            words *= covered[:, None] ** 2
            words[:, n] = 1 - words.sum(axis=1)
            belief = words.copy()
        # what the other sentences of its documents say about a kind
        around, base = around_of(ids, belief[:, :n].astype(np.float32))
        seen = around.sum(axis=1, keepdims=True)
        base = (base + 1) / (base.sum() + n)
        profile = (around + 2.0 * base) / (seen + 2.0)
        lift = np.log(profile / base)  # over the share that each subject has everywhere
        stands = np.hstack([lift, np.full((len(ids), 1), APART)])  # none: no subject stands out by much
        strength = np.minimum(8.0, np.sqrt(seen))
        log = np.log(np.maximum(words, 1e-6)) * 0.7 + stands * strength
        belief = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf))
        belief /= belief.sum(axis=1, keepdims=True)
        rows = np.where(fixed >= 0)[0]
        belief[rows] = 0
        belief[rows, fixed[rows]] = 1
        classes[g:] = belief * np.minimum(3.0, np.sqrt(size))[:, None] * 0.5
        model.fit(bags, classes)
    if not len(ids):
        return model, ids, fixed
    model.calibrate(bags, np.concatenate([gold_class, belief.argmax(axis=1)]), np.concatenate([np.ones(g), np.minimum(3.0, np.sqrt(size))]))
    post = model.posteriors(model.scores(bags)[g:])
    return model, ids, np.where(post.max(axis=1) >= SURE, post.argmax(axis=1), -1)


def train(examples: list[tuple[str, str]], texts: list[str], rounds: int = ROUNDS) -> Model:
    """fit() of texts in memory."""
    memo: dict[str, tuple[int, str] | None] = {}
    docs = [kinds_of(t, memo) for t in texts]
    bags = {k: b for d in docs for k, b, _ in d}
    size = Counter(k for d in docs for k in {k for k, _, _ in d})
    notes = np.array([k for d in docs for k, _, _ in d], np.int64), np.array([x for d in docs for _, _, x in d]), np.array([len(d) for d in docs], np.int64)

    def around_of(ids: np.ndarray, belief: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(belief.shape)
        at, rows, base = context(ids, belief, *notes)
        out[at] = rows / UNIT
        return out, base / UNIT

    return learn(examples, ((k, bags[k], size[k]) for k in sorted(bags)), around_of, rounds)[0]


def counted_shares(length: np.ndarray, times: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Shares from the letters and the number of each subject's sentences, and all letters."""
    out = length / np.maximum(total, 1)
    return np.where((times == 1) & (out < SINGLE), 0.0, out)


def shares(model: Model, text: str | None, memo: dict | None = None) -> np.ndarray:
    """Share of the text's letters that each subject's sentences make up; 0 for a lone one in passing."""
    if not model.names:
        return np.zeros(0)
    total, out, times = 0, np.zeros(len(model.names)), np.zeros(len(model.names))
    for s in sentences(text):
        plain = told(s)  # sentences that differ in numbers and openings alone are judged once
        top = memo.get(plain) if memo is not None else None
        if top is None:
            bag = tuple(tokens_of(plain))
            top = memo.get(bag) if memo is not None else None
            if top is None:
                post = model.posterior(list(bag)) if bag else None
                top = -2 if post is None else int(post.argmax()) if post.max() >= SURE else -1
            if memo is not None:
                if len(memo) > 200_000:
                    memo.clear()
                memo[plain] = memo[bag] = top  # a text and a tuple are never equal
        if top == -2:  # no words
            continue
        total += len(s)
        if top >= 0:
            out[top] += len(s)
            times[top] += 1
    return counted_shares(out, times, total)


def read_kinds(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Two kinds of rows from one reading of all texts.

    With ``kind`` null: key, kinds and lengths of the sentences of one document. Else: a kind, its bag and the
    number of a task's documents that have it.
    """
    schema = f"`{key}` {dict(documents.dtypes)[key]}, kinds array<bigint>, lengths array<int>, kind bigint, bag string, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bags, count, key_type = {}, {}, Counter(), None
        names = [key, "kinds", "lengths", "kind", "bag", "docs"]
        kinds_type, lengths_type = pa.list_(pa.int64()), pa.list_(pa.int32())

        def counted() -> pa.RecordBatch:
            n = len(count)
            return pa.RecordBatch.from_arrays([pa.nulls(n, key_type), pa.nulls(n, kinds_type), pa.nulls(n, lengths_type), pa.array(list(count), pa.int64()), pa.array([bags[k] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            rows, kinds, lengths = [], [], []
            for i, t in enumerate(batch.column(1)):
                if found := kinds_of(t.as_py(), memo):
                    rows.append(i), kinds.append([k for k, _, _ in found]), lengths.append([x for _, _, x in found])
                    bags.update((k, b) for k, b, _ in found)
                    count.update(set(kinds[-1]))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, kinds_type), pa.array(lengths, lengths_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
            if len(count) > HELD:  # what a task holds stays bounded; the rest is added up after the shuffle
                yield counted()
                bags, count = {}, Counter()
        if count:
            yield counted()

    return documents.select(key, text).mapInArrow(run, schema)


def _notes(batch: pa.RecordBatch, kinds: int, lengths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = batch.column(kinds).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(kinds).flatten().to_numpy(), batch.column(lengths).flatten().to_numpy(), sizes


def _learned(both: DataFrame, examples: DataFrame) -> tuple[Model, np.ndarray, np.ndarray]:
    """learn() from all documents. both: read_kinds()."""
    rows = examples.select("subject", "text").filter("subject is not null and text is not null").orderBy(F.xxhash64("subject", "text"), "subject", "text").limit(EXAMPLES_BOUND).collect()
    docs = both.filter("kind is null").select("kinds", "lengths")
    kinds = both.filter("kind is not null").groupBy("kind").agg(F.min("bag").alias("bag"), F.sum("docs").alias("docs")).orderBy("kind")
    context_ = both.sparkSession.sparkContext

    def around_of(ids: np.ndarray, belief: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = belief.shape[1]
        shared = context_.broadcast((ids, belief))  # a number for each kind and subject
        names = ["at", *(f"s{c}" for c in range(n))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, sums, base = context(*shared.value, *_notes(batch, 0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *(pa.array(np.append(sums[:, c], base[c])) for c in range(n))], names=names)

        got = docs.mapInArrow(run, ", ".join(f"{x} bigint" for x in names)).groupBy("at").agg(*[F.sum(x).alias(x) for x in names[1:]]).toArrow()
        shared.destroy()
        out = np.zeros((len(ids) + 1, n))  # the last row: the sums of the documents
        if len(got):
            out[got["at"].to_numpy()] = np.stack([got[x].to_numpy() for x in names[1:]], axis=1) / UNIT
        return out[:-1], out[-1]

    return learn(sorted((r[0], r[1]) for r in rows), ((r[0], r[1], r[2]) for r in kinds.toLocalIterator()), around_of)


def fit(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Model from all examples (up to a bound) and all documents."""
    return _learned(cut_lineage(read_kinds(documents, key, text)), examples)[0]


def _fitted_subjects(documents: DataFrame, examples: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """document_subjects() by a model of these documents: all their kinds are judged already."""
    both = cut_lineage(read_kinds(documents, key, text))  # holds no texts; read once a round
    model, ids, top = _learned(both, examples)
    shared = both.sparkSession.sparkContext.broadcast((model.names, ids, top))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, top = shared.value
        for batch in batches:
            kinds, lengths, sizes = _notes(batch, 1, 2)
            doc, part = np.zeros(0, np.int64), np.zeros((0, len(names)))
            if len(ids) and len(kinds):
                doc, of = np.repeat(np.arange(len(sizes)), sizes), top[np.searchsorted(ids, kinds)]
                cell = (doc * (len(names) + 1) + of + 1).astype(np.int64)
                by = lambda w: np.bincount(cell, weights=w, minlength=len(sizes) * (len(names) + 1)).reshape(len(sizes), -1)
                length = by(lengths)
                part = counted_shares(length[:, 1:], by(None)[:, 1:], length.sum(axis=1, keepdims=True))
            doc, c = np.nonzero(part >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([names[k] for k in c], pa.string()), pa.array(part[doc, c])], names=[key, "subject", "share"])

    return both.filter("kind is null").select(key, "kinds", "lengths").mapInArrow(run, f"`{key}` {kind}, subject string, share double")


def document_subjects(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, least: float = SHARE) -> DataFrame:
    """key, subject, share for each subject that a document is about; several rows, one or none a document."""
    if model is None:
        return _fitted_subjects(documents, examples, key, text, least)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the fit's rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for batch in batches:
            keys, subjects, parts = [], [], []
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                for name, part in zip(m.names, shares(m, t.as_py(), memo), strict=True):
                    if part >= least:
                        keys.append(k.as_py()), subjects.append(name), parts.append(float(part))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(subjects, pa.string()), pa.array(parts, pa.float64())], names=[key, "subject", "share"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, subject string, share double")
