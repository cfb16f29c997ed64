"""Operator 12: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon, how near its words stand to words of the second person, capitals,
punctuation and obfuscation.  The lexicon is learned: words and beginnings of words that documents labelled toxic have
far more often than others, with the logarithm of the odds as weight.  A training document's features come from a
lexicon that its own fold took no part in, as those of a new document do.  Trees are grown in numpy over binned
features; predictions for left-out folds are calibrated by pooling adjacent violators, interpolated between the pools.

Training takes a sample of labelled documents of at most about ``MAX_LABELLED`` rows, drawn by hash at a rate that
follows the table; only their dense features and the lexicon reach the driver.

Defined results: a null, empty or wordless text has features of zero and gets the score that the trees give these;
very long texts are read whole, their words in chunks; labels of a repeated id count as toxic if any is; repeated
documents are scored each; rows without an id are never learned from; without labels of both kinds every score is the
share of toxic labels; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, materialize, spread

#: Labelled documents that are learned from.
MAX_LABELLED = 20_000
#: Folds of the training documents, for lexicons and calibration.
FOLDS = 3
#: Entries of the lexicon; toxic documents that an entry is in at least; lengths of the beginnings of words that can be entries.
LEXICON, MIN_DOCS, BEGINNINGS = 4096, 3, (3, 4, 5, 6)
#: Weights from which a word is a hit, and a strong one.
HIT, STRONG = 1.5, 3.0
#: Words between a hit and a word of the second person that are near.
NEAR = 3
#: Trees, their depth, the learning rate, bins of a feature, hessian sum of a leaf, and the ridge of a leaf's value.
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 80, 3, 0.15, 32, 2.0, 1.0
THRESHOLD = 0.3
#: Words that a worker remembers, and words of a text taken at a time.
MEMO, CHUNK = 150_000, 1 << 16
#: Distinct entries that a task counts before it passes them on.
COUNTED = 400_000

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur thou thee thy du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos vosotros tú ti tus usted ustedes vuestro vuestra contigo".split()
)
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
PUNCTUATION = string.punctuation + "¡¿…«»„“”‚‘’"
LETTERS = re.compile(r"[^\W\d_]+")
LONG_DRAWN = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("log_words", "hit_rate", "weight_rate", "most_weight", "log_hits", "strong_rate", "log_strong", "second_person_rate", "near_share", "nearness", "capital_words", "capitals", "exclamations", "questions", "punctuation", "repeated_marks", "obfuscated", "obfuscated_hits", "long_drawn", "word_length")
#: What a single word has, in the order of its values.
WORD_VALUES = 13


class Word(NamedTuple):
    """The letters of a word in lower case, and whether signs inside stood for letters or apart."""

    letters: str
    obfuscated: bool


def cleaned(raw: str) -> Word:
    core = raw.strip(PUNCTUATION)
    low = core.lower()
    if low.isalpha() or not LETTERS.search(low):
        return Word(low if low.isalpha() else "", False)
    plain = "".join(LETTERS.findall(low.translate(SIGNS)))
    # digits at the end, hyphens and apostrophes are ordinary
    ordinary = re.fullmatch(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\d*", low) is not None
    return Word("".join(LETTERS.findall(low)) if ordinary else plain, not ordinary)


def entries(letters: str) -> list[str]:
    """What a word may be in the lexicon as: itself, or one of its beginnings."""
    return [f"={letters}", *(letters[:k] for k in BEGINNINGS if len(letters) > k)] if letters else []


class Words(dict):
    """Places in ``table``, the different values that words have, by word as it is written.

    Values: weight, hit, strong hit, second person, capitals only, capitals, letters, exclamation and question marks,
    other marks, repeated marks, obfuscated, long drawn.
    """

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        #: How words in the lexicon begin: most words need no further look.
        self.heads = {e.removeprefix("=")[:3] for e in lexicon}
        self.places: dict[tuple, int] = {}
        self.table = np.zeros((256, WORD_VALUES), np.float32)

    def __missing__(self, raw: str) -> int:
        # most words are letters, maybe with one mark behind
        end = raw[-1] if raw[-1] in "!?.,;:" and len(raw) > 1 else ""
        core = raw[:-1] if end else raw
        if core.isalpha():
            low = core.lower()
            letters, obfuscated = len(core), False
            marks, exclamations, questions = bool(end) and end not in "!?", end == "!", end == "?"
            repeated = False
        else:
            low, obfuscated = cleaned(raw)
            core, letters = raw, sum(map(str.isalpha, raw))
            exclamations, questions = raw.count("!"), raw.count("?")
            marks = sum(map(PUNCTUATION.__contains__, raw)) - exclamations - questions
            repeated = "!!" in raw or "??" in raw or "!?" in raw
        upper = 0 if core.islower() else sum(map(str.isupper, core))
        weight = max((self.lexicon.get(e, 0.0) for e in entries(low)), default=0.0) if low[:3] in self.heads else 0.0
        value = (weight, weight >= HIT, weight >= STRONG, low in SECOND_PERSON, upper > 1 and upper == letters, upper, letters, exclamations, questions, marks, repeated, obfuscated, LONG_DRAWN.search(core.lower()) is not None)
        place = self.places.get(value)
        if place is None:
            place = self.places[value] = len(self.places)
            if place == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[place] = value
        if len(self) >= MEMO:
            self.clear()  # the table stays: it is as small as its values are few
        self[raw] = place
        return place


class Extractor:
    """Dense features of texts by one lexicon (entry to weight)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = Words(lexicon)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        if not words:
            return [0.0] * len(FEATURES)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        values = self.words.table
        n, sums, most, both = len(words), np.zeros(WORD_VALUES), 0.0, 0.0
        for s in range(0, n, CHUNK):
            part = values[at[s : s + CHUNK]]
            sums += part.sum(axis=0, dtype=np.float64)
            most = max(most, float(part[:, 0].max()))
            both += float((part[:, 1] * part[:, 11]).sum())
        weight, hits, strong, second, capital, upper, letters, exclamations, questions, marks, repeated, obfuscated, drawn = sums.tolist()
        near_share = nearness = 0.0
        if hits and second:
            hit, you = np.flatnonzero(values[at, 1]), np.flatnonzero(values[at, 3])
            place = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(hit - you[np.minimum(place, len(you) - 1)]), np.abs(hit - you[np.maximum(place - 1, 0)]))
            near_share, nearness = float((gap <= NEAR).mean()), 1 / (1 + float(gap.min()))
        return [math.log1p(n), hits / n, weight / n, most, math.log1p(hits), strong / n, math.log1p(strong), second / n, near_share, nearness, capital / n, upper / max(letters, 1), exclamations / n, questions / n, marks / n, repeated / n, obfuscated / n, both / n, drawn / n, letters / n]


class Trees(NamedTuple):
    """Complete trees of one depth: the nodes' features and thresholds (at most: left), and the leaves' values."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.features)), np.int64)
        trees, rows = np.arange(len(self.features))[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.features[trees, at]] > self.thresholds[trees, at])
        return self.base + self.leaves[trees, at - (2**DEPTH - 1)].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logarithmic loss, by histograms of gradients."""
    n, width = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) + np.arange(width) * BINS
    cuts = np.array([np.r_[e, np.full(BINS - len(e), np.inf)] for e in edges])
    usable = np.isfinite(cuts)
    share = (y.sum() + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    margin = np.full(n, base)
    inner, features, thresholds, leaves = 2**DEPTH - 1, [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * BINS) + binned).ravel()
            left = [np.bincount(cell, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gr, hr) = left, [v[:, :, -1:] - v for v in left]
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gl + gr) ** 2 / (hl + hr + RIDGE)
            gain = np.where(usable & (hl >= LEAF) & (hr >= LEAF), gain, -np.inf).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(nodes), best] > 1e-6):
                feature[first + k], threshold[first + k] = best[k] // BINS, cuts.ravel()[best[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of adjacent violators: their mean margins, rising, and the share of toxic ones in each."""
    order = np.argsort(margins, kind="stable")
    pools: list[list[float]] = []  # sum of y, size, sum of margins
    for m, v in zip(margins[order].tolist(), y[order].tolist()):
        pools.append([v, 1, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([m / k for _, k, m in pools]), np.array([v / k for v, k, _ in pools])


class Model(NamedTuple):
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share[0])
        return np.interp(self.trees.margins(x), self.at, self.share)


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """A sample of the labelled documents outside ``held_out`` (over ``id``): ``part``, ``text`` and ``y``."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("id is not null and y is not null").where(~held_out)
    known = known.groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    space = 1 << 40
    rate = min(space, space * MAX_LABELLED // max(known.count(), 1))
    # of a bounded number of rows, so it may be sent to all tasks
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(space)) < rate))
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(drawn, "id")
    many = found.select("id").count()
    if many > 2 * MAX_LABELLED:  # ids repeat: rows are drawn, too
        found = found.where(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(space)) < space * MAX_LABELLED // many)
    return materialize(found.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("part"), F.coalesce("text", F.lit("")).alias("text"), "y"), "labelled")


def lexicon_counts(sample: DataFrame) -> DataFrame:
    """In how many documents of each kind and fold an entry is: ``entry``, ``toxic_<fold>``, ``other_<fold>``."""
    names = [f"{kind}_{k}" for kind in ("other", "toxic") for k in range(FOLDS)]

    def batch_of(counts: Counter) -> pa.RecordBatch:
        places, found = {}, []
        for (entry, place), k in counts.items():
            at = places.setdefault(entry, len(places))
            if at == len(found):
                found.append([0] * len(names))
            found[at][place] += k
        return pa.RecordBatch.from_arrays([pa.array(list(places), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*found))] if found else [pa.array([], pa.string()), *([pa.array([], pa.int64())] * len(names))], names=["entry", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        memo: dict[str, list[str]] = {}
        for batch in batches:
            for part, text, y in zip(*(c.to_pylist() for c in batch.columns)):
                own: set[str] = set()
                for w in set(text.split()):
                    if w not in memo:
                        memo[w] = entries(cleaned(w).letters)
                    own.update(memo[w])
                counts.update((e, part + FOLDS * (y > 0)) for e in own)
                if len(memo) > MEMO:
                    memo.clear()
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    schema = "entry string, " + ", ".join(f"{c} long" for c in names)
    return sample.select("part", "text", "y").mapInArrow(run, schema).groupBy("entry").agg(*(F.sum(c).alias(c) for c in names))


def lexicons(sample: DataFrame, sizes: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """Lexicons without each fold, and that of all: the entries that tell toxic documents best, with their weights."""
    toxic, other = (sum(v for (_, y), v in sizes.items() if y == kind) for kind in (1, 0))
    t, o = (F.expr(" + ".join(f"{kind}_{k}" for k in range(FOLDS))) for kind in ("toxic", "other"))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((o + 0.5) / (other + 1))
    best = lexicon_counts(sample).withColumns({"odds": odds, "rank": odds * F.sqrt(t.cast("double"))}).where((t >= MIN_DOCS) & (F.col("odds") >= HIT))
    rows = best.orderBy(F.desc("rank"), "entry").limit(LEXICON).collect()
    out = []
    for left_out in [*range(FOLDS), None]:
        parts = [k for k in range(FOLDS) if k != left_out]
        size = [sum(sizes.get((k, y), 0) for k in parts) for y in (0, 1)]
        found = {}
        for r in rows:
            t, o = (sum(r[f"{kind}_{k}"] for k in parts) for kind in ("toxic", "other"))
            weight = math.log((t + 0.5) / (size[1] + 1)) - math.log((o + 0.5) / (size[0] + 1))
            if t >= MIN_DOCS - (left_out is not None) and weight >= HIT:
                found[r["entry"]] = weight
        out.append(found)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None) -> Model:
    """A model from the labelled documents outside ``held_out`` (over ``id``; by default, fold 2 of 4)."""
    sample = labelled(docs, labels, fold("id", 4) == 2 if held_out is None else held_out, id_col, text_col, label_col)
    sizes = {(r["part"], r["y"]): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    toxic, all_rows = sum(v for (_, y), v in sizes.items() if y), sum(sizes.values())
    constant = Model({}, None, np.zeros(1), np.array([toxic / all_rows if all_rows else 0.0]))
    if not 0 < toxic < all_rows:
        return constant
    *left_out, whole = lexicons(sample, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Extractor(x) for x in left_out]
        for batch in batches:
            parts = batch.column(0).to_pylist()
            found = [own[p].features(t.as_py()) for p, t in zip(parts, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["part", "y", "x"])

    # numbers only, of a bounded number of rows; in one order, whatever the partitions
    rows = sorted(sample.select("part", "text", "y").mapInArrow(run, "part int, y int, x array<double>").collect(), key=lambda r: (r["part"], r["y"], r["x"]))
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["part"] for r in rows])
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        mine = part == k
        if mine.any():
            margins[mine] = grow(x[~mine], y[~mine]).margins(x[mine]) if 0 < y[~mine].sum() < (~mine).sum() else math.log((toxic + 0.5) / (all_rows - toxic + 0.5))
    return Model(whole, grow(x, y), *isotonic(margins, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model.lexicon)
        for batch in batches:
            found = np.array([extractor.features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            scores = model.scores(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
