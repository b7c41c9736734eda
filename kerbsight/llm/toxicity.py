"""Toxicity scores of deobfuscated text (operator 9).

1. A character language model (interpolated trigrams) is counted over the words of all documents.
2. Noisy channel: a written token is a word whose characters were replaced by look-alikes, repeated,
   or set apart by signs or spaces. A token that looks written so is a lattice: every character may stand
   for itself, for the letters it resembles, for a repetition or for nothing, each at a cost; a space between
   single characters sets them apart or ends a word. Viterbi finds the reading of least cost, channel and
   language model together, of tokens and runs of any length.
3. Scores: a lexicon of words and word beginnings, weighted by log-odds between toxic and other labelled
   documents; a logistic regression on the strongest words of a document and their number.

Labels are learned from rows whose crc32(id as text) mod 5 isn't 0, and from at most `FIT_ROWS` of these
(the ids with the smallest hash), a bound by which they can be broadcast to the documents: the lexicon from
folds 1 to 3, the regression from fold 4. A document's score depends on its text alone.

What is broadcast is bounded by shares, not by the input's size: trigrams with at least one in 2^18 of
all occurrences, features with at least one in 2^15 of the toxic documents' (so at most four times
2^15). Counts themselves cover all documents.

Defined results: null or empty texts and texts without words get the score of no evidence; null ids are
scored and not held out; of several labels of an id the largest counts, null labels none; labels of one
class only, or none, give every document that class's share (0 without labels); repeated rows are
scored once each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import table, workspace
from kerbsight.llm.words import Store, coded, slices
from kerbsight.session import Workspace

FIT_ROWS = 50_000
GRAM_SHARE = 1 << 18
FEATURE_SHARE = 1 << 15
FOLDS = 5
STORE = 100_000
_SLICE = 3 << 20  # bytes of text worked on at once
_WORDS = 1 << 15  # words whose trigrams are counted at once
RULER = 40  # a longer run of one letter isn't a word
SETTLED = 1024  # characters after which a reading's common beginning is written

# Letters that signs and digits stand for
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
BETWEEN = set(".-_*~'`^:;,/\\#=")
REPLACED, REPEATED, APART, KEPT = 1.5, 1.0, 1.0, 6.0
_THRICE = re.compile(r"(.)\1\1", re.DOTALL)

_START, _END = 2, 3
_STRIP = "".join(BETWEEN | set("\"()[]{}<>?%&")) + "“”„«»¿¡…"
_SIGNS = tuple("!$+|(@")
_RUN_OF_SIGNS = re.compile(r"(?:!+|([$+|(@])\1+)$")  # at the end; a single sign may be a letter


# -- character language model -------------------------------------------------------------


def gram_counts(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words, with two marks before and one after, and how often they occur."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join(f"\x02\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    weight = np.repeat(counts, [len(w) + 3 for w in words])
    inside = c[2:] != _START
    grams = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside]
    grams, place = np.unique(grams, return_inverse=True)
    return grams, np.bincount(place, weights=weight[2:][inside]).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str) -> DataFrame:
    """`(gram, n)` over the plain words of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, _SLICE):
                texts = pc.fill_null(part.column(text_col), "")
                words = coded(pc.ascii_split_whitespace(texts))
                n = np.bincount(words.codes, minlength=len(words.words))
                plain = [w.strip(_STRIP).lower() for w in words.words]
                keep = [i for i, w in enumerate(plain) if w.isalpha() and not ruler(w)]
                for lo in range(0, len(keep), _WORDS):
                    some = keep[lo : lo + _WORDS]
                    grams, counts = gram_counts([plain[i] for i in some], n[some])
                    yield pa.record_batch([pa.array(grams), pa.array(counts)], ["gram", "n"])

    found = docs.select(text_col).mapInArrow(run, "gram bigint, n bigint")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated trigram model; costs are negative natural logarithms."""

    def __init__(self, grams: list[tuple[int, int]], weight: float = 5.0):
        low = (1 << 21) - 1
        three, two, one, before2, before1 = {}, {}, {}, {}, {}
        for gram, n in grams:
            a, b, c = gram >> 42, gram >> 21 & low, gram & low
            three[a, b, c] = n
            two[b, c] = two.get((b, c), 0) + n
            one[c] = one.get(c, 0) + n
            before2[a, b] = before2.get((a, b), 0) + n
            before1[b] = before1.get(b, 0) + n
        self.three, self.two, self.one = three, two, one
        self.before2, self.before1, self.weight = before2, before1, weight
        self.total = sum(one.values())
        self.known: dict[tuple[int, int, int], float] = {}

    def cost(self, a: int, b: int, c: int) -> float:
        key = (a, b, c)
        if (found := self.known.get(key)) is None:
            k = self.weight
            p = (self.one.get(c, 0) + 1e-3) / (self.total + 1)
            p = (self.two.get((b, c), 0) + k * p) / (self.before1.get(b, 0) + k)
            p = (self.three.get(key, 0) + k * p) / (self.before2.get((a, b), 0) + k)
            found = -math.log(p)
            if len(self.known) < STORE:
                self.known[key] = found
        return found


def ruler(word: str) -> bool:
    return len(word) > RULER and word == word[0] * len(word)


def suspicious(word: str) -> bool:
    """Letters with signs or digits among them, or a letter three times in a row, at any length."""
    if word.isalpha():
        return _THRICE.search(word) is not None and not ruler(word)
    return len(word) >= 3 and any(map(str.isalpha, word))


def readings(word: str) -> Iterator[list[tuple[str, float]]]:
    """For every character what it may stand for, and at what cost."""
    for i, c in enumerate(word):
        found = [(c, 0.0 if c.isalpha() else APART if c == " " else KEPT)]
        found += [(x, REPLACED) for x in LOOKS_LIKE.get(c, "")]
        if c in BETWEEN or c == " ":
            found.append(("", APART))
        if i and c == word[i - 1]:
            found.append(("", REPEATED))
        yield found


def _read(path: tuple | None) -> list[str]:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def restore(model: CharModel, word: str) -> str:
    """The reading of least cost; a kept space is a boundary of words. States are the last two characters, so the
    search is exact. What all readings begin with is written now and then, so that few characters are held."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_START, _START): (0.0, None)}
    settled: list[str] = []
    for i, options in enumerate(readings(word), 1):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for x, price in options:
                if x == " ":
                    key, total = (_START, _START), cost + price + model.cost(a, b, _END)
                    way = (x, path)
                elif x:
                    c = ord(x)
                    key, total = (b, c), cost + price + model.cost(a, b, c)
                    way = (x, path)
                else:
                    key, total, way = (a, b), cost + price, path
                if key not in after or total < after[key][0]:
                    after[key] = (total, way)
        states = after
        if i % SETTLED == 0:
            paths = {key: _read(path) for key, (_, path) in states.items()}
            shared = commonprefix(list(paths.values()))
            settled += shared
            for key, own in paths.items():
                path = None
                for x in own[len(shared) :]:
                    path = (x, path)
                states[key] = (states[key][0], path)
    ends = ((cost + model.cost(a, b, _END), path) for (a, b), (cost, path) in states.items())
    _, path = min(ends, key=lambda x: x[0])
    return "".join(settled + _read(path))


class Restorer:
    """Restored words by written token; an empty string where nothing is left."""

    def __init__(self, grams: list[tuple[int, int]]):
        self.model = CharModel(grams)
        self.known = Store(STORE)

    def word(self, token: str) -> str:
        word = token.lower().strip(_STRIP)
        if word.endswith(_SIGNS):
            word = _RUN_OF_SIGNS.sub("", word).strip(_STRIP)
        return restore(self.model, word) if suspicious(word) else word

    def words(self, texts: pa.StringArray) -> pa.ListArray:
        """The distinct restored words of each text. Four or more single characters in a row are
        read as one text as well, in which words end where that costs least."""
        tokens = coded(pc.ascii_split_whitespace(texts))
        found = self.known.all(tokens.words, lambda new: [self.word(t) for t in new])
        numbers: dict[str, int] = {}
        place = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets))
        pairs = [np.stack([text, place[tokens.codes]], 1)] if len(place) else []
        single = np.array([len(t) == 1 for t in tokens.words], bool)[tokens.codes]
        for i, j in self.runs(single, text):
            token = " ".join(tokens.words[c] for c in tokens.codes[i:j].tolist()).lower()
            for word in set(restore(self.model, token).split(" ")):
                pairs.append(np.array([[text[i], numbers.setdefault(word, len(numbers))]]))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        n = max(1, len(numbers))
        pairs = np.unique(pairs[:, 0] * n + pairs[:, 1])
        words = pa.array(list(numbers), pa.string())
        pairs = pairs[~pc.equal(words, "").to_numpy(zero_copy_only=False)[pairs % n]] if len(pairs) else pairs
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * n)
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.DictionaryArray.from_arrays(pa.array(pairs % n), words)
        )

    @staticmethod
    def runs(single: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """Runs of at least four single characters within a text."""
        if not single.any():
            return []
        run = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(single.astype(np.int8)) != 0)])
        starts = np.flatnonzero(run)
        ends = np.append(starts[1:], len(single))
        return [(i, j) for i, j in zip(starts.tolist(), ends.tolist(), strict=True) if single[i] and j - i >= 4]


def restore_words(docs: DataFrame, keep: list[str], text_col: str, grams) -> DataFrame:
    """The columns `keep` and `words`, the distinct restored words of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(grams.value)
            for part in slices(batch, text_col, _SLICE):
                found = restorer.words(pc.fill_null(part.column(text_col), ""))
                words = pa.ListArray.from_arrays(found.offsets, found.values.dictionary_decode())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), words], [*keep, "words"]
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "words array<string>"])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


# -- lexicon and score --------------------------------------------------------------------


def features(word: str) -> list[str]:
    """The word and its beginnings, marked, of four to six letters."""
    return [word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) > k)]


def count_features(words: DataFrame, only=None) -> DataFrame:
    """`(feature, n)`, counting each document's distinct words; `only` a broadcast set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = coded(batch.column("words"))
            n = np.bincount(found.codes, minlength=len(found.words)).tolist()
            wanted = only.value if only is not None else None
            pairs = [
                (f, k)
                for w, k in zip(found.words, n, strict=True)
                for f in features(w)
                if wanted is None or f in wanted
            ]
            names, counts = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.record_batch(
                [pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["feature", "n"]
            )

    found = words.select("words").mapInArrow(run, "feature string, n bigint")
    return found.groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Feature weights, and the regression's coefficients on `evidence`."""

    weights: dict[str, float]
    coefficients: np.ndarray
    constant: float | None = None  # the score where nothing could be learned

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        z = self.coefficients[0] + evidence @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


N_EVIDENCE = 5


def evidence(weights: dict[str, float], lists: pa.ListArray) -> np.ndarray:
    """Of each document the weights of its three strongest words, and the number and share of the
    words that speak for toxicity."""
    found = coded(lists)
    starts = {f[:4] for f in weights}  # which all features of a word share with it
    own = np.array(
        [max(weights.get(f, 0.0) for f in features(w)) if w[:4] in starts else 0.0 for w in found.words], float
    )
    out = np.zeros((len(lists), N_EVIDENCE))
    for i, (a, z) in enumerate(zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True)):
        if z > a:
            w = own[found.codes[a:z]]
            top = np.sort(np.partition(w, max(0, z - a - 3))[-3:])[::-1]
            out[i, : len(top)] = top
            strong = int((w > 2.0).sum())
            out[i, 3:] = math.log1p(strong), strong / math.sqrt(z - a)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; `ridge` keeps separable classes finite."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def labelled(labels: DataFrame) -> DataFrame:
    """At most `FIT_ROWS` ids that may be learned from, with their label `y`."""
    known = labels.where("y IS NOT NULL").groupBy("_id").agg(F.max("y").alias("y"))
    return known.where(fold("_id") != 0).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)


def learn(ws: Workspace, train: DataFrame) -> Model:
    """`train(words, y, fold)`, a written table → model."""
    spark = ws.spark
    sizes = {x.y: x.n for x in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n, bad = sum(sizes.values()), sizes.get(1, 0)
    if not bad or bad == n:
        return Model({}, np.zeros(N_EVIDENCE + 1), bad / n if n else 0.0)
    of = train.where(F.col("fold") != 4)
    toxic = ws.save("toxic-features", count_features(of.where("y = 1")))
    total = toxic.agg(F.sum("n").alias("n")).first().n or 0
    # at most FEATURE_SHARE times the features of a word
    often = toxic.where((F.col("n") >= 3) & (F.col("n") * FEATURE_SHARE >= F.lit(total)))
    often = {x.feature: x.n for x in often.collect()}
    other = count_features(of.where("y = 0"), spark.sparkContext.broadcast(set(often)))
    other = {x.feature: x.n for x in other.collect()}
    size = {x.y: x.n for x in of.groupBy("y").agg(F.sum(F.size("words")).alias("n")).collect()}
    ratio = math.log(((size.get(0) or 0) + 1) / ((size.get(1) or 0) + 1))
    weights = {
        f: w
        for f, k in often.items()
        if (w := math.log(k / (other.get(f, 0) + 0.5)) + ratio) > 1.0
    }
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = evidence(shared.value, batch.column("words"))
            columns = [pa.array(c) for c in x.T] + [batch.column("y")]
            yield pa.RecordBatch.from_arrays(columns, [*(f"x{i}" for i in range(N_EVIDENCE)), "y"])

    schema = ", ".join([*(f"x{i} double" for i in range(N_EVIDENCE)), "y int"])
    # a few numbers for each of at most FIT_ROWS ids
    sample = train.where("fold = 4").select("words", "y").mapInArrow(run, schema)
    rows = np.array(sorted(sample.collect()), float).reshape(-1, N_EVIDENCE + 1)
    y = rows[:, -1]
    if not len(y) or y.min() == y.max():
        return Model(weights, np.zeros(N_EVIDENCE + 1), bad / n)
    return Model(weights, fit(rows[:, :-1], y))


def scores(docs: DataFrame, text_col: str, grams, model: Model) -> DataFrame:
    """`docs` with `score`: texts are restored and judged where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(grams.value)
            for part in slices(batch, text_col, _SLICE):
                words = restorer.words(pc.fill_null(part.column(text_col), ""))
                found = shared.value.score(evidence(shared.value.weights, words))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.round(found, 9))], [*keep, "score"]
                )

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "score double"])
    return docs.mapInArrow(run, schema)


def score_toxicity(
    ws: Workspace,
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """The columns `keep` of `docs` and `_id`, `_text`, `score`. Texts are never shuffled."""
    rows = docs.select(
        *keep, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")
    )
    known = labels.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("y")
    )
    counts = ws.save("grams", count_grams(rows, "_text"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    # at most GRAM_SHARE trigrams have that share
    grams = counts.where(F.col("n") * GRAM_SHARE >= F.lit(total)).collect()
    grams = ws.spark.sparkContext.broadcast([(x.gram, x.n) for x in grams])
    # at most FIT_ROWS rows of an id and a label
    sample = rows.select("_id", "_text").join(F.broadcast(labelled(known)), "_id")
    train = restore_words(sample, ["_id", "y"], "_text", grams).withColumn("fold", fold("_id"))
    return scores(rows, "_text", grams, learn(ws, ws.save("train", train)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark)
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = score_toxicity(ws, docs, labels, [])
    return found.select(
        F.col("_id").alias("doc_id"),
        F.coalesce(fold("_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
