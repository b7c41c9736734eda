"""Benchmark decontamination by SimHash of item-sized windows (operator 4).

Words are runs of letters and digits, lower-cased; shingles are five words (an item of fewer words: the
whole item). A document's window for an item has as many words as the item; a document of
fewer words is one window as a whole. A window is contaminated
when its weighted shingle similarity to the item, sum of min over sum of max of the shingles' weights, is 0.8 or
more. A shingle weighs its count times ln(1 + items / items that have it), so what many items
share says little.

1. A window that shares no shingle with an item has similarity zero. So a document's shingle hashes are
   looked up in the items' first, and only windows around a hit are fingerprinted.
2. Window fingerprints (64-bit weighted SimHash) look up the items within 19 bits: the fingerprint is cut in
   four blocks of 16 bits, one of which must be within 4 bits. Tables that list the items
   for every block value within 4 bits of theirs give all of them, with one look-up per block.
3. The exact weighted similarity decides. At a true similarity of 0.8 about one fingerprint in a
   thousand differs in more than 19 bits; exact copies never differ.

Of overlapping windows for one item the most similar, then the first, is reported.

Items are taken in blocks of `ITEMS`, each one pass over the documents, so that what tasks hold of the
benchmark is bounded however large it is. Documents are never shuffled.

Defined results: null or empty texts and items match nothing; items without words are skipped; items of
equal text all match; null document ids are reported as null, repeated rows once each; an
empty table of either kind gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbsight.llm.common import addressed, arrow_type, rows_of, table, without, workspace
from kerbsight.llm.words import Gathered, Store, coded, slices

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
ITEMS = 1024
STORE = 60_000
_WORDS = re.compile(r"[^\W_]+")
_BLOOM = 1 << 20
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


_HASHES = Store(STORE)


def hashes_of(words: list[str]) -> list[bytes]:
    """The 64-bit hashes of the words in each run of characters without white space."""
    found = ([xxhash.xxh64_intdigest(w) for w in _WORDS.findall(x.lower())] for x in words)
    return [np.array(x, np.uint64).tobytes() for x in found]


def word_hashes(texts: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's end."""
    words = coded(pc.ascii_split_whitespace(pa.array(texts, pa.string())))
    found = Gathered(_HASHES.all(words.words, hashes_of), np.dtype(np.uint64), words.codes)
    return found.values, found.ends[words.offsets[1:]]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash per run of five words; fewer words give one hash of them all, none give none."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _FACTORS[k]
    return mixed(out)


@dataclass
class Item:
    item_id: object
    n_words: int
    weights: dict[int, float]  # shingle → weight times count
    total: float
    fingerprint: int = 0


def bits(h: np.ndarray) -> np.ndarray:
    """A row of 64 values, 1 or -1, for each hash."""
    found = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return found.astype(np.float64) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 weighted sums to 64-bit fingerprints."""
    return np.packbits(sums > 1e-9, axis=1, bitorder="little").view(np.uint64).ravel()


class Benchmark:
    """A block of items with its shingle and fingerprint indexes; `common` has the weight of every
    shingle of the whole benchmark."""

    def __init__(self, items: list[tuple[object, str]], common: dict[int, float], rare: float):
        self.common, self.rare = common, rare
        self.items: list[Item] = []
        self.holders: dict[int, list[int]] = {}
        for item_id, text in items:
            words, _ = word_hashes([text or ""])
            h = shingle_hashes(words)
            if not len(h):
                continue
            counts = Counter(h.tolist())
            weights = {s: n * common[s] for s, n in counts.items()}
            item = Item(item_id, len(words), weights, sum(weights.values()))
            sums = bits(h) * np.array([common[s] for s in h.tolist()])[:, None]
            item.fingerprint = int(fingerprints(sums.sum(0)[None])[0])
            if len(words) >= SHINGLE:
                for s in counts:
                    self.holders.setdefault(s, []).append(len(self.items))
            self.items.append(item)
        self.any_short = any(x.n_words < SHINGLE for x in self.items)
        self.shingles = np.sort(np.array(list(self.holders), np.uint64))
        self.bloom = np.zeros(_BLOOM, bool)
        self.bloom[(self.shingles & np.uint64(_BLOOM - 1)).astype(np.int64)] = True
        self.prints = np.array([x.fingerprint for x in self.items], np.uint64)
        self.blocks = [self.block_table(b) for b in range(BLOCKS)]

    def block_table(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For every 16-bit value the items whose block b is within the block's share of the radius,
        as offsets and item numbers."""
        width, most = 64 // BLOCKS, RADIUS // BLOCKS
        flips = np.array(
            [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)],
            np.uint32,
        )
        own = ((self.prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        values = (own[:, None] ^ flips).ravel()
        order = np.argsort(values, kind="stable")
        starts = np.searchsorted(values[order], np.arange((1 << width) + 1))
        return starts, (order // len(flips)).astype(np.int32)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of the shingles that some item has."""
        maybe = np.flatnonzero(self.bloom[(h & np.uint64(_BLOOM - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.shingles):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.shingles, h[maybe]), len(self.shingles) - 1)
        return maybe[self.shingles[at] == h[maybe]]

    def near(self, fps: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) for the items among `wanted` within the radius of a window's
        fingerprint, by the block tables."""
        width = 64 // BLOCKS
        found = []
        for b, (starts, numbers) in enumerate(self.blocks):
            value = ((fps >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            size = starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(fps)), size)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            item = numbers[np.repeat(starts[value], size) + inside]
            found.append(np.stack([window, item], axis=1)[np.isin(item, wanted)])
        pairs = np.unique(np.concatenate(found), axis=0)
        far = np.bitwise_count(fps[pairs[:, 0]] ^ self.prints[pairs[:, 1]])
        for (window, item), d in zip(pairs[far <= RADIUS].tolist(), far[far <= RADIUS].tolist(), strict=True):
            yield window, item, d

    def similarity(self, item: Item, window: list[int]) -> float:
        both = total = 0.0
        for s, n in Counter(window).items():
            own = item.weights.get(s, 0.0)
            here = n * self.common.get(s, self.rare)
            both += min(own, here)
            total += here
        return both / (total + item.total - both)

    def scan(self, texts: list[str] | pa.StringArray) -> Iterator[tuple[int, tuple]]:
        """(number of the text, match) for all contaminated windows of some texts."""
        words, ends = word_hashes(texts)
        h = shingle_hashes(words) if len(words) >= SHINGLE else words[:0]
        hits = self.hits(h)
        of = np.searchsorted(ends, hits, "right")
        inside = hits + SHINGLE <= ends[of] if len(hits) else hits.astype(bool)
        hits, of = hits[inside], of[inside]
        some = range(len(ends)) if self.any_short else np.unique(of).tolist()
        for i in some:
            a, z = int(ends[i - 1]) if i else 0, int(ends[i])
            own = hits[np.searchsorted(of, i) : np.searchsorted(of, i, "right")] - a
            for match in self.matches(words[a:z], h[a : max(a, z - SHINGLE + 1)], own):
                yield i, match

    def matches(
        self, words: np.ndarray, h: np.ndarray, hits: np.ndarray
    ) -> list[tuple[object, int, int, int, float]]:
        """(item id, first word, end word, distance, similarity) of a document's contaminated
        windows."""
        # windows that hold a hit of an item, by number of words
        wanted: dict[int, dict[int, set[int]]] = {}
        for p in hits.tolist():
            for i in self.holders[int(h[p])]:
                n = min(self.items[i].n_words, len(words))
                size = max(1, n - SHINGLE + 1)
                starts = wanted.setdefault(n, {}).setdefault(i, set())
                starts.update(range(max(0, p - size + 1), min(p, len(words) - n) + 1))
        found: dict[int, list[tuple[float, int, int]]] = {}
        for n, of in wanted.items():
            starts = np.array(sorted(set().union(*of.values())), np.int64)
            if not len(starts):
                continue
            size = max(1, n - SHINGLE + 1)
            for lo in range(0, len(starts), 2048):
                some = starts[lo : lo + 2048]
                first, end = int(some[0]), int(some[-1]) + size
                fps = self.window_prints(h[first:end], some - first, size)
                for w, i, d in self.near(fps, np.array(sorted(of), np.int32)):
                    at = int(some[w])
                    if at in of[i]:
                        s = self.similarity(self.items[i], h[at : at + size].tolist())
                        if s >= SIMILARITY - 1e-9:
                            found.setdefault(i, []).append((s, at, d))
        out = self.short(words)
        for i, windows in found.items():
            out += self.best(self.items[i], windows, len(words))
        return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))

    def window_prints(self, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of `size` shingles, from running sums over runs that
        overlap; windows far from each other don't pay for what lies between."""
        out = np.zeros(len(starts), np.uint64)
        cuts = np.flatnonzero(np.diff(starts) > size) + 1
        for run in np.split(np.arange(len(starts)), cuts):
            a, z = int(starts[run[0]]), int(starts[run[-1]]) + size
            part = h[a:z]
            weights = np.array([self.common.get(s, self.rare) for s in part.tolist()])
            sums = np.zeros((len(part) + 1, 64))
            np.cumsum(bits(part) * weights[:, None], axis=0, out=sums[1:])
            at = starts[run] - a
            out[run] = fingerprints(sums[at + size] - sums[at])
        return out

    def short(self, words: np.ndarray) -> list[tuple[object, int, int, int, float]]:
        """Items of fewer words than a shingle: their one shingle is looked up among the runs of as
        many words."""
        out = []
        for n in {x.n_words for x in self.items if x.n_words < SHINGLE}:
            if len(words) < n:
                continue
            runs = np.lib.stride_tricks.sliding_window_view(words, n)
            h = np.full(len(runs), n, np.uint64)
            for k in range(n):
                h += runs[:, k] * _FACTORS[k]
            h = mixed(h)
            for item in self.items:
                if item.n_words == n:
                    (own,) = item.weights
                    for at in np.flatnonzero(h == np.uint64(own)).tolist():
                        out.append((item.item_id, at, at + n, 0, 1.0))
        return out

    @staticmethod
    def best(item: Item, windows: list[tuple[float, int, int]], n_words: int) -> list[tuple]:
        """The most similar windows, of a document of `n_words`, that don't overlap a better one."""
        out: list[tuple] = []
        taken: list[int] = []
        for s, at, d in sorted(windows, key=lambda x: (-x[0], x[1])):
            if all(abs(at - x) >= item.n_words for x in taken):
                taken.append(at)
                out.append((item.item_id, at, min(at + item.n_words, n_words), d, s))
        return out


def shingle_weights(benchmark: DataFrame, item_id: str, text: str) -> tuple[dict[int, float], float]:
    """Weight of every shingle of the benchmark, and of one that it doesn't have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found = np.unique(shingle_hashes(word_hashes([x or ""])[0]))
                yield pa.record_batch([pa.array(found.view(np.int64))], ["shingle"])

    found = benchmark.select(F.col(text).cast("string")).mapInArrow(run, "shingle bigint")
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    n = benchmark.count()
    return counts, n


_MATCH = "start int, end int, distance int, similarity double"


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "_text",
    item_col: str = "item_id",
    item_text: str = "text",
    items: int = ITEMS,
) -> DataFrame:
    """The columns `keep` of `docs` and `(item_id, start, end, distance, similarity)` for every
    contaminated window, in words. The benchmark comes to the driver in blocks of `items` items."""
    spark = docs.sparkSession
    rows = benchmark.select(
        F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("t")
    ).where("t IS NOT NULL")
    counts, n = shingle_weights(rows, "item_id", "t")
    rare = math.log(1 + n)
    numbered = rows.orderBy("item_id", "t")
    found = []
    for offset in range(0, n, items):
        block = [(x.item_id, x.t) for x in numbered.offset(offset).limit(items).collect()]
        own = {s for _, t in block for s in shingle_hashes(word_hashes([t])[0]).tolist()}
        # at most the shingles of one block
        seen = spark.createDataFrame(
            [(np.uint64(s).astype(np.int64).item(),) for s in own] or [], "shingle bigint"
        )
        common = {
            int(np.int64(x.shingle).astype(np.uint64)): math.log(1 + n / x.n)
            for x in counts.join(seen, "shingle").collect()
        }
        index = spark.sparkContext.broadcast(Benchmark(block, common, rare))
        found.append(_one_block(docs, index, keep, text_col, rows))
    if not found:
        kinds = dict(docs.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"item_id {dict(rows.dtypes)['item_id']}", _MATCH])
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _one_block(
    docs: DataFrame, index, keep: list[str], text_col: str, benchmark: DataFrame
) -> DataFrame:
    own = arrow_type(benchmark, "item_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = index.value
        for batch in batches:
            place, rows, at = [], [], 0
            for part in slices(batch, text_col):
                for i, match in benchmark.scan(pc.fill_null(part.column(text_col), "")):
                    place.append(at + i)
                    rows.append(match)
                at += len(part)
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            kinds = (own, pa.int32(), pa.int32(), pa.int32(), pa.float64())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(place, pa.int64())) for c in keep),
                        *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True)),
                    ],
                    [*keep, "item_id", "start", "end", "distance", "similarity"],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"item_id {dict(benchmark.dtypes)['item_id']}", _MATCH])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that have no contaminated window."""
    ws = workspace(spark)
    rows = addressed(ws, docs)
    texts = rows.select("_src_file", "_src_row", F.col("text").cast("string").alias("_text"))
    found = find_matches(texts, benchmark, ["_src_file", "_src_row"])
    dropped = ws.save("contaminated", found.select("_src_file", "_src_row").distinct())
    return without(rows, dropped, docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated window; clean documents have none."""
    docs = rows_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"), ["_id"])
    return found.withColumnRenamed("_id", "doc_id")
