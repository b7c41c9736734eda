"""SentencePiece encoding with N-best segmentation, and decoding (operator 1).

The vocabulary's pieces span a lattice over the normalised text, and a segmentation scores the sum of
its pieces' scores in the model file. Forward Viterbi gives the best score from the start to every
position. A backward A* search from the end uses these scores as its heuristic: they are exact, so
complete paths leave the queue in order of their score and the N-best are the first N to
leave.

No piece spans two characters that stand side by side in no piece of the vocabulary. The lattice falls
apart at such places (before every word, around most punctuation), and the N-best of the whole
are sums of the N-best of its parts. So every part's lattice is solved once for a worker, and a text
combines stored answers: its best segmentation takes each part's best, and the others change the
parts that lose the least. A text without such places is one lattice, whose size is linear in
its length.

A character without a piece is unknown: it scores the lowest score of the vocabulary minus ten and is
written as its UTF-8 bytes' ids. Decoding joins pieces and bytes, and gives back every text in which
no U+2581 stands (the model writes spaces with it).

Defined results: a null text counts as empty; an empty text has one segmentation, without pieces; fewer
than N are returned where fewer exist; equal scores are ordered by where they first differ from
the best; repeated rows and null ids are returned as they are; an empty table gives no rows.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbsight.llm.common import rows_of, table
from kerbsight.llm.words import Coded, Gathered, Store, coded, slices

N_BEST = 3
STORE = 60_000
LONG_PART = 64
SHORT = 24  # characters of a text that is solved together with others
_TOGETHER = 4096
_SLICE = 3 << 20  # bytes of text whose segmentations are held at once
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_ROWS = 256  # rows of an outgoing batch, and decoded together

#: score, ids as int32 bytes
Found = tuple[float, bytes]


def combined(parts: list[list[Found]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums that take one score of each part: (score, which of each part)."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for part in parts:
        sums = ((s + x[0], (*c, i)) for s, c in out for i, x in enumerate(part))
        out = heapq.nsmallest(n, sums, key=lambda x: (-x[0], x[1]))
    return out


class Lattice:
    """Of one part of a text. An edge is (from, score, ids)."""

    def __init__(self, model: Pieces, text: str):
        self.size = len(text)
        self.ends: list[list[tuple[int, float, bytes]]] = [[] for _ in range(self.size + 1)]
        known, longest = model.known, model.longest
        for i in range(self.size):
            if (one := known.get(text[i])) is None:
                one = model.unknown(text[i])
            self.ends[i + 1].append((i, *one))
            for j in range(i + 2, min(i + longest, self.size) + 1):
                if (found := known.get(text[i:j])) is not None:
                    self.ends[j].append((i, *found))
        # forward Viterbi: the best score from the start, and the edge by which it is reached
        self.best = [0.0] * (self.size + 1)
        self.last: list[tuple[int, float, bytes]] = [(0, 0.0, b"")] * (self.size + 1)
        best = self.best
        for j in range(1, self.size + 1):
            top = None
            for edge in self.ends[j]:
                if top is None or best[edge[0]] + edge[1] > top:
                    top, self.last[j] = best[edge[0]] + edge[1], edge
            best[j] = top

    def n_best(self, n: int) -> list[Found]:
        """Backward A* search. A queue entry is (minus the score of the best whole path that ends
        in this suffix, tie-break, position, score of the suffix, linked ids of the suffix). Of a
        position's suffixes only the n best can be part of the n best paths: after n have left the
        queue the others are passed over, and what n better ones have been queued for isn't queued."""
        queue = [(-self.best[self.size], 0, self.size, 0.0, None)]
        out, made = [], 0
        left = [0] * (self.size + 1)
        queued: dict[int, list[float]] = {}  # the n best suffix scores of a position, least first
        while queue and len(out) < n:
            _, _, at, score, suffix = heapq.heappop(queue)
            if not at:
                ids = []
                while suffix is not None:
                    ids.append(suffix[0])
                    suffix = suffix[1]
                out.append((score, b"".join(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            # the Viterbi edge first, so that of equal scores the best path's comes out first
            first = self.last[at]
            for edge in [first, *(x for x in self.ends[at] if x is not first)]:
                made += 1
                total = score + edge[1]
                best = queued.setdefault(edge[0], [])
                if len(best) < n:
                    heapq.heappush(best, total)
                elif total > best[0]:
                    heapq.heapreplace(best, total)
                else:
                    continue
                heapq.heappush(
                    queue,
                    (-(total + self.best[edge[0]]), made, edge[0], total, (edge[2], suffix)),
                )
        return out


#: Best score, its ids, and by how much the second-best scores less (infinite: there is none)
Part = tuple[float, bytes, float]


class Decoder:
    """The bytes of all pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        text = [self.letters_of(m, i) for i in range(m.vocab_size())]
        self.sizes = np.array([len(x) for x in text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(text), np.uint8)

    @staticmethod
    def letters_of(model, i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            return b""
        return piece.replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids that end at `ends`: bytes of all pieces are gathered
        at once from the vocabulary's."""
        sizes = self.sizes[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(stops[-1]) + np.repeat(self.starts[ids] - stops[:-1], sizes)
        data, out, at = self.letters[place].tobytes(), [], 0
        for end in stops[ends].tolist():
            skip = data[at : at + 1] == b" " and end > at
            out.append(data[at + skip : end].decode("utf-8", "replace"))
            at = end
        return out


class Trie:
    """The vocabulary as a trie in arrays, to solve the lattices of many short texts at once."""

    def __init__(self, known: dict[str, tuple[float, bytes]]):
        chars = sorted({c for p in known for c in p})
        self.char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        node = {"": 0}
        keys, targets = [], []
        for piece in known:
            for i in range(1, len(piece) + 1):
                if piece[:i] not in node:
                    node[piece[:i]] = len(node)
                    keys.append(node[piece[: i - 1]] * self.width + int(self.char[ord(piece[i - 1])]))
                    targets.append(node[piece[:i]])
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.targets = np.array(targets, np.int64)[order]
        self.first = np.full(self.width, -1, np.int64)
        roots = self.keys < self.width
        self.first[self.keys[roots]] = self.targets[roots]
        self.score = np.full(len(node), np.nan)
        self.piece = np.full(len(node), -1, np.int32)
        for p, (score, data) in known.items():
            self.score[node[p]] = score
            self.piece[node[p]] = np.frombuffer(data, np.int32)[0]

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        key = nodes * self.width + chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (chars > 0), self.targets[at], -1)

    def edges(self, chars: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, nodes) of the lattices, by start and length. `chars` has a row per
        text, zero after its end."""
        n, size = chars.shape
        found = []
        for i in range(size):
            rows = np.flatnonzero(chars[:, i])
            nodes = self.first[chars[rows, i]]
            for j in range(i + 1, size + 1):
                rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
                if not len(rows):
                    break
                whole = self.piece[nodes] >= 0
                if whole.any():
                    found.append((i, j, rows[whole], nodes[whole]))
                if j < size:
                    nodes = self.step(nodes, chars[rows, j])
        return found

    def solve(self, texts: list[str]) -> list[Part | None]:
        """As `Pieces.solve`; None for a text with a character that isn't a piece."""
        if not texts:
            return []
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        n, size = len(texts), int(lens.max())
        codes = self.char[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        inside = np.arange(size) < lens[:, None]
        chars = np.zeros((n, size), np.int32)
        chars[inside] = codes
        alone = np.zeros(self.width, bool)
        alone[1:] = self.piece[self.first[1:]] >= 0
        fit = (alone[chars] | ~inside).all(axis=1)
        chars[~fit] = 0
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, size + 1), np.int64)
        last = np.zeros((n, size + 1), np.int32)
        edges = self.edges(chars)
        for i, j, rows, nodes in edges:
            total = best[rows, i] + self.score[nodes]
            up = total > best[rows, j]
            rows, nodes = rows[up], nodes[up]
            best[rows, j], back[rows, j], last[rows, j] = total[up], i, self.piece[nodes]
        # the best paths, from their ends; on[r, j]: the path enters position j
        ids = np.zeros((n, size), np.int32)
        steps, on = np.zeros(n, np.int64), np.zeros((n, size + 1), bool)
        rows = np.flatnonzero(fit & (lens > 0))
        at = lens[rows]
        while len(rows):
            on[rows, at] = True
            steps[rows] += 1
            ids[rows, size - steps[rows]] = last[rows, at]
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        after = np.full((n, size + 1), -np.inf)
        after[np.arange(n), lens] = 0.0
        top, gap = best[np.arange(n), lens], np.full(n, np.inf)
        for i, j, rows, nodes in reversed(edges):
            total = self.score[nodes] + after[rows, j]
            after[rows, i] = np.maximum(after[rows, i], total)
            beside = ~(on[rows, j] & (back[rows, j] == i))
            rows = rows[beside]
            gap[rows] = np.minimum(gap[rows], top[rows] - best[rows, i] - total[beside])
        flat = ids[np.arange(size) >= (size - steps)[:, None]].tobytes()
        ends = (np.cumsum(steps) * 4).tolist()
        found = zip(fit.tolist(), top.tolist(), [0, *ends], ends, gap.tolist(), strict=False)
        return [(t, flat[a:z], g) if ok else None for ok, t, a, z, g in found]


class Pieces:
    """A SentencePiece vocabulary, and the answers for parts seen so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.known: dict[str, tuple[float, bytes]] = {}
        self.bytes: dict[int, bytes] = {}
        for i in range(m.vocab_size()):
            piece, data = m.id_to_piece(i), np.int32(i).tobytes()
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = data
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.known[piece] = (m.get_score(i), data)
        self.unknown_id = np.int32(m.unk_id()).tobytes()
        self.lowest = min((x[0] for x in self.known.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.known), default=1)
        self.pairs = {p[i : i + 2] for p in self.known for i in range(len(p) - 1)}
        # a word can stand alone if no piece goes on with a space after another character
        self.words_apart = not any(p[1] == SPACE != p[0] for p in self.pairs)
        # every beginning of a piece; None if it isn't one itself
        self.tree: dict[str, tuple[float, bytes] | None] = {}
        for piece in self.known:
            for i in range(1, len(piece)):
                self.tree.setdefault(piece[:i], None)
        self.tree |= self.known
        self.stored: Store = Store(STORE, LONG_PART)  # by run of text
        self.lists: Store = Store(STORE // 10, LONG_PART)
        self.trie = Trie(self.known)

    def unknown(self, char: str) -> tuple[float, bytes]:
        if not self.bytes:
            return self.lowest, self.unknown_id
        return self.lowest, b"".join(self.bytes[b] for b in char.encode())

    def split(self, text: str) -> list[str]:
        """At the places that no piece spans."""
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def solve(self, text: str) -> Part:
        """Of a part: forward Viterbi, and backward scores for the gap. The second-best path leaves
        the best somewhere, so it is the least loss over all edges beside the best path, each
        with exact scores of both sides."""
        n, tree, edges = len(text), self.tree, []
        best, back, ids = [-np.inf] * (n + 1), [0] * (n + 1), [b""] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if not (found := tree.get(text[i], 0)):
                score, data = self.unknown(text[i])
                edges.append((i, i + 1, score))
                if here + score > best[i + 1]:
                    best[i + 1], back[i + 1], ids[i + 1] = here + score, i, data
            j = i + 1
            while found != 0:  # zero: no piece begins like this
                if found:
                    score, data = found
                    edges.append((i, j, score))
                    if here + score > best[j]:
                        best[j], back[j], ids[j] = here + score, i, data
                j += 1
                if j > n:
                    break
                found = tree.get(text[i:j], 0)
        path, on, at = [], set(), n
        while at:
            path.append(ids[at])
            on.add((back[at], at))
            at = back[at]
        after, top, gap = [-np.inf] * (n + 1), best[n], np.inf
        after[n] = 0.0
        for i, j, score in reversed(edges):
            total = score + after[j]
            if total > after[i]:
                after[i] = total
            if top - best[i] - total < gap and (i, j) not in on:
                gap = top - best[i] - total
        return top, b"".join(reversed(path)), gap

    def solve_short(self, texts: list[str]) -> list[Part | None]:
        """Distinct texts that are short and of known characters together; None for the others."""
        out: list[Part | None] = [None] * len(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        short = np.flatnonzero(lens <= SHORT)
        # by length: a batch takes as many steps as its longest text has characters
        short = short[np.argsort(lens[short], kind="stable")].tolist()
        for lo in range(0, len(short), _TOGETHER):
            some = short[lo : lo + _TOGETHER]
            for i, part in zip(some, self.trie.solve([texts[i] for i in some]), strict=True):
                out[i] = part
        return out

    def solve_all(self, chunks: list[str]) -> list[Part]:
        """The answers for distinct runs of text: of those that can't be solved whole, the parts."""
        out = self.solve_short(chunks)
        split = {i: self.split(c) for i, c in enumerate(chunks) if out[i] is None}
        texts = list({x for parts in split.values() for x in parts})
        parts = dict(zip(texts, self.solve_short(texts), strict=True))
        parts = {x: self.solve(x) if part is None else part for x, part in parts.items()}
        for i, of in split.items():
            scores, ids, gaps = zip(*(parts[x] for x in of), strict=True)
            out[i] = sum(scores), b"".join(ids), min(gaps)
        return out

    def n_best_of(self, text: str, n: int) -> list[Found]:
        if (found := self.lists.get((text, n))) is None:
            lists = [Lattice(self, x).n_best(n) for x in self.split(text)]
            found = [
                (s, b"".join(part[i][1] for part, i in zip(lists, choice, strict=True)))
                for s, choice in combined(lists, n)
            ]
            self.lists.keep({(text, n): found} if len(text) <= LONG_PART else {})
        return found

    def chunks(self, texts: list[str]) -> Coded:
        """The normalised texts, cut before the words where no piece goes on over a space."""
        norms = [self.model.normalize(t) if t else "" for t in texts]
        if not self.words_apart:
            return coded(pa.array([[x] if x else [] for x in norms], pa.list_(pa.string())))
        if all(not x or (x[0] == SPACE and SPACE * 2 not in x) for x in norms):
            # each but the empty ones begins with a space: what is before it is dropped
            lists = pc.split_pattern(pa.array([x[1:] if x else None for x in norms], pa.string()), SPACE)
            found = coded(pc.fill_null(lists, pa.scalar([], pa.list_(pa.string()))))
            return Coded([SPACE + w for w in found.words], found.codes, found.offsets)
        return coded(pa.array([_RUNS.findall(x) for x in norms], pa.list_(pa.string())))

    def n_best(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each raw text, best first: (score, ids)."""
        found = self.chunks(texts)
        parts = self.stored.all(found.words, self.solve_all)
        scores, arrays, gaps = zip(*parts, strict=True) if parts else ((), (), ())
        best = Gathered(list(arrays), np.dtype(np.int32), found.codes)
        own = np.array(scores, float)
        sums = np.concatenate([[0.0], np.cumsum(own[found.codes])])
        gaps = np.array(gaps, float)[found.codes]
        exact = np.abs(sums).max() < 2**53 and bool((own == np.floor(own)).all())
        out = []
        for a, z in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
            score = sums[z] - sums[a] if exact else sum(scores[c] for c in found.codes[a:z].tolist())
            ids = best.values[best.ends[a] : best.ends[z]]
            out.append([(float(score), ids)])
            changed = self.least(gaps[a:z], n - 1)
            lists = [self.n_best_of(found.words[found.codes[a + i]], n) for i in changed]
            rest = score - sum(x[0][0] for x in lists)
            for total, choice in combined(lists, n)[: n if changed else 0]:
                if any(choice):
                    pieces, at = [], best.ends[a]
                    for i, others, k in zip(changed, lists, choice, strict=True):
                        if k:
                            pieces += [best.values[at : best.ends[a + i]], np.frombuffer(others[k][1], np.int32)]
                            at = best.ends[a + i + 1]
                    pieces.append(best.values[at : best.ends[z]])
                    out[-1].append((float(rest + total), np.concatenate(pieces)))
            del out[-1][n:]
        return out

    @staticmethod
    def least(gaps: np.ndarray, n: int) -> list[int]:
        """Where the n least finite gaps are, the first of equal ones. Each segmentation but the best
        changes some parts, and the n best others change none but these."""
        if n < 1:
            return []
        if n < len(gaps):
            limit = np.partition(gaps, n - 1)[n - 1]
            below = np.flatnonzero(gaps < limit)
            ties = np.flatnonzero(gaps == limit)[: n - len(below)]
            places = np.sort(np.concatenate([below, ties]))
        else:
            places = np.arange(len(gaps))
        return places[np.isfinite(gaps[places])].tolist()


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One for each Python worker, kept from task to task."""
    return Pieces(path)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def nested(found: list[list[tuple[float, np.ndarray]]]) -> pa.Array:
    """An array of (score, ids) for each text."""
    flat = [x for of in found for x in of]
    ids = np.concatenate([np.zeros(0, np.int32), *(x for _, x in flat)])
    ends = pa.array(np.cumsum([0, *(len(x) for _, x in flat)]), pa.int32())
    fields = [pa.array([s for s, _ in flat], pa.float64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]
    each = pa.StructArray.from_arrays(fields, ["score", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), each)


def encode(rows: DataFrame, model: str, n: int = N_BEST, text_col: str = "_text") -> DataFrame:
    """The other columns of `rows`, and `n_best`: its segmentations, best first, with their score
    and ids."""
    keep = [c for c in rows.columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            for part in slices(batch, text_col, _SLICE):
                found = vocabulary.n_best([x or "" for x in part.column(text_col).to_pylist()], n)
                for i in range(0, len(part), _ROWS):
                    columns = [part.column(c).slice(i, _ROWS) for c in keep]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, nested(found[i : i + _ROWS])], [*keep, "n_best"]
                    )

    kinds = dict(rows.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in keep), "n_best array<struct<score:double,ids:array<int>>>"]
    return rows.select(*keep, text_col).mapInArrow(run, ", ".join(schema))


def decode(df: DataFrame, model: str, ids_col: str, text_col: str) -> DataFrame:
    """`df` with the text of its ids in `text_col`; null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = decoder(model)
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, len(batch), _ROWS)):
                lists = part.column(ids_col)
                ends = np.cumsum(np.array([len(x) if x.is_valid else 0 for x in lists], np.int64))
                found = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
                texts = [t if x.is_valid else None for t, x in zip(found, lists, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col]
                )

    kinds = [*df.dtypes, (text_col, "string")]
    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds))


def encode_documents(docs: DataFrame) -> DataFrame:
    """One row per document and segmentation with its rank, score, size and checksum, and whether decoding it
    gives back the text (a checksum of the text travels along instead of the text)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = rows_of(docs, "doc_id", "text")
    rows = rows.withColumn("_sum", F.xxhash64(F.replace(F.col("_text"), F.lit(SPACE), F.lit(" "))))
    each = encode(rows, model).select("_id", "_sum", F.posexplode("n_best").alias("at", "x"))
    each = each.select("_id", "_sum", (F.col("at") + 1).alias("rank"), "x.score", "x.ids")
    decoded = decode(each, model, "ids", "_decoded")
    return decoded.select(
        F.col("_id").alias("doc_id"),
        "rank",
        F.col("score").cast("bigint").alias("score"),
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.lower(F.lpad(F.hex(F.xxhash64("ids")), 16, "0")).alias("ids_xxh64"),
        (F.xxhash64("_decoded") == F.col("_sum")).alias("decodes"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
