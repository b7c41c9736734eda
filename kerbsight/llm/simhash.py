"""SimHash near-duplicate detection with pigeonring pruning (operator 5).

Fingerprints: A-Z is lower-cased, words are runs without white space, shingles are 3 words (fewer: the
whole sequence) with repeats; a bit is set when it is set in more than half of the shingles' XXH64
hashes (seed 42). Two texts are linked when their fingerprints differ in at most three bits; a class
is a connected component.

Candidates come from the pigeonring (Qin and Xiao 2018). Cut the 64 bits into a ring of four segments.
If two fingerprints differ in at most three bits, then from some segment on every chain of k consecutive
segments differs in at most 3k/4 bits: 0, then 1, 2 and 3. So a pair meets in the bucket of its first
segment's 16 bits, and is dropped unless its chain stays within 1 and then 2 bits, before the
full Hamming check.

A bucket with more than `BUCKET` fingerprints (in a very large input, all are; in any input, those of
near copies) isn't compared: the bits not yet matched are cut in four blocks again, of which one
must be equal too, and each fingerprint moves to four smaller buckets. This ends when at most
three bits are left, since fingerprints are distinct, and misses no pair. So the pairs compared are at
most `BUCKET` for each row of a bucket, at any size and however many near copies there are.

Equal fingerprints are one node of the graph, so copies cost nothing after the first grouping.

`keep_one`, the pipeline's stage, has another contract: shingles of five words and a similarity of 0.8
or more. Fingerprints and their links are its first step, checked on the sets; as three bits reach only almost
identical texts, an exact join adds the others (see below).

Defined results: a null text is an empty one and has fingerprint zero, as has any text without
words; the class id is the smallest id that isn't null (null where all are); repeated rows are
returned once each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import addressed, lookup, rows_of, table, without, workspace
from kerbsight.llm.compare import against, linked
from kerbsight.llm.words import slices
from kerbsight.operators.components import connected_components
from kerbsight.session import Workspace

RADIUS = 3
SEGMENTS = 4
BUCKET = 64
SHINGLE = 3


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    """In UTF-8; bytes know no lower case and no white space but those of ASCII."""
    words = text.encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash. Bits are counted a block of shingles at a time."""
    found = shingles(text, size)
    if not found:
        return 0
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(found), 4096):
        block = found[i : i + 4096]
        h = np.fromiter((digest(s, 42) for s in block), np.uint64, len(block))
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64
        )
    return int(np.packbits(count * 2 > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `rows` and `fp`, the fingerprint of `_text` as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(x.as_py()) for x in batch.column("_text"))
            fps = np.fromiter(found, np.uint64, len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(fps)], [*keep, "fp"]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp bigint"])
    return rows.select(*keep, "_text").mapInArrow(run, schema)


# -- candidates ---------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(mask: int) -> list[int]:
    """The zero bits of `mask` in four runs of nearly equal length, each as a mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_holds(start: Column, diff: Column) -> Column:
    """Whether the chain of segments from `start` on stays within its budgets. The first is equal
    by the bucket's key; the ring is turned so that the chain comes first."""
    width = 64 // SEGMENTS
    turn = start * width
    ring = F.when(start == 0, diff).otherwise(
        F.call_function("shiftrightunsigned", diff, turn).bitwiseOR(
            F.call_function("shiftleft", diff, F.lit(64) - turn)
        )
    )
    holds = F.lit(True)
    for k in range(2, SEGMENTS):
        low = F.lit(_signed((1 << (k * width)) - 1))
        holds &= F.bit_count(ring.bitwiseAND(low)) <= RADIUS * k // SEGMENTS
    return holds


def links(ws: Workspace, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs `(a, b)`, a < b, of distinct fingerprints `nodes(fp)` within the radius.

    `matched` is the mask of the bits that a bucket's fingerprints share, `start` the segment at which
    its chains begin. One pass of the loop splits the buckets that are too large.
    """
    table_of = [(i, m) for i, m in enumerate(_blocks(0))]
    level = nodes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("start"), F.lit(_signed(m)).alias("matched")) for i, m in table_of])
        ).alias("t"),
    ).select("fp", "t.*")
    found = []
    while True:
        key = F.col("fp").bitwiseAND(F.col("matched"))
        level = ws.save("buckets", level.withColumn("key", key))
        sizes = level.groupBy("start", "matched", "key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = ws.save("bucket-sizes", sizes)
        keys = ["start", "matched", "key"]
        # with three bits left all pairs are links, and there are at most eight fingerprints
        is_large = (F.col("n") > bucket) & (F.bit_count("matched") < 64 - RADIUS)
        small = level.join(sizes.where(~is_large).select(*keys), keys)
        right = small.withColumnRenamed("fp", "other")
        diff = F.col("fp").bitwiseXOR(F.col("other"))
        pair = small.join(right, keys).where(
            (F.col("fp") < F.col("other"))
            & chain_holds(F.col("start"), diff)
            & (F.bit_count(diff) <= RADIUS)
        )
        found.append(ws.save("links", pair.select(F.col("fp").alias("a"), F.col("other").alias("b"))))
        large = sizes.where(is_large)
        # masks are made by depth, not by data: at most four times as many with each level
        masks = [r.matched for r in large.select("matched").distinct().collect()]
        if not masks:
            break
        finer = [(m, _signed((m % (1 << 64)) | x)) for m in masks for x in _blocks(m % (1 << 64))]
        children = ws.spark.createDataFrame(finer, "matched bigint, finer bigint")
        level = (
            level.join(large.select(*keys), keys)
            .join(F.broadcast(children), "matched")
            .select("fp", "start", F.col("finer").alias("matched"))
            .distinct()  # a smaller bucket may lie in several larger ones
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(
    ws: Workspace, rows: DataFrame, keep: list[str], bucket: int = BUCKET
) -> DataFrame:
    """`rows` with `_id` and `_text` → one row each: the columns `keep`, `fp`, and `component_id`,
    the smallest id of the class."""
    marked = ws.save("fingerprints", fingerprints(rows, keep))
    total = marked.count()
    nodes = ws.save(
        "nodes", marked.groupBy("fp").agg(F.min("_id").alias("first"), F.count("*").alias("n"))
    )
    edges = ws.save("edges", links(ws, nodes.select("fp"), bucket))
    both = ws.save(
        "both", edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    linked = both.select(F.col("a").alias("node")).distinct()
    roots = connected_components(ws, linked, both)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    placed = ws.save("placed", placed)
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    # a root may have very many fingerprints
    classes = lookup(placed, firsts, "root", "m", placed.count()).select("fp", "component_id", "n")
    return lookup(marked, ws.save("classes", classes), "fp", "n", total).select(
        *keep, "fp", "component_id"
    )


# -- classes by the similarity of shingle sets ------------------------------------------------
#
# Two texts are linked when their sets of `shingle` words have a Jaccard similarity of 4/5 or more. First the sets'
# fingerprints are linked as above, by pigeonring chains, and each set is checked against the first of its class of
# fingerprints. No radius gives just the pairs that are wanted, so the others are found exactly, by prefixes: order the
# shingles of all texts in any one way; the first n - ceil(4n/5) + 1 of a set of n share one with those of every set linked to it.
# Frequent shingles, known from a sample, come last in the order, so few sets meet at one. Three steps more:
# each set that is not in one class with them yet is compared with one or two leaders of the shingles it meets others at, which joins large
# classes; sets that are in one class by then are compared no more; all others that meet are.
# Before the sets themselves are compared, sizes and parity bitmaps are: these differ in at most as
# many bits as the sets in elements, which is at most a ninth of both sizes. And the places of a shared shingle in both
# orders are: sets of about one size whose rarest shingles are their own are no pair (after PPJoin, Xiao 2008).
# Bitmaps of 256 bits say nothing of long texts, so pairs then meet by bitmaps that grow with the set, one to two bits an
# element, a 32nd to a 64th of the set itself; only what these admit is compared by sets, and only these sets are made.

SIMILAR_SHINGLE = 5
PARITY = [f"b{i}" for i in range(4)]
SAMPLE = 4_000
FREQUENT = 65_536
SALTS = 32
SLICE = 1 << 20  # bytes of text worked on at once


def shingle_set(text: str, size: int) -> np.ndarray:
    found = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in found), np.uint64, len(found)))


def parity_bitmap(own: np.ndarray) -> bytes:
    """Parities of the numbers of elements with the same lowest bits, one to two for each element and 64 at least, and the size."""
    width = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes() + len(own).to_bytes(8, "big")


def alike(heads: list[bytes], which: np.ndarray, others: list[bytes]) -> tuple[np.ndarray]:
    """A judge of parity bitmaps: whether their sets may be linked. True of all that are."""
    out = []
    for i, x in zip(which.tolist(), others, strict=True):
        few, many = sorted((x, heads[i]), key=len)
        a, b = (np.frombuffer(y, np.uint64, len(y) // 8 - 1) for y in (few, many))
        # the larger one folded to what the set has in as few bits
        differ = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
        out.append(9 * differ <= sum(int.from_bytes(y[-8:], "big") for y in (few, many)))
    return (np.array(out, bool),)


def set_fingerprint(own: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of hashes; zero if it is empty."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(own), 4096):
        bits = np.unpackbits(own[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(own), bitorder="little").view(np.uint64)[0])


def prefix_of(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set: infrequent ones by hash, then the others by count."""
    if not len(own):
        return own
    size = len(own) - (4 * len(own) + 4) // 5 + 1
    rank = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        rank = np.where(frequent[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[:size]]


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of over a thousandth of some rows, and their counts. They decide what is fast, not
    what is found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingle_set(x, shingle).view(np.int64))], ["s"])

    share = rows.count() // SAMPLE + 1
    some = rows.where(F.pmod(F.xxhash64("_src_file", "_src_row"), F.lit(share)) == 0)
    n = some.count()
    counts = some.select("_text").mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n"))
    top = counts.where((F.col("n") > 2) & (F.col("n") * 1000 >= n)).orderBy(F.desc("n"), "s").limit(FREQUENT)
    found = sorted((x.s % (1 << 64), x.n) for x in top.collect())
    return np.array([s for s, _ in found], np.uint64), np.array([k for _, k in found], np.int64)


def shingle_sets(rows: DataFrame, keep: list[str], shingle: int) -> DataFrame:
    """`keep`, `node` (a hash of the set), `size`, the parity bitmaps, the fingerprint and the prefix of each row."""
    index = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                nodes, sizes, bits, odds, fps, prefixes = [], [], [], [], [], []
                for x in batch.column("_text"):
                    own = shingle_set(x.as_py(), shingle)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0)
                    sizes.append(len(own))
                    odd = np.bincount(((own >> np.uint64(8)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                    bits.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                    odds.append(parity_bitmap(own))
                    fps.append(set_fingerprint(own))
                    prefixes.append(prefix_of(own, *index.value).view(np.int64))
                columns = np.array(bits, np.int64).reshape(-1, len(PARITY)).T
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in keep),
                        pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(np.ascontiguousarray(c)) for c in columns),
                        pa.array(odds, pa.binary()),
                        pa.array(np.array(fps, np.uint64).view(np.int64)),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    [*keep, "node", "size", *PARITY, "odd", "fp", "prefix"],
                )

    kinds = dict(rows.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in keep), "node bigint", "size bigint"]
    schema += [*(f"{b} bigint" for b in PARITY), "odd binary", "fp bigint", "prefix array<bigint>"]
    return rows.select(*keep, "_text").mapInArrow(run, ", ".join(schema))


def may_be_similar(left: str, right: str) -> Column:
    """What holds of all linked sets, by the columns of two prefixes."""
    x, y = F.col(f"{left}size"), F.col(f"{right}size")
    bits = [F.bit_count(F.col(f"{left}{b}").bitwiseXOR(F.col(f"{right}{b}"))) for b in PARITY]
    return (5 * F.least(x, y) >= 4 * F.greatest(x, y)) & (9 * sum(bits[1:], bits[0]) <= x + y)


def has_room(room: Column, left: str, right: str) -> Column:
    """Whether what ordered sets have from the place of a shared element on is enough for a link. It is at the first one that
    linked sets share."""
    return 9 * room >= 4 * (F.col(f"{left}size") + F.col(f"{right}size"))


def _with(ws: Workspace, pairs: DataFrame, side: str, facts: DataFrame) -> DataFrame:
    """`pairs`, a written table, with the facts of its nodes `side`, named `side_...`."""
    sizes = pairs.groupBy(side).agg(F.count("*").alias("_n"))
    named = facts.select(*(F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in facts.columns))
    return lookup(pairs, ws.save("facts", named.join(sizes, side)), side, "_n", pairs.count())


def sets_of(ws: Workspace, nodes: DataFrame, rows: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """`(node, own)` of some nodes: their sets, made from the texts anew."""
    # a written table: where it is small the texts are not shuffled
    at = ws.save("addresses", firsts.join(nodes, "node").select("node", "_src_file", "_src_row"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                own = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column("_text")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], ["node", "own"])

    texts = rows.join(at, ["_src_file", "_src_row"]).select("node", "_text")
    return ws.save("shingle-sets", texts.mapInArrow(run, "node bigint, own binary"))


def similar(ws: Workspace, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct `pairs(a, b)`, a written table, whose sets are similar."""
    return ws.save("similar", against(ws, pairs, sets, linked(80), ""))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _roots(ws: Workspace, edges: DataFrame) -> DataFrame:
    """`(node, root)` of the nodes that have edges."""
    both = ws.save("both", edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return connected_components(ws, both.select(F.col("a").alias("node")).distinct(), both)


def fingerprint_leaders(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """`(node, other)`: each of `nodes(node, fp)`, a written table, and the first node of its class of linked
    fingerprints, where that is another."""
    fps = nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    fps = ws.save("fingerprints", fps)
    roots = _roots(ws, ws.save("edges", links(ws, fps.select("fp")))).withColumnRenamed("node", "fp")
    placed = fps.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    placed = ws.save("placed", placed)
    leaders = placed.groupBy("root").agg(F.min("first").alias("other"), F.count("*").alias("m"))
    led = lookup(placed, ws.save("fp-leaders", leaders), "root", "m", placed.count()).select("fp", "other", "n")
    return lookup(nodes, ws.save("led-fps", led), "fp", "n", nodes.count()).where("node != other").select("node", "other")


def similar_classes(ws: Workspace, rows: DataFrame, shingle: int) -> DataFrame:
    """`rows(_id, _text, _src_file, _src_row)` without the text, and `root`, the same in all rows of a class."""
    address = ["_src_file", "_src_row"]
    at_sets = ws.path("sets")
    marked = ws.save_at(at_sets, shingle_sets(rows, ["_id", *address], shingle))
    firsts = marked.groupBy("node").agg(
        F.min(F.struct(*address)).alias("at"), F.count("*").alias("n"),
        *(F.max(c).alias(c) for c in ("size", *PARITY, "odd", "fp")),
    )
    firsts = ws.save("firsts", firsts.select("node", "n", "at.*", "size", *PARITY, "odd", "fp"))
    places = ws.save("places", marked.select("_id", *address, "node"))
    bitmaps = firsts.select("node", F.col("odd").alias("own"))
    facts = firsts.select("node", "size", *PARITY)
    members = marked.select("node", "size", F.posexplode("prefix").alias("pos", "bucket"))
    members = members.select("node", "bucket", (F.col("size") - F.col("pos")).cast("int").alias("room"))
    total = marked.agg(F.sum(F.size("prefix")).alias("n")).first().n or 0
    # the order of the members of a bucket is its own, so that leaders differ
    own = F.col("node").bitwiseXOR(F.col("bucket"))
    met = members.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("n"))
    met = met.where("n > 1").select("bucket", "n", *(F.col(c).bitwiseXOR(F.col("bucket")).alias(c) for c in ("low", "high")))
    met = lookup(members, ws.save("leaders", met), "bucket", "n", total)
    at_met = ws.path("met")
    met = ws.save_at(at_met, met.where("low IS NOT NULL").distinct())
    ws.drop(at_sets)  # the prefixes are large, and were needed to here

    def compared(pairs: DataFrame) -> DataFrame:
        """Of pairs of nodes those that the sizes, bitmaps and, where known, places admit."""
        pairs = ws.save("pairs", pairs.where("a != b").groupBy("a", "b").agg(F.max("room").alias("room")))
        half = ws.save("half", _with(ws, pairs, "a", facts))
        fits = F.coalesce(has_room(F.col("room"), "a_", "b_"), F.lit(True))
        return _with(ws, half, "b", facts).where(may_be_similar("a_", "b_") & fits).select("a", "b")

    def apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """Those pairs whose nodes are in different classes."""
        roots = ws.save("roots", _roots(ws, edges))
        for side in ("a", "b"):
            pairs = ws.save("led", _with(ws, pairs, side, roots))
        return ws.save("apart", pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))

    by_bits = fingerprint_leaders(ws, firsts.select("node", "fp"))
    by_bits = ws.save("near-bits", compared(by_bits.select(*_ordered("node", "other"), F.lit(None).cast("int").alias("room"))))
    pairs = met.select("node", "room", F.explode(F.array("low", "high")).alias("other"))
    near = ws.save("near-leaders", compared(pairs.select(*_ordered("node", "other"), "room")))
    near = ws.save("near-alike", against(ws, near, bitmaps, alike, ""))
    sets = sets_of(ws, _ends(by_bits.unionByName(near)), rows, firsts, shingle)
    edges = similar(ws, by_bits, sets)
    near = apart(near, edges)
    # one partner each, the same for many; the many are streamed past it
    chosen = near.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("b"))
    edges = edges.unionByName(similar(ws, ws.save("chosen", chosen), sets))
    edges = edges.unionByName(similar(ws, apart(near, edges), sets))

    roots = _roots(ws, edges)
    left = met.select("bucket", "node", "room").join(roots, "node", "left")
    at_left = ws.path("left")
    left = ws.save_at(at_left, left.select("bucket", "node", "room", F.coalesce("root", "node").alias("root")))
    ws.drop(at_met)
    mixed = left.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low != high")
    mixed = ws.save("mixed", mixed.select("bucket", "n"))
    left = lookup(left, mixed.withColumn("in", F.col("n")), "bucket", "n", left.count()).where("`in` IS NOT NULL")
    at_members = ws.path("mixed-members")
    left = ws.save_at(at_members, left.join(facts, "node"))
    ws.drop(at_left)
    # a large bucket is spread: each row is in one part on the left, in all on the right
    salts = F.least(F.lit(SALTS), F.ceil(F.col("in") / BUCKET)).cast("int")
    one = left.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    all_ = left.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    all_ = all_.select("bucket", "salt", *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "room", "size", *PARITY)))
    fits = has_room(F.least("room", "o_room"), "", "o_") & may_be_similar("", "o_")
    rest = one.join(all_, ["bucket", "salt"]).where(
        (F.col("node") < F.col("o_node")) & (F.col("root") != F.col("o_root")) & fits
    )
    rest = ws.save("rest", rest.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct())
    ws.drop(at_members)
    rest = ws.save("rest-alike", against(ws, rest, bitmaps, alike, ""))
    more = _ends(rest).join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(sets_of(ws, more, rows, firsts, shingle))
    edges = edges.unionByName(similar(ws, rest, sets))

    roots = firsts.select("node", "n").join(_roots(ws, edges), "node", "left")
    roots = ws.save("roots", roots.select("node", "n", F.coalesce("root", "node").alias("root")))
    return lookup(places, roots, "node", "n", places.count()).drop("node")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The rows of `docs`, all columns, with one of each class of similar texts: the first of those with
    the smallest id (a class of null ids: its first row)."""
    ws = workspace(spark)
    rows = addressed(ws, docs)
    picked = rows.select(
        F.col("doc_id").alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        "_src_file",
        "_src_row",
    )
    found = ws.save("near", similar_classes(ws, picked, shingle))
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_src_file", "_src_row")
    stays = found.groupBy("root").agg(F.min(first).alias("stay")).select("stay.*")
    dropped = found.select("_src_file", "_src_row").join(stays, ["_src_file", "_src_row"], "left_anti")
    return without(rows, ws.save("dropped", dropped), docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = workspace(spark), table(spark, sf_dir, "documents")
    found = near_duplicates(ws, rows_of(docs, "doc_id", "text"), ["_id"])
    return found.select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
