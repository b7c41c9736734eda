"""MinHash near-duplicate detection with SetSketch registers (operator 12).

A document's set is its distinct shingles of five words (A-Z lower-cased; fewer words: the whole sequence). Two
documents are linked when the Jaccard similarity of their sets is 85/100 or more; classes are connected components.

Sketch (after Ertl, 2021). Every shingle runs a Poisson process that hits `REGISTERS` registers at random; a register
keeps the earliest hit of any shingle of the set, which is exponentially distributed with the size of the set as its
rate, on a scale of powers of `BASE`, cut to 16 bits. Registers of a union are the maxima of those of its parts, and
two sets agree in one with about their similarity as probability. Only hits before a time by which all registers are
likely to be hit are made, about a thousand a document however long it is; the few documents with a register left go on.

 1. Documents with equal sets are one node; all others of fewer than six shingles can be linked to nothing.
 2. Register values are banded, `ROWS` to a band. A pair of similarity 0.85 shares none of the `BANDS` bands in
    less than 1e-10 of the cases.
 3. In every bucket nodes are compared with its leader, the node that comes first in one order by hash, the same for all buckets, so
    a large class has few leaders. Candidates are estimated: the similarity that makes the registers' comparison (more, less, equal) most likely,
    jointly with both sizes, which are known. A pair goes if 0.85 is e^`DOUBT` times less likely than the estimate
    (six standard deviations).
 4. The others are verified on their full sets: the best of each node first, then those that are still in different classes.
 5. Buckets that hold nodes of several classes are left. In those of at most `BUCKET` nodes, nodes of different classes are compared, as in 3
    and 4. All nodes of larger ones meet by exact prefixes of their sets instead (after PPJoin, Xiao 2008): ordered by how many of these nodes have a
    shingle, linked sets have enough from their first shared shingle on. A family's members whose rarest shingles are their own meet
    nobody, and nodes of one class are never compared, so neither families nor copies are expanded into pairs. What is left are members so near
    the threshold that their own shingles don't fill a prefix, with those of other classes.

Sets are never joined to pairs: a verified pair's second set is streamed past the first (`against`), and only the verdict is written. A node with very
many partners is spread over several tasks.

Bounds: a task holds the sets of one Arrow batch and one more, which is 8 bytes a shingle. Nothing is collected, and the only broadcast is
`common.lookup`'s of at most a thousand counts.

Defined results: null text counts as empty; a document without words has no shingles, is linked with nothing, and is its own class
(`component_id` is its id); ids may repeat or be null: the class id is the smallest that isn't null (null where all are), and `kept` says whether a row's id is
that of its class, so rows of equal id and class are kept together; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import addressed, lookup, rows_of, table, workspace
from kerbsight.llm.compare import against, linked
from kerbsight.llm.simhash import shingles
from kerbsight.llm.words import slices
from kerbsight.operators.components import connected_components
from kerbsight.session import Workspace

SHINGLE = 5
PERCENT = 85
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
BASE, RATE = 1.001, 20
DOUBT = 18
LEAST = 6  # 6 of 7 shingles is the first similarity from 0.85 to below 1
BUCKET = 64
STEPS = 50  # classes of sizes, two hundredths wide
_ADDRESS = ["_src_file", "_src_row"]


# -- sketches -----------------------------------------------------------------------------


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes."""
    found = shingles(text, SHINGLE)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in found), np.uint64, len(found)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random bits for each number (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row of unsigned 16-bit numbers. Empty sets have zeros."""
    first = np.full((len(sets), REGISTERS), np.inf)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    todo, patience = np.flatnonzero(sizes), np.log(REGISTERS) + 4
    while len(todo):
        own = np.concatenate([sets[i] for i in todo])
        at = np.repeat(todo, sizes[todo])
        limit = np.repeat(patience / sizes[todo], sizes[todo])
        time, step = np.zeros(len(own)), 0
        flat = first.reshape(-1)
        while len(own):
            step += 1
            bits = _mixed(own + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((bits >> np.uint64(20)).astype(np.float64) + 0.5) / (1 << 44)) / REGISTERS
            alive = time <= limit
            own, at, limit, time, bits = own[alive], at[alive], limit[alive], time[alive], bits[alive]
            register = ((bits & np.uint64((1 << 20) - 1)) * np.uint64(REGISTERS) >> np.uint64(20)).astype(np.int64)
            np.minimum.at(flat, at * REGISTERS + register, time)
        todo = todo[np.isinf(first[todo]).any(axis=1)]
        patience *= 2
    with np.errstate(divide="ignore"):
        scale = np.floor(1 - np.log(first / RATE) / np.log(BASE))
    return np.clip(scale, 0, 65_535).astype(np.uint16)


def _hits(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater by a part x of the union."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(more, less, u, v, j) -> np.ndarray:
    up, down = _hits(np.maximum(u - v * j, 0)), _hits(np.maximum(v - u * j, 0))
    log = lambda p: np.log(np.maximum(p, 1e-300))
    return more * log(up) + less * log(down) + (REGISTERS - more - less) * log(1 - up - down)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of registers `a` against those of `b`: the most likely similarity, and how much less likely, as a
    logarithm, the threshold is."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    threshold = np.minimum(PERCENT / 100, high)
    for _ in range(40):  # the likelihood has one maximum
        third = (high - low) / 3
        left, right = low + third, high - third
        better = _likelihood(more, less, u, v, left) > _likelihood(more, less, u, v, right)
        low, high = np.where(better, low, left), np.where(better, right, high)
    best = (low + high) / 2
    return best, _likelihood(more, less, u, v, best) - _likelihood(more, less, u, v, threshold)


def mark(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, `size`, `digest` (of the set) and `registers` of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                sets = [shingle_set(x.as_py()) for x in batch.column("_text")]
                found = sketches([s if len(s) >= LEAST else s[:0] for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in keep),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) >= LEAST else None for r, s in zip(found, sets, strict=True)], pa.binary()),
                    ],
                    [*keep, "size", "digest", "registers"],
                )

    kinds = dict(rows.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in keep), "size bigint", "digest binary", "registers binary"]
    return rows.select(*keep, "_text").mapInArrow(run, ", ".join(schema))


# -- comparing ----------------------------------------------------------------------------


def _sketched(x: bytes) -> tuple[np.ndarray, int]:
    return np.frombuffer(x, np.uint16, REGISTERS), int.from_bytes(x[2 * REGISTERS :], "big")


def plausible(heads: list[bytes], which: np.ndarray, others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Registers followed by the size of the set: whether pairs may be linked, and their estimates."""
    first, second = ([_sketched(x) for x in own] for own in (others, heads))
    a, size_a = np.stack([x for x, _ in first]), np.array([n for _, n in first], np.float64)
    b, size_b = np.stack([x for x, _ in second]), np.array([n for _, n in second], np.float64)
    best, doubt = estimate(a, b[which], size_a, size_b[which])
    return (best >= PERCENT / 100) | (doubt <= DOUBT), best


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


class Classes:
    """Nodes, the verified edges between them, and the classes these make so far."""

    def __init__(self, ws: Workspace, rows: DataFrame, nodes: DataFrame):
        self.ws, self.rows, self.nodes = ws, rows, nodes
        size = F.unhex(F.lpad(F.hex("size"), 16, "0"))
        self.sketches = nodes.select("node", F.concat("registers", size).alias("own"))
        self.sets = ws.save("no-sets", ws.spark.createDataFrame([], "node bigint, own binary"))
        self.edges = ws.save("no-edges", ws.spark.createDataFrame([], "a bigint, b bigint"))
        self.roots = ws.spark.createDataFrame([], "node bigint, root bigint")

    def fetch(self, nodes: DataFrame) -> None:
        """Make the sets of those of distinct `nodes` that aren't there, from the texts."""
        missing = nodes.join(self.sets.select("node"), "node", "left_anti")
        at = self.ws.save("addresses", self.nodes.join(missing, "node").select("node", *_ADDRESS))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "_text"):
                    own = pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column("_text")], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("node"), own], ["node", "own"])

        texts = self.rows.join(at, _ADDRESS).select("node", "_text")
        self.sets = self.sets.unionByName(self.ws.save("shingle-sets", texts.mapInArrow(run, "node bigint, own binary")))

    def _verify(self, pairs: DataFrame) -> None:
        found = self.ws.save("verified", against(self.ws, pairs, self.sets, linked(PERCENT), ""))
        self.edges = self.edges.unionByName(found)
        both = self.ws.save("both", self.edges.unionByName(self.edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        nodes = both.select(F.col("a").alias("node")).distinct()
        self.roots = self.ws.save("roots", connected_components(self.ws, nodes, both))

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose nodes are in different classes."""
        for side in ("a", "b"):
            root = self.roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
            pairs = pairs.join(root, side, "left")
        return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")

    def link(self, pairs: DataFrame) -> None:
        """Estimate distinct `pairs(a, b)`, a written table, and verify what may be linked: for each a its best
        candidate first, then those that are still apart."""
        found = self.ws.save("plausible", against(self.ws, pairs, self.sketches, plausible, "estimate double"))
        self.fetch(_ends(found))
        best = F.max(F.struct("estimate", "b"))["b"]
        chosen = self.ws.save("chosen", found.groupBy("a").agg(best.alias("b")))
        self._verify(chosen)
        left = self._apart(found.join(chosen, ["a", "b"], "left_anti").select("a", "b"))
        left = self.ws.save("apart", left)
        if not left.isEmpty():
            self._verify(left)


def _close(x: Column, y: Column) -> Column:
    """Sizes that admit a link."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def bands(nodes: DataFrame) -> DataFrame:
    """`(bucket, node, size)`, a row for each band."""
    keys = [F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]
    return nodes.where(F.col("registers").isNotNull()).select(F.explode(F.array(*keys)).alias("bucket"), "node", "size")


def _met(members: DataFrame, fits: Column) -> DataFrame:
    """Distinct pairs, a < b, of `members(bucket, node, root, size, major, ...)` of different roots in a bucket. All pairs of two
    classes have one that isn't in the bucket's largest class, `major`."""
    others = members.where("root != major").drop("major")
    others = others.select("bucket", *(F.col(c).alias(f"o_{c}") for c in others.columns if c != "bucket"))
    meet = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("major")) | (F.col("node") < F.col("o_node")))
    pair = members.join(others, "bucket").where(meet & _close(F.col("size"), F.col("o_size")) & fits)
    return pair.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _several(ws: Workspace, level: DataFrame) -> DataFrame:
    """`(bucket, major, n)` of the buckets that hold several classes."""
    per = level.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    mixed = per.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("major"))
    return ws.save("mixed", mixed.where(F.col("n") > F.col("major.c")).select("bucket", F.col("major.root").alias("major"), "n"))


def prefixes(ws: Workspace, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """`(node, size, root, shingle, room)`: the first shingles of the sets of `nodes(node, size, root)`, by their number of these nodes, that
    others have too; `room` is what the set has from there on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    lists = sets.join(nodes.select("node"), "node", "left_semi").select("node", "own").mapInArrow(run, "node bigint, own array<bigint>")
    each = ws.save("shingles", lists.select("node", F.explode("own").alias("shingle")))
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = ws.save("shingle-counts", counts.withColumn("c", F.col("n")))
    shared = lookup(each, counts, "shingle", "n", each.count()).where("c IS NOT NULL")
    shared = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("own"))
    # those that no other node has come first
    placed = nodes.join(ws.save("shared", shared), "node").select("node", "size", "root", F.posexplode("own.shingle").alias("at", "shingle"), F.size("own").alias("k"))
    placed = placed.select("node", "size", "root", "shingle", (F.col("k") - F.col("at")).cast("bigint").alias("room"))
    return ws.save("prefixes", placed.where(100 * F.col("room") >= PERCENT * F.col("size")))


def prefix_pairs(ws: Workspace, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs, a < b, of nodes of different classes among `nodes(node, size, root)` that may be linked: all that are.

    What linked sets have from their first shared shingle on is enough for a link on both sides. The smaller set meets the larger one by
    this shingle and its class of sizes, so that the larger one shows as many shingles as a set of that size asks for, and no more."""
    first = prefixes(ws, nodes, sets)
    enough = lambda room, sizes: (100 + PERCENT) * room >= PERCENT * sizes
    of_size = lambda x: F.floor(F.log(x) * STEPS).cast("int")
    size, room = F.col("size"), F.col("room")
    small = first.where(enough(room, 2 * size)).withColumn("sizes", of_size(size)).withColumn("is_large", F.lit(False))
    # one class more at either end, and one less than the least size of a class, for what logarithms are off
    large = first.withColumn("sizes", F.explode(F.sequence(of_size(size * (PERCENT / 100)) - 1, of_size(size))))
    large = large.where(enough(room, size + F.exp(F.col("sizes") / STEPS) - 1)).withColumn("is_large", F.lit(True))
    level = small.unionByName(large).select(F.xxhash64("shingle", "sizes").alias("bucket"), "node", "size", "root", "room", "is_large")
    level = ws.save("level", level)
    members = level.join(_several(ws, level).select("bucket", "major"), "bucket")
    sides = F.when(F.col("is_large"), ~F.col("o_is_large") & (size >= F.col("o_size"))).otherwise(F.col("o_is_large") & (size <= F.col("o_size")))
    return _met(members, sides & enough(F.least("room", "o_room"), size + F.col("o_size")))


def cross_pairs(ws: Workspace, met: DataFrame, classes: Classes, bucket: int) -> DataFrame:
    """Distinct pairs, a < b, of nodes of different classes that share a bucket of `met(bucket, node, size)`. Nodes of crowded buckets meet each
    other by their prefixes instead."""
    level = met.join(classes.roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    level = ws.save("level", level)
    mixed = _several(ws, level)
    crowded = level.join(mixed.where(F.col("n") > bucket).select("bucket"), "bucket")
    crowded = ws.save("crowded", crowded.select("node", "size", "root").distinct())
    members = level.join(mixed.where(F.col("n") <= bucket).select("bucket", "major"), "bucket")
    members = members.join(crowded.select("node", F.lit(True).alias("is_crowded")), "node", "left")
    members = members.withColumn("is_crowded", F.coalesce("is_crowded", F.lit(False)))
    found = ws.save("met-pairs", _met(members, ~(F.col("is_crowded") & F.col("o_is_crowded"))))
    classes.fetch(crowded.select("node"))
    return found.unionByName(ws.save("prefix-pairs", prefix_pairs(ws, crowded, classes.sets)))


def near_duplicates(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, bucket: int = BUCKET) -> DataFrame:
    """One row per document: `(_id, size, component_id)`."""
    rows = addressed(ws, docs.select(id_col, text_col))
    picked = rows_of(rows, id_col, text_col).columns
    rows = rows.select(
        F.col(f"`{id_col}`").alias(picked[0]), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(picked[1]), *_ADDRESS
    )
    marked = ws.save("marked", mark(rows, ["_id", *_ADDRESS]))
    nodes = marked.where("size > 0").groupBy("digest").agg(
        F.max("size").alias("size"), F.count("*").alias("n"), F.min("_id").alias("first"),
        F.min(F.struct(*_ADDRESS)).alias("at"), F.max("registers").alias("registers"),
    )
    nodes = ws.save("set-nodes", nodes.select("*", "at.*", F.monotonically_increasing_id().alias("node")).drop("at"))

    members = bands(nodes)
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("leader"), F.col("size").alias("leader_size")))
    leaders = members.groupBy("bucket").agg(leader.alias("l"), F.count("*").alias("n")).where("n > 1")
    leaders = ws.save("leaders", leaders.select("bucket", "l.leader", "l.leader_size", "n"))
    total = BANDS * nodes.where(F.col("registers").isNotNull()).count()
    met = lookup(members, leaders, "bucket", "n", total).where("leader IS NOT NULL")
    met = ws.save("met", met)
    led = met.where((F.col("node") != F.col("leader")) & _close(F.col("size"), F.col("leader_size")))
    led = ws.save("led", led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())

    classes = Classes(ws, rows, nodes)
    classes.link(led)
    cross = cross_pairs(ws, met.select("bucket", "node", "size"), classes, bucket)
    tried = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    classes.link(ws.save("cross", cross.join(tried, ["a", "b"], "left_anti")))

    placed = nodes.select("node", "digest", "first", "n").join(classes.roots, "node", "left")
    placed = ws.save("placed", placed.select("digest", "first", "n", F.coalesce("root", "node").alias("root")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    found = lookup(placed, ws.save("firsts", firsts), "root", "m", placed.count()).select("digest", "component_id", "n")
    found = ws.save("classes", found.withColumn("known", F.lit(True)))
    both = lookup(marked.select("_id", "size", "digest"), found, "digest", "n", marked.count())
    return both.select("_id", "size", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(workspace(spark), table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        F.col("_id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
h AS (SELECT doc_id, list_transform(s, lambda x: hash(x)) AS h, len(s) AS n FROM s),
u AS (SELECT doc_id, n, unnest(h) AS x FROM h),
-- the rarest shingles, of which linked sets share one
p AS (
  SELECT doc_id, n, x FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k FROM u JOIN (SELECT x, count(*) AS c FROM u GROUP BY x) USING (x))
  WHERE k <= n - (85 * n + 99) // 100 + 1),
near AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
pairs AS (
  SELECT a, b, len(list_intersect(x.h, y.h)) AS common, x.n + y.n AS n FROM near JOIN h x ON x.doc_id = a JOIN h y ON y.doc_id = b),
half AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n - common)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT h.doc_id, h.n AS n_shingles, c.component_id, h.doc_id = c.component_id AS kept
FROM h JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
