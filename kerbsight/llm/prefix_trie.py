"""Conversation prefix trie by truncation peeling (operator 13).

A node of depth d is a distinct sequence of the first d turns of some conversations, its members. It is known by a
chain of digests: a turn's key is the SHA-256 of the key before it and of the turn's own digest (cut to 16
bytes), so texts are read once and only digests are shuffled.

Peeling starts at the greatest depth. What survives of the deeper nodes is put beside the conversations that
end here, both are grouped by key, and every group is a node: its members, children, leaves and saved tokens are
sums over what was merged into it, so discovering a node and aggregating its subtree are one pass. Then the
last turn is stripped from each survivor's path, and its parent's key is what is left. Depths at which no conversation ends
and no two survivors meet are peeled together, since each of their nodes is the child's only parent:
a conversation of ten thousand turns costs no rounds of its own. A round is one shuffle of the surviving
nodes; the number of rounds is that of depths at which conversations end or merge.

Bounds: a task holds the digests and word counts of one conversation (28 bytes a turn), and texts of one Arrow batch;
a common beginning or conversation is combined map-side. A parent with very many children is
looked up through `common.lookup`. The ids that end in one node are first joined in blocks of 65,536 consecutive ids, since ids are distinct, and
then hashed block after block: SHA-256 takes them in order, so one task streams a node's ids.

`rebuild` replaces the beginning of conversations by that of another one; `trie` takes any turns.

Defined results: null roles and texts count as empty; null turns come first; turns of equal number are ordered by role, then by
the text's SHA-256; repeated rows are turns of their own; rows without a conversation id are left out; an empty table has no nodes, not even
the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kerbsight.llm.common import lookup, table, workspace
from kerbsight.session import Workspace

FAMILY = 20
HEADS = 4
BLOCK_BITS = 16
ROOT = hashlib.sha256(b"").digest()[:16]
NO_ENDS = hashlib.sha256(b"").hexdigest()
_PATH = "array<struct<key: binary, words: int>>"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def digests(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """`(conv_id, pos, digest, words)`: positions count from 0 in each conversation."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), plain(role).alias("role"),
        F.unhex(F.sha2(plain(text), 256)).alias("text_sha"),
        F.size(F.regexp_extract_all(plain(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text_sha")
    return rows.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pos"),
        _digest(F.col("role").cast("binary"), "text_sha").alias("digest"), "words",
    )


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """`turns`, a written table, with the first h turns of every conversation c replaced by those of the conversation
    c - c % family; h is crc32(c) % heads. A conversation that has lost all its turns keeps a row without
    position."""
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % heads
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (c - c % family).alias("base"))
    # the beginnings of one conversation in `family`, each asked for by less than twice `family`
    first = turns.where((c % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("pos < h").select("conv_id", "pos", "digest", "words")
    own = turns.where(F.col("pos") >= h)
    none = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"))
    return taken.unionByName(own).unionByName(none)


def paths(turns: DataFrame) -> DataFrame:
    """`(conv_id, path)`: the keys and words of the depths 1, 2, ... of each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, path = None, ROOT, []
        for batch in batches:
            out = []
            for conv, digest, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    if now is not None:
                        out.append((now, path))
                    now, key, path = conv, ROOT, []
                if digest is not None:
                    key = hashlib.sha256(key + digest).digest()[:16]
                    path.append({"key": key, "words": words})
            yield batch_of(out)
        if now is not None:
            yield batch_of([(now, path)])

    kind = pa.list_(pa.struct({"key": pa.binary(), "words": pa.int32()}))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, found = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["conv_id", "path"])

    rows = turns.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("pos"))
    return rows.select("conv_id", "digest", "words").mapInArrow(run, f"conv_id bigint, path {_PATH}")


def _key_of(path: Column) -> Column:
    return F.coalesce(F.get(path, F.size(path) - 1)["key"], F.lit(ROOT))


def ends(ws: Workspace, convs: DataFrame) -> DataFrame:
    """`(key, ends_sha256)` of the nodes in which conversations end."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = convs.groupBy("key", block).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield batch_of(out)
        if now is not None:
            yield batch_of([(now, state.hexdigest())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, found = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])

    streamed = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return ws.save("ends", streamed.mapInArrow(run, "key binary, ends_sha256 string"))


def peel(ws: Workspace, convs: DataFrame) -> DataFrame:
    """All nodes of `convs(conv_id, path, depth, key)`, a written table: `(key, parent, depth, conv_id, n_convs, n_children,
    n_leaves, saved_tokens)`."""
    lengths = sorted((r.depth for r in convs.select("depth").distinct().collect()), reverse=True)
    ended = convs.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("path").alias("path")
    )
    ended = ws.save("sequences", ended.withColumns({"children": F.lit(0), "leaves": F.lit(0).cast("bigint"), "saved": F.lit(0).cast("bigint")}))
    columns = ["key", "conv_id", "n_convs", "path", "children", "leaves", "saved"]
    alive, found, depth = None, [], lengths[0] if lengths else -1
    while depth >= 0:
        merged = ended.where(F.col("depth") == depth).select(*columns)
        if alive is not None:
            merged = merged.unionByName(alive)
        # merged map-side before the shuffle
        groups = merged.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("path").alias("path"),
            F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"),
        )
        words = F.coalesce(F.get("path", F.lit(depth - 1))["words"], F.lit(0))
        nodes = ws.save("nodes", groups.select(
            "key", F.lit(depth).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_children",
            F.greatest("leaves", F.lit(1)).alias("n_leaves"),
            (F.col("below") + (F.col("n_convs") - 1) * words).alias("saved_tokens"), "path",
        ))
        longest = max((n for n in lengths if n < depth), default=-1)
        after = max(longest, _meet(nodes, depth, max(longest, 0))) if depth else -1
        found.append(_with_tails(nodes, depth, after))
        words_between = lambda x: F.aggregate(
            F.slice(x, after + 1, depth - 1 - after), F.lit(0).cast("bigint"), lambda s, p: s + p["words"]
        )
        if depth:
            path = F.slice("path", 1, max(after, 0))
            alive = nodes.select(
                _key_of(path).alias("key"), "conv_id", "n_convs", path.alias("path"), F.lit(1).alias("children"),
                F.col("n_leaves").alias("leaves"),
                (F.col("saved_tokens") + (F.col("n_convs") - 1) * words_between(F.col("path"))).alias("saved"),
            )
        # the root is there though no conversation is without turns
        depth = max(after, 0) if depth else -1
    if not found:
        return ws.spark.createDataFrame([], _NODE)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_NODE = "key binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _meet(nodes: DataFrame, depth: int, least: int) -> int:
    """The greatest depth above `least`, and below `depth`, at which two nodes have the same ancestor, or `least`."""
    if depth - 1 <= least:
        return least
    steps = nodes.select(F.posexplode(F.slice("path", least + 1, depth - 1 - least)).alias("at", "step"))
    shared = steps.groupBy("at", F.col("step.key")).agg(F.count("*").alias("n")).where("n > 1")
    at = shared.agg(F.max("at").alias("at")).first().at
    return least if at is None else least + at + 1


def _with_tails(nodes: DataFrame, depth: int, after: int) -> DataFrame:
    """The nodes of `depth` and their only-child ancestors down to the depth above `after`."""
    up = F.sequence(F.lit(depth), F.lit(max(after + 1, 1)), F.lit(-1)) if depth else F.array(F.lit(0))
    each = nodes.withColumns({"own": F.col("saved_tokens"), "many": F.col("n_convs") - 1}).select("*", F.explode(up).alias("d"))
    step = lambda i: F.coalesce(F.get("path", i)["key"], F.lit(ROOT))
    between = F.aggregate(
        F.slice("path", F.greatest("d", F.lit(1)), depth - F.col("d")), F.lit(0).cast("bigint"), lambda s, p: s + p["words"]
    )
    return each.select(
        F.when(F.col("d") > 0, step(F.col("d") - 1)).otherwise(F.lit(ROOT)).alias("key"),
        F.when(F.col("d") > 1, step(F.col("d") - 2)).when(F.col("d") == 1, F.lit(ROOT)).alias("parent"),
        F.col("d").cast("bigint").alias("depth"), "conv_id", "n_convs",
        F.when(F.col("d") == depth, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        "n_leaves", (F.col("own") + F.col("many") * between).alias("saved_tokens"),
    )


def trie(ws: Workspace, turns: DataFrame) -> DataFrame:
    """Nodes of `turns(conv_id, pos, digest, words)`: `(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)`."""
    convs = paths(turns).select("*", F.size("path").alias("depth"), _key_of(F.col("path")).alias("key"))
    convs = ws.save("paths", convs)
    nodes = ws.save("trie", peel(ws, convs).join(ends(ws, convs), "key", "left"))
    above = nodes.where("n_children > 0").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n")
    )
    found = lookup(nodes, above, "parent", "_n", nodes.count())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark)
    turns = digests(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return trie(ws, rebuild(ws.save("turns", turns)))


#: CRC-32 is spelled out, a table of 256 values made by its polynomial.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
u AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda x, y: xor(x >> 8, t[1 + xor(x & 255, y)]), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM u), crc_table),
r AS (
  SELECT c.conv_id, u.pos, u.role, u.text FROM c JOIN u ON u.conv_id = c.base AND u.pos <= c.h
  UNION ALL SELECT c.conv_id, u.pos, u.role, u.text FROM c JOIN u ON u.conv_id = c.conv_id AND u.pos > c.h),
k AS (
  SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(role, text)) OVER w AS key,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (
  SELECT conv_id, depth, sha256(CAST(key AS VARCHAR)) || depth AS key, words,
         lag(sha256(CAST(key AS VARCHAR)) || depth, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM k
  UNION ALL SELECT conv_id, 0, 'root', 0, NULL FROM c),
n AS (
  SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS own FROM m GROUP BY key),
last AS (SELECT conv_id, max_by(key, depth) AS key FROM m GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.key, b.key AS inner_key FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT below.key, count(*) FILTER (WHERE children.key IS NULL) AS n_leaves, sum(n.own) AS saved_tokens
  FROM below JOIN n ON n.key = below.inner_key LEFT JOIN children ON children.key = below.inner_key GROUP BY below.key)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sums USING (key) LEFT JOIN children USING (key) LEFT JOIN ends USING (key) LEFT JOIN n p ON p.key = n.parent
"""
