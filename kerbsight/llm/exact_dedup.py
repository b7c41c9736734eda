"""Exact deduplication against an immutable snapshot (operator 8).

Texts are equal when they are identical after every run of white space became one space.

1. Every row is reduced to a digest, a content hash and its address in the input's files.
2. The snapshot's distinct digests are sealed in static binary-fuse filters (Graf and Lemire 2022),
   one for each shard of at most about `SHARD_KEYS` digests: about nine bits per digest.
3. The distinct digests of the incoming batch meet their shard's filter. What it rejects is new for
   certain. What it accepts (true positives and one in 256 others) is looked up in the snapshot.
4. Digests that occur more than once (in the snapshot, in the batch, or in both) are suspects. The
   texts of suspects are grouped by their bytes, map-side first, so that a text with very many
   copies leaves each task once.
5. Each row gets the class of its text. Classes with more than a thousandth of all rows, at
   most a thousand, are broadcast; the others meet their rows by shuffle.

Only digests are shuffled in steps 2, 3 and 5. Every distinct-digest shuffle has unique keys.

Defined results: a null text is an empty one; null ids count as larger than any other; of rows with
the same text and id the first in the files stays; an empty table gives no rows. Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import addressed, lookup, table, without, workspace
from kerbsight.session import Workspace

SHARD_KEYS = 50_000
SPACES = r"[\x20\x09-\x0D]+"


# -- binary-fuse filter -------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer (the finaliser of MurmurHash3)."""
    h = keys.astype(np.uint64) + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """Three-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int  # places where a key's window of three segments can start
    slots: np.ndarray

    @staticmethod
    def places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        span, low, mask = np.uint64(segment * segments), np.uint64(0xFFFFFFFF), np.uint64(segment - 1)
        half = np.uint64(32)
        first = ((h >> half) * span + (((h & low) * span) >> half)) >> half
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel slots that hold one key, a whole layer at a time; a layer's keys don't share their
        single slots, so that slots can be filled layer by layer, last one first. Where some keys
        can't be peeled the next seed is tried."""
        n = len(keys)
        segment = min(1 << int(math.log(max(n, 1)) / math.log(3.33) + 2.25), 1 << 18)
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(room / segment) - 2)
        size = (segments + 2) * segment
        seed = 0
        while True:
            seed += 1
            h = mixed(keys, seed)
            at, order = cls.places(h, segment, segments), np.arange(n)
            count = np.bincount(at.ravel(), minlength=size)
            inside = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(inside, row, order)
            layers, peeled, single = [], 0, np.flatnonzero(count == 1)
            while len(single):
                found, first = np.unique(inside[single], return_index=True)
                layers.append((found, single[first]))
                peeled += len(found)
                for row in at:
                    np.subtract.at(count, row[found], 1)
                    np.bitwise_xor.at(inside, row[found], found)
                touched = np.unique(at[:, found])
                single = touched[count[touched] == 1]
            if peeled == n:
                break
        slots, prints = np.zeros(size, np.uint8), cls.prints(h)
        for found, place in reversed(layers):
            # the key's own slot is still zero
            slots[place] = prints[found] ^ np.bitwise_xor.reduce(slots[at[:, found]], axis=0)
        return cls(seed, segment, segments, slots)

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys, self.seed)
        found = np.bitwise_xor.reduce(self.slots[self.places(h, self.segment, self.segments)], axis=0)
        return found == self.prints(h)


_FILTERS = "shard bigint, seed bigint, segment int, segments int, slots binary"


def shard_count(n: int) -> int:
    return max(1, -(-n // SHARD_KEYS))


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """`digests(digest bigint)`, distinct → one sealed filter per shard. A group is one shard."""

    def seal(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(keys["digest"].to_numpy().view(np.uint64))
        row = [key[0], f.seed, f.segment, f.segments, f.slots.tobytes()]
        return pd.DataFrame([row], columns=["shard", "seed", "segment", "segments", "slots"])

    keyed = digests.select("digest", F.pmod("digest", F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").applyInPandas(seal, _FILTERS)


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Digests that the filters accept: all that were sealed, and one in 256 of the others."""

    def ask(keys: pd.DataFrame, sealed: pd.DataFrame) -> pd.DataFrame:
        if keys.empty or sealed.empty:
            return keys[["digest"]].iloc[:0]
        row = sealed.iloc[0]
        f = FuseFilter(
            int(row.seed), int(row.segment), int(row.segments), np.frombuffer(row.slots, np.uint8)
        )
        return keys.loc[f.might_hold(keys["digest"].to_numpy().view(np.uint64)), ["digest"]]

    keyed = digests.select("digest", F.pmod("digest", F.lit(shards)).alias("shard"))
    return (
        keyed.groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInPandas(ask, "digest bigint")
    )


# -- operator -----------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def halves(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """True for the rows up to the middle id: the earlier half as snapshot of a one-off run."""
    found = docs.agg(F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    if found.low is None:
        return F.lit(True)
    return F.col(id_col) <= F.lit(found.low + (found.high - found.low) // 2)


def exact_dedup(
    ws: Workspace,
    docs: DataFrame,
    in_snapshot: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`, an `addressed` frame: `(_src_file, _src_row, _id, keep_id, group_size,
    kept, text_sha256, found_in)`.

    `in_snapshot` tells the rows of the snapshot from those of the incoming batch. `found_in` says
    where the digest's first equal was found: ``snapshot``, ``batch`` or ``none``.
    """
    text = normalised(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        "_src_file",
        "_src_row",
        F.coalesce(in_snapshot, F.lit(False)).alias("_old"),
        text.alias("_text"),
    ).withColumn("digest", F.xxhash64("_text"))
    slim = ws.save(
        "digests",
        rows.select("_id", "_src_file", "_src_row", "_old", "digest", F.sha2("_text", 256).alias("sha")),
    )
    total = slim.count()

    def distinct(name: str, side: Column) -> DataFrame:
        return ws.save(name, slim.where(side).groupBy("digest").agg(F.count("*").alias("n")))

    old, new = distinct("snapshot", F.col("_old")), distinct("batch", ~F.col("_old"))
    shards = shard_count(max(old.count(), new.count()))
    filters = ws.save("filters", build_filters(old, shards))
    accepted = screen(new, filters, shards)
    known = accepted.join(old.select("digest"), "digest")  # drops the filters' false positives
    suspects = ws.save(
        "suspects",
        known.withColumn("place", F.lit("snapshot"))
        .unionByName(old.where("n > 1").select("digest", F.lit("snapshot").alias("place")))
        .unionByName(new.where("n > 1").select("digest", F.lit("batch").alias("place")))
        .groupBy("digest")
        .agg(F.max("place").alias("found_in")),
    )
    # Byte check: the whole text is the key, so only identical texts share a group.
    alike = (
        rows.select("digest", "_text")
        .join(suspects.select("digest"), "digest", "left_semi")
        .groupBy("digest", "_text")
        .agg(F.count("*").alias("group_size"))
        .select("digest", F.sha2("_text", 256).alias("sha"), "group_size")
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_src_file", "_src_row"))
    firsts = slim.groupBy("sha").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    classes = ws.save(
        "classes",
        alike.where("group_size > 1")
        .join(suspects, "digest")
        .join(firsts, "sha")
        .select("sha", "first", "n", "group_size", "found_in"),
    )
    found = lookup(slim.drop("_old", "digest"), classes, "sha", "n", total)
    alone = F.col("group_size").isNull()
    stays = (F.col("first._src_file") == F.col("_src_file")) & (F.col("first._src_row") == F.col("_src_row"))
    return found.select(
        "_src_file",
        "_src_row",
        "_id",
        F.when(alone, F.col("_id")).otherwise(F.col("first._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | stays).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.coalesce("found_in", F.lit("none")).alias("found_in"),
    )


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those whose text a kept row has, all columns."""
    ws = workspace(spark)
    rows = addressed(ws, docs)
    found = exact_dedup(ws, rows, halves(docs))
    return without(rows, found.where("NOT kept"), docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = workspace(spark), table(spark, sf_dir, "documents")
    found = exact_dedup(ws, addressed(ws, docs), halves(docs))
    return found.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
