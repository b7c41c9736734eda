"""Global row numbers, exact grouped percentiles and skew-safe look-ups.

None of them gathers a group, or the whole table, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kerbsight.session import Workspace

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def global_row_number(
    ws: Workspace, df: DataFrame, order: Sequence[Column], name: str, start: int = 1
) -> DataFrame:
    """Position of every row in the global order.

    Range-sort, note (partition, row in partition), write. The written table fixes both numbers
    before they are read again, so a lost executor cannot change them. The only window runs
    over one row per sort partition. `order` must be unique for the numbers to be repeatable.
    """
    marked = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    written = ws.save("sorted", marked)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        # at most one row per sort partition: size bound by spark.sql.shuffle.partitions
        written.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row + F.lit(start))
        .drop("_part", "_offset", "_at")
    )


def grouped_percentile(
    ws: Workspace, df: DataFrame, group: str, value: str, unique: Sequence[str], p: float, name: str
) -> DataFrame:
    """Exact percentile with linear interpolation, one row per group; null values are skipped.

    Sorting by (group, value) makes a group a run of consecutive positions, so its percentile
    is found at one or two of them. The join is on the position, which is unique: a group with
    a third of all rows costs no more than any other.
    """
    ranked = global_row_number(
        ws,
        df.where(F.col(value).isNotNull()).select(group, value, *unique),
        [F.col(group), F.col(value), *[F.col(c) for c in unique]],
        "_pos",
        start=0,
    )
    runs = ranked.groupBy(group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    target = F.lit(float(p)) * (F.col("_n") - 1)
    wanted = runs.select(
        group,
        (target - F.floor(target)).alias("_fraction"),
        F.inline(
            F.array(
                F.struct((F.col("_first") + F.floor(target)).alias("_pos"), F.lit(0).alias("_upper")),
                F.struct((F.col("_first") + F.ceil(target)).alias("_pos"), F.lit(1).alias("_upper")),
            )
        ),
    )
    low = F.max(F.when(F.col("_upper") == 0, F.col(value)))
    high = F.max(F.when(F.col("_upper") == 1, F.col(value)))
    return (
        wanted.join(ranked.select("_pos", value), "_pos")
        .groupBy(group)
        .agg((low + (high - low) * F.max("_fraction")).alias(name))
    )


def salt_count(spark: SparkSession) -> int:
    """The square root of the number of shuffle partitions: a key that a third of all rows share
    gets that many tasks, and the side that is copied grows no more than that."""
    return math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1


def salted_lookup(
    left: DataFrame, right: DataFrame, on: str, spread: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Left join to a table with unique keys when many left rows may share one key.

    Left rows of a key go to `salts` tasks, chosen by the `spread` columns; every right row is
    copied once per salt (see `salt_count` for the default). No hint: the measured size decides between broadcast and shuffle.
    """
    salts = salts or salt_count(left.sparkSession)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(copies, [on, "_salt"], "left").drop("_salt")
