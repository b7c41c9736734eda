"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kerbsight.session import Workspace

#: A key is hot when it holds more than one in HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


ARROW_BYTES = 8 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, besides the places a
    cluster's own configuration names; and bound what they are handed at once by bytes, since ten
    thousand long documents, the limit by rows, may be gigabytes. A lower limit stays. Shuffle files go with the
    job that made them, since tables are written between steps, not when the driver happens to collect its garbage."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    spark.conf.set(_CLEAN_UP, "true")
    spark.conf.set(_ARROW_LIMIT, str(min(ARROW_BYTES, _bytes(spark.conf.get(_ARROW_LIMIT)))))


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30}
    number = text.lower().rstrip("b")
    if number and number[-1] in units:
        return int(number[:-1]) << units[number[-1]]
    return int(number)


def workspace(spark: SparkSession) -> Workspace:
    """Tables of one call, below ``spark.checkpoint.dir``."""
    prepare(spark)
    return Workspace(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`(_id, _text)`: only the two columns an operator needs, so that no other column of the
    input can clash with its own; a null text counts as empty."""
    return df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], n: str, total: int) -> DataFrame:
    """Left join to `right`, which has unique keys and in `n` the number of left rows of each.

    A hot key's rows stay where they are: hot keys are at most HOT_SHARE, whatever the input, so
    that part of `right` is broadcast. The other keys meet by shuffle, none of them with more than
    a HOT_SHAREth of the rows. `left` is read twice: pass a written, narrow table.
    """
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(right.where(is_hot).drop(n))
    cold = right.where(~is_hot).drop(n)
    return left.join(hot, on).unionByName(
        left.join(hot.select(on), on, "left_anti").join(cold, on, "left")
    )


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def addressed(ws: Workspace, df: DataFrame) -> DataFrame:
    """`df` with the address of every row in its Parquet files, `(_src_file, _src_row)`, so that rows can be
    named though ids may be null or repeat. A frame that is not read from files is written first.
    """
    try:
        return df.select("*", "_metadata.file_path", "_metadata.row_index").withColumnsRenamed(
            {"file_path": "_src_file", "row_index": "_src_row"}
        )
    except AnalysisException:
        return addressed(ws, ws.save("rows", df))


def without(df: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an addressed frame whose address isn't in `dropped`, as `columns`."""
    kept = df.join(dropped.select("_src_file", "_src_row"), ["_src_file", "_src_row"], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in columns])
