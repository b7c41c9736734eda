"""Readers and writers: CSV, Parquet, line-delimited GeoJSON, model metadata."""

from __future__ import annotations

import csv
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kerbsight.schema import FEATURE, VIOLATIONS, with_optional_columns


def _first_line(spark: SparkSession, uri: str) -> str | None:
    """The first line of a file, compressed or not, through the file system Spark reads it with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header. One line of each file is read, by a few threads; the
    listing raises Spark's PATH_NOT_FOUND for a missing path."""
    uris = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(lambda uri: _first_line(spark, uri), uris))
    found: dict[tuple[str, ...], list[str]] = {}
    for uri, line in zip(uris, lines, strict=True):
        if line is not None:  # an empty file has neither header nor rows
            names = next(csv.reader([line.removeprefix("\ufeff")]))
            found.setdefault(tuple(names), []).append(uri)
    return found


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = VIOLATIONS,
    *,
    multiline: bool = True,
    malformed: str | None = None,
) -> DataFrame:
    """CSV with a header and a fixed schema: no inference pass over the data.

    Columns are matched by name, file by file: files that share a header are one scan, and the scans
    are united by name, so files may order columns differently or leave out optional ones. A
    missing path raises Spark's PATH_NOT_FOUND.

    Quoted fields may hold line feeds. Such files can't be split; say `multiline=False` for large
    files that are known to have none. `malformed` names a column for the text of rows that
    don't have the header's columns or types (null in all others).
    """
    by_name = {f.name: f for f in schema}
    scans = []
    groups = _by_header(spark, path)
    for header, uris in groups.items():
        present = [by_name.get(name, T.StructField(name, T.StringType())) for name in header]
        if malformed:
            present.append(T.StructField(malformed, T.StringType()))
        reader = (
            spark.read.schema(T.StructType(present))
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("multiLine", multiline)
            # A quote inside a quoted field may be doubled ("") or escaped; JSON arrays need the former.
            .option("escape", '"')
        )
        if malformed:
            reader = reader.option("columnNameOfCorruptRecord", malformed)
        # one header: the path itself keeps the plan small
        scans.append(reader.csv(path if len(groups) == 1 else uris))
    if not scans:
        scans = [spark.createDataFrame([], schema)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    if schema is VIOLATIONS:
        return with_optional_columns(df)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, rebalance: bool = True
) -> None:
    """Overwrite a Parquet table.

    With partition columns, `rebalance` brings the rows of a partition value together, and AQE
    splits the values that are too large for one task. Without it every task writes one
    file per value it meets.
    """
    writer = df
    if partition_by and rebalance:
        writer = df.hint("rebalance", *[F.col(c) for c in partition_by])
    out = writer.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV table; the map column of the queue has no CSV form and is dropped.

    Fields with line feeds are quoted, as `scan_csv` reads them.
    """
    df = df.drop("contributing_factors")
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        # by default the writer cuts times to milliseconds and trims text
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def sink_geojson(features: DataFrame, path: str) -> None:
    """One GeoJSON Feature per line, so that writing and reading stay distributed."""
    features.select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Read a line-delimited feature file as `feature` structs."""
    df = spark.read.schema(FEATURE).json(path)
    return df.select(F.struct("type", "geometry", "properties").alias("feature"))


def scan_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """Read whole FeatureCollection documents, one per file."""
    schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode("features").alias("feature"))


def sink_model_metadata(
    spark: SparkSession,
    path: str,
    importance: dict[str, float],
    metrics: dict[str, float],
    feature_columns: list[str],
) -> None:
    schema = "feature_importance map<string,double>, metrics struct<mae:double,r2:double>, feature_cols array<string>"
    row = (importance, (metrics["mae"], metrics["r2"]), feature_columns)
    # one row: without coalesce the other partitions would add empty files
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """True if a job has committed a table at the path."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def build_if_missing(
    spark: SparkSession, path: str, builder: Callable[[], DataFrame]
) -> DataFrame:
    """Read the table at the path; build and write it first if no job has committed one."""
    if not is_written(spark, path):
        sink_parquet(builder(), path)
    return scan_parquet(spark, path)
