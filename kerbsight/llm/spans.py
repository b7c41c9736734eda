"""Positions of regular-expression matches, with DataFrame expressions only.

``regexp_extract_all`` gives the matches of a text and ``split`` what lies between them, both
leftmost and non-overlapping; running sums of their lengths in characters are the positions. Sums are
taken in blocks of 256 matches, so that the work stays close to linear in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
SPAN = "array<struct<start:int,end:int,value:string>>"


def with_spans(df: DataFrame, text: str, regex: str, name: str, pieces: str | None = None) -> DataFrame:
    """`df` with `name`, the matches of `regex` in `text`: start and end in code points, and value.

    With `pieces`, also the texts between the matches, one more than matches (empty without any).
    """
    pattern = F.lit(regex)
    df = df.withColumn("_m", F.regexp_extract_all(F.col(text), pattern, F.lit(0)))
    some = F.size("_m") > 0
    df = df.withColumn(
        "_s",
        F.when(some, F.split(F.col(text), regex, -1)).otherwise(F.array().cast("array<string>")),
    )
    df = df.withColumn(
        "_n",
        F.expr(
            "zip_with(slice(_s, 1, size(_m)), _m, (a, b) -> "
            "struct(char_length(a) AS gap, char_length(b) AS len, b AS value))"
        ),
    )
    df = df.withColumn(
        "_b",
        F.expr(
            f"transform(sequence(0, int(size(_n) / {BLOCK})), k -> "
            f"aggregate(slice(_n, k * {BLOCK} + 1, {BLOCK}), 0, (s, x) -> s + x.gap + x.len))"
        ),
    )
    df = df.withColumn(
        "_p",
        F.expr("transform(_b, (x, k) -> aggregate(slice(_b, 1, k), 0, (s, y) -> s + y))"),
    )
    found = F.expr(
        f"transform(transform(_n, (x, i) -> named_struct('at', _p[int(i / {BLOCK})] + "
        f"aggregate(slice(_n, int(i / {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0, "
        "(s, y) -> s + y.gap + y.len) + x.gap, 'len', x.len, 'value', x.value)), "
        "x -> named_struct('start', x.at, 'end', x.at + x.len, 'value', x.value))"
    )
    df = df.withColumn(name, F.when(some, found).otherwise(F.array().cast(SPAN)))
    if pieces:
        df = df.withColumnRenamed("_s", pieces)
    return df.drop("_m", "_s", "_n", "_b", "_p")


def written(spans: Column) -> Column:
    """Spans with a kind as `kind:start:end`, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the sorted `spans` (start, end, mask) replaced by its mask; of
    spans that overlap the first counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        kept = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        done = F.struct(F.concat(s["out"], kept, x["mask"]).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= s["at"], done).otherwise(s)

    rest = F.lit(2**31 - 1)
    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, rest))
    )
