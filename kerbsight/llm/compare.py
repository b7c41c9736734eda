"""Comparing pairs of nodes by what is large about them, without writing it beside the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kerbsight.llm.common import lookup
from kerbsight.session import Workspace

#: Partners of one node that a task is given.
PARTNERS = 1024


def against(
    ws: Workspace, pairs: DataFrame, own: DataFrame, judge: Callable[..., tuple], result: str
) -> DataFrame:
    """`pairs(a, b)`, a written table, compared by `own(node, own binary)`.

    The tasks get each b followed by its a, and hold a batch and the last b before it. `judge(all b, the place of each a's b
    among them, all a)` gives which pairs stay and the values of the columns `result`.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    counts = ws.save("partners", counts.withColumn("parts", F.ceil(F.col("_n") / PARTNERS)))
    spread = lookup(pairs.select("a", "b"), counts, "b", "_n", pairs.count())
    spread = spread.select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    heads = counts.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    heads = heads.select("b", "part", F.lit(None).cast("bigint").alias("a"), F.col("b").alias("node"))
    # one join, so that what is large is shuffled for it once
    asked = heads.unionByName(spread.select("b", "part", "a", F.col("a").alias("node")))
    both = asked.join(own, "node").select("b", "part", "a", "own")
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = []
        for batch in batches:
            is_head = np.asarray(batch.column("a").is_null())
            # the last one of the batch before goes on
            heads = heads[-1:] + [x.as_py() for x in batch.column("own").filter(pa.array(is_head))]
            which = (np.cumsum(is_head) + len(heads) - is_head.sum() - 1)[~is_head]
            if not len(which):
                continue
            rest = batch.filter(pa.array(~is_head))
            stays, *found = judge(heads, which, rest.column("own").to_pylist())
            stays = pa.array(stays)
            out = [rest.column("a"), rest.column("b"), *(pa.array(x) for x in found)]
            yield pa.RecordBatch.from_arrays([x.filter(stays) for x in out], ["a", "b", *names])

    names = [x.split()[0] for x in result.split(",") if x.strip()]
    return both.select("b", "a", "own").mapInArrow(run, f"a bigint, b bigint{', ' + result if result else ''}")


def linked(percent: int) -> Callable[..., tuple]:
    """A judge of sets, sorted unsigned 64-bit numbers: whether their Jaccard similarity is `percent` or more."""

    def judge(heads: list[bytes], which: np.ndarray, others: list[bytes]) -> tuple[np.ndarray]:
        out = []
        for i, x in zip(which.tolist(), others, strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(heads[i], np.uint64)
            merged = np.sort(np.concatenate([a, b]), kind="stable")  # two sorted runs
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return (np.array(out, bool),)

    return judge
