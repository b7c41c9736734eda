"""A log of values per key and time bucket that micro-batches change, merged as the buckets close.

    batches/batch=<id>         what a micro-batch has changed; a repeated batch writes the same folder again
    closed/through=<id>/day=   buckets that had closed by that batch: written once, never read by later merges
    open/through=<id>          the newest values of the buckets that had not
    commits/<id>               makes the merge of all batches up to <id> count, in one step

A reader takes the closed parts of all commits, the open part of the last one, and the complete batches after it. A merge
reads the open part and the batches since, so its cost follows the open buckets, not the history; one that dies
before its commit has changed nothing that is read. What a commit has made superfluous goes with the next one, so that
readers of the one before can finish.

A bucket is closed when no later batch can change it: the stream's watermark lies `lateness` behind the newest event
time, which is not before the newest bucket's start.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVERY = 20


class BatchLog:
    """`key` and `bucket` name a value; `columns` spells out the schema of the values."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, columns: str, *,
        minutes: int, lateness: str, bucket: str = "bucket", every: int = EVERY,
    ):
        self.spark, self.path, self.key, self.bucket, self.every = spark, path, key, bucket, every
        self.values = [c.split()[0] for c in columns.split(",")]
        self.schema = f"{key} string, {bucket} timestamp_ntz, {columns}"
        self.reach = F.expr(f"INTERVAL {minutes} minutes") + F.expr(f"INTERVAL {lateness}")

    # -- files --

    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, pattern: str) -> list[str]:
        fs, path = self._fs(pattern)
        return [x.getPath().toString() for x in fs.globStatus(path) or []]

    def commits(self) -> list[int]:
        return sorted(int(x.rsplit("/", 1)[1]) for x in self._names("commits/[0-9]*"))

    def batches(self) -> list[int]:
        """Those that are complete."""
        return sorted(int(x.rsplit("/", 2)[1].removeprefix("batch=")) for x in self._names("batches/batch=*/_SUCCESS"))

    def _commit(self, through: int, total: int) -> None:
        fs, path = self._fs(f"commits/{through}")
        _, draft = self._fs(f"commits/_{through}")
        out = fs.create(draft, True)
        out.write(json.dumps({"closed_total": total}).encode())
        out.close()
        if not fs.rename(draft, path):
            raise OSError(f"{path} is there already")

    def _closed_total(self, commit: int) -> int:
        fs, path = self._fs(f"commits/{commit}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["closed_total"]

    # -- writing --

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What batch `batch_id` has changed. All batches before it are final by then, and merged now and then."""
        last = max([-1, *self.commits()])
        if batch_id - 1 - last >= self.every:
            self.merge(batch_id - 1)
        rows.select(self.key, self.bucket, *self.values).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def merge(self, through: int) -> None:
        before = self.commits()
        last = max([-1, *before])
        if through <= last:
            return
        newest = self._newest(self._pending(last, through))
        horizon = newest.agg((F.max(self.bucket) - self.reach).alias("h")).scalar()
        is_open = F.col(self.bucket) > horizon
        closed = newest.where(~is_open).drop("batch").withColumn("day", F.to_date(self.bucket))
        closed.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/closed/through={through}")
        newest.where(is_open).write.mode("overwrite").parquet(f"{self.path}/open/through={through}")
        total = 0
        if "n" in self.values:
            total = self._segments([through]).agg(F.sum("n").alias("n")).first().n or 0
            total += self._closed_total(last) if last >= 0 else 0
        self._commit(through, total)
        self._clean(last)

    def _clean(self, through: int) -> None:
        """Delete what the commit `through` has replaced; it is itself no longer the last one."""
        old = [f"batches/batch={b}" for b in self.batches() if b <= through]
        opened = [int(x.rsplit("=", 1)[1]) for x in self._names("open/through=*")]
        for place in [*old, *(f"open/through={x}" for x in opened if x < through)]:
            fs, path = self._fs(place)
            fs.delete(path, True)

    # -- reading --

    def _segments(self, commits: list[int], since: dt.date | None = None) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, through bigint, day date").option("basePath", f"{self.path}/closed")
        found = reader.parquet(*(f"{self.path}/closed/through={c}" for c in commits))
        if since is not None:
            found = found.where(F.col("day") >= F.lit(since))
        return found.select(self.key, self.bucket, *self.values)

    def _pending(self, last: int, through: int | None) -> DataFrame:
        """Open values of the commit `last`, and the batches after it, with the batch each is from."""
        ids = [b for b in self.batches() if b > last and (through is None or b <= through)]
        empty = self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        parts = [empty]
        if ids:
            reader = self.spark.read.schema(f"{self.schema}, batch bigint").option("basePath", f"{self.path}/batches")
            parts.append(reader.parquet(*(f"{self.path}/batches/batch={b}" for b in ids)))
        if last >= 0:
            parts.append(self.spark.read.schema(empty.schema).parquet(f"{self.path}/open/through={last}"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _newest(self, pending: DataFrame) -> DataFrame:
        newest = F.max(F.struct("batch", *self.values)).alias("newest")
        return pending.groupBy(self.key, self.bucket).agg(newest).select(self.key, self.bucket, "newest.*")

    def read(self, since: dt.datetime | None = None, through: int | None = None) -> DataFrame:
        """The newest values: of buckets from `since` on, as of batch `through`, where these are given. With
        `since`, closed parts are read by the folders of its days."""
        commits = [c for c in self.commits() if through is None or c <= through]
        last = max([-1, *commits])
        found = self._newest(self._pending(last, through)).drop("batch")
        if commits:
            found = found.unionByName(self._segments(commits, since and since.date()))
        return found if since is None else found.where(F.col(self.bucket) >= F.lit(since).cast("timestamp_ntz"))

    def total(self, through: int | None = None) -> int:
        """Sum of the values `n`, from the running total of what is closed and the rest."""
        last = max([-1, *(c for c in self.commits() if through is None or c <= through)])
        rest = self._newest(self._pending(last, through)).agg(F.sum("n").alias("n")).first().n or 0
        return rest + (self._closed_total(last) if last >= 0 else 0)
