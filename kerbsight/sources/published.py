"""Versions of a set of tables, of which one counts at a time.

    versions/<name>/<table>    the tables of one run; nothing else is ever written there
    manifests/<number>         names a version and its tables; the highest number counts

A run writes all its tables to a folder of its own and then its manifest, which appears complete by a rename to a name that wasn't there
before. Until then, and if the run dies, readers get the version before, whole; after it, the new one, whole. Two
runs that end together can't both take a number: the second one raises. Readers that hold an older version go on reading
it until `prune` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from kerbsight.sources.files import is_written, remove

KEEP = 2


class Published:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        fs, path = self._fs("manifests/[0-9]*")
        return sorted(int(x.getPath().getName()) for x in fs.globStatus(path) or [])

    def manifest(self, number: int) -> dict:
        fs, path = self._fs(f"manifests/{number}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> str | None:
        """The folder of the version that counts."""
        numbers = self.numbers()
        return f"{self.out}/versions/{self.manifest(numbers[-1])['version']}" if numbers else None

    def new(self) -> str:
        """A folder for the tables of one run."""
        return f"{self.out}/versions/{uuid.uuid4().hex}"

    def commit(self, folder: str, tables: list[str]) -> int:
        """Let the tables in `folder` count from now on, all of them or none."""
        missing = [t for t in tables if not is_written(self.spark, f"{folder}/{t}")]
        if missing:
            raise ValueError(f"not written: {', '.join(missing)}")
        number = max([0, *self.numbers()]) + 1
        version = folder.rsplit("/", 1)[1]
        fs, path = self._fs(f"manifests/{number}")
        _, draft = self._fs(f"manifests/_{version}")
        out = fs.create(draft, True)
        out.write(json.dumps({"version": version, "tables": sorted(tables)}).encode())
        out.close()
        if not fs.rename(draft, path):
            fs.delete(draft, False)
            raise OSError(f"another run has published {path}")
        return number

    def prune(self, keep: int = KEEP) -> None:
        """Delete all but the last `keep` published versions, the oldest manifest first. Versions without
        a manifest may belong to runs that go on, and stay."""
        for number in self.numbers()[:-keep]:
            version = self.manifest(number)["version"]
            remove(self.spark, f"{self.out}/manifests/{number}")
            remove(self.spark, f"{self.out}/versions/{version}")
