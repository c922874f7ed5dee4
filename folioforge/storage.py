"""Tables that an operator keeps for itself while it runs, on storage that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder for tests in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/folioforge"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its rows stay as they are, whatever executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_kept.items()):
        with contextlib.suppress(Exception):  # the session may be gone already
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class VersionConflict(RuntimeError):
    """Someone else wrote a version since the caller read the table."""


class Versions:
    """A table whose every write is a new folder ``v=<n>``, seen once it is whole.

    Spark's committer puts ``_SUCCESS`` into a folder last, so a writer that dies leaves nothing that a
    reader sees, and its folder is written over by the next. Old versions stay until ``trim``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path

    def _fs(self):
        jvm = self._spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root, root.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The whole versions, oldest first."""
        path, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def number(self) -> int:
        """The newest whole version, 0 before the first."""
        return max(self.numbers(), default=0)

    def current(self) -> DataFrame | None:
        """The rows of the newest version, None before the first."""
        n = self.number()
        return self._spark.read.parquet(f"{self.path}/v={n}") if n else None

    def write(self, rows: DataFrame, expected: int | None = None) -> int:
        """Write the next version; with ``expected`` only if that is still the newest."""
        n = self.number()
        if expected is not None and n != expected:
            raise VersionConflict(f"version {n} is there, {expected} was expected")
        rows.write.mode("overwrite").parquet(f"{self.path}/v={n + 1}")
        return n + 1

    def trim(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions."""
        path, _, fs = self._fs()
        for n in self.numbers()[:-keep]:
            fs.delete(path(f"{self.path}/v={n}"), True)
