"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship

#: Words are maximal runs of anything but ASCII space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Rows of a batch between the JVM and Python; texts are long, so Spark's default of 10,000 takes much memory.
ARROW_ROWS = 2048
_SPARKS_ROWS = "10000"

_written: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the package in its workers, and batches of bounded size.

    The size of batches is set only where the session has Spark's own default; a size that a caller chose stays.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == _SPARKS_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else, in local mode only, one for tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/folioforge"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone already
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for path in list(_written):
        _delete(path)


atexit.register(_clean)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no recomputation.

    The files go when this Python process ends.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class dropping(contextlib.AbstractContextManager):  # noqa: N801 - read like a function
    """Deletes, at its end, the tables that ``cut`` wrote inside, but for those of frames given to ``keep``.

    For a caller that has written what it made of them; frames of other callers are left alone.
    """

    def __enter__(self) -> dropping:
        self._before = set(_written)
        self._kept = ""
        return self

    def keep(self, df: DataFrame) -> None:
        self._kept += "\n".join(df.inputFiles())

    def __exit__(self, *_) -> None:
        for path in [p for p in _written if p not in self._before and p.rsplit("/", 1)[-1] not in self._kept]:
            _delete(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names do not differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def discard(df: DataFrame) -> None:
    """Delete the tables written by ``cut`` that ``df`` reads; for tables whose every use is written already."""
    read = "\n".join(df.inputFiles())
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in read]:
        _delete(path)


def column(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: str) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(column(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for a text without words."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def held_out(id_column: str) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(column(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))
