"""The folder that driver and executors share, and tables and checkpoints in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


#: Spark deletes the shuffle files of a write as soon as the table is there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """As the cluster names it; a temporary folder only where one process is driver and executor and the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="fathom-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep the partitions as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _write(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, columnar and compressed."""
    return _write(df, fresh_path(df.sparkSession, name))


def _delete(spark: SparkSession, names: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


class Tables:
    """Tables of one computation in the shared folder; all but the kept ones are deleted at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        _delete(self.spark, self.paths)

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, self.path(name), "zstd")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A result: written too, so that it needs none of the other tables."""
        return written(df, name)


def made() -> int:
    """How many paths have been made and not deleted."""
    return len(_made)


def discard(spark: SparkSession, begin: int, end: int | None = None) -> None:
    """Delete the paths that were made from the number ``begin`` on."""
    _delete(spark, _made[begin:end])
    del _made[begin:end]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the paths that were made within."""
    begin = made()
    try:
        yield
    finally:
        discard(spark, begin)
