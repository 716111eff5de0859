"""Cutting lineage through tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_chosen: dict[str, str] = {}  # the folder of an application whose session names none


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none and runs in this process (local mode, as in tests) a
    folder of this machine is chosen and noted in the session; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codelode-")
        spark.sparkContext._jsc.sc().setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
        _chosen[spark.sparkContext.applicationId] = folder
        _written.append((spark, folder))
    return folder


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/codelode-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may already be gone
        pass


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, the tables cut within it; use it around building and writing a result.

    A result is read lazily from its tables, so it has to be written or collected within the scope.
    Without one the tables stay until the driver exits.
    """
    begin = len(_written)
    try:
        yield
    finally:
        while len(_written) > begin:
            spark, path = _written.pop()
            if path.rsplit("/", 1)[-1].startswith("codelode-") and path != _chosen.get(spark.sparkContext.applicationId):
                _delete(spark, path)
            else:
                _written.insert(begin, (spark, path))
                begin += 1


def sweep() -> None:
    """Deletes the tables written by this driver."""
    while _written:
        _delete(*_written.pop())


atexit.register(sweep)
