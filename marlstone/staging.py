"""Tables that cut a long plan: written where every executor can read them, read back by schema, removed when no step reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[str] = []
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch handed to a Python worker. The session's own bound is 64 MB, of which a task holds
#: several copies on either side.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to ``BATCH_BYTES``; a lower bound stays as it is."""
    if int(spark.conf.get(_BATCH_KEY).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir`` of the session.

    Where it is unset on a single machine (tests, a laptop) a temporary folder is made
    once and set, so that later calls agree; on a cluster a missing setting is an error,
    since executors would not see the driver's folder.
    """
    place = spark.conf.get(_KEY, None)
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_KEY} names no folder that all executors of {master} share")
        place = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set(_KEY, place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is reused between runs."""
    _written.append(f"{shared_dir(spark)}/marlstone/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it read back.

    The result's lineage starts at the files, so a lost executor costs only the
    tasks that read them. The schema is given on reading: empty tables work.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _written:
            _written.remove(path)


def staged_since(begun: int) -> list[str]:
    """Paths written after the first ``begun`` ones."""
    return _written[begun:]


def mark() -> int:
    """How many paths are in use."""
    return len(_written)


def release(spark: SparkSession) -> None:
    """Delete every table staged by this process. Results that still read one must be written first."""
    remove(spark, list(_written))
