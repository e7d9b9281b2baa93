"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a task and its Python worker exchange at once, where rows hold whole texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder for unset local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="ebbtide-llm-"))
    return _local_folder[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside exchange Arrow batches of about ``BATCH_BYTES`` instead of 10,000 rows of any length.

    The session's own limit holds again afterwards; a smaller one stays.
    """
    before = spark.conf.get(_BATCH)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < limit <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def saved_in_batches(df: DataFrame, name: str) -> DataFrame:
    """``saved``, with ``text_batches``."""
    with text_batches(df.sparkSession):
        return saved(df, name)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``saved`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)
        return
