"""Session building and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ebbtide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Fits run side by side, each in a pool of its own.
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Forest statistics travel as object graphs, which Kryo writes far faster.
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        # Recording a Python call site costs several JVM round trips per column operator.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a single-process local session may leave it unset; it gets
    a temporary folder that goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="ebbtide-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Everything ``durable`` writes inside goes to a folder of this run, which is deleted at the end.

    Use up what the run returns before leaving: its frames read these files. Models in a store
    and finished fits are no part of it. A run within a run has a folder of its own.
    """
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read on from there.

    The files outlive the executors that wrote them, later readers take only the columns and
    row groups they need, and forests see one fixed row order. This runs a job at once. The
    files go with their ``run_scope``; without one the caller's folder keeps them.
    """
    spark = df.sparkSession
    path = f"{_run.get() or shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "user_key") -> DataFrame:
    """Full parallelism for model work.

    Adaptive execution merges partitions by their bytes, but fitting and scoring forests
    costs far more per byte than a join does. An explicit count is left alone.
    """
    session = df.sparkSession
    count = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(count, key)
