"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LOCAL_DIRS: dict[str, str] = {}
# Of each session how many threads are inside ``shuffles_removed``, and its setting outside.
_REMOVING: dict[int, tuple[int, str]] = {}
_REMOVING_LOCK = threading.Lock()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("packetloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Only for a session inside one process (tests, local runs) is one made here;
    several executors do not share a machine-local folder, so there the
    setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="packetloom-")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one."""
    return f"{shared_dir(spark)}/packetloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where later stages must all see the very same values (split points,
    positions, sampled rows, tree nodes), also after an executor is lost and
    tasks are run again.  ``release`` removes what an application has written.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table that ``append`` writes in portions."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each action when it ends; by default they stay until the driver's
    garbage is collected, which adds them up over a loop of actions.  Threads of a session may be inside at the same time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _REMOVING_LOCK:
        inside, before = _REMOVING.get(id(spark)) or (0, spark.conf.get(key, "false"))
        _REMOVING[id(spark)] = (inside + 1, before)
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        with _REMOVING_LOCK:
            inside, before = _REMOVING.pop(id(spark))
            if inside > 1:
                _REMOVING[id(spark)] = (inside - 1, before)
            else:
                spark.conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote for this application; frames made from them end with it."""
    remove_path(spark, run_dir(spark))
