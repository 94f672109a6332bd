"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import itertools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Rows one window group may hold before ranking switches to the sliced form.
MAX_GROUP_ROWS_KEY = "spark.factorloom.maxGroupRows"
MAX_GROUP_ROWS = 4_000_000
RELEASE_AFTER = 8  # written tables
_WRITTEN = itertools.count(1)
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "factorloom", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Where none is named, a session that runs in one process gets a folder of its own, gone when the process ends; a
    cluster must name one, as its machines do not see each other's temporary folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="factorloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run in here deletes its shuffle files as soon as it is done, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The table survives the loss of executors and cuts the lineage; unlike a checkpoint's rows it is columnar,
    so later reads are pruned, and its size is known to the planner. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, "table")
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path  # noqa: SLF001  for discard
    if next(_WRITTEN) % RELEASE_AFTER == 0:
        release(df.sparkSession)
    return written


def discard(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing will read ``table`` again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def release(spark: SparkSession) -> None:
    """Have the driver drop what finished jobs have left (task binaries, broadcasts, states of shuffles): Spark cleans these up
    only after its JVM has collected the last reference, and a heap that has grown meanwhile stays large."""
    gc.collect()  # Python's references keep the JVM's alive
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_KEY, str(MAX_GROUP_ROWS)))
