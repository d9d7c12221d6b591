"""Session settings and the shared folder for written intermediate tables."""

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups up to this many rows are ranked by a plain window; larger ones by a
# range-partitioned sort.  Override with the session setting of the same name.
MAX_WINDOW_ROWS = ("photocat.maxWindowRows", 1_000_000)
# Largest table, in rows, that may be broadcast; the row count is checked first.  The driver
# holds such a table several times: as Arrow, as rows of the plan and as a hash table.
MAX_BROADCAST_ROWS = ("photocat.maxBroadcastRows", 50_000)
MAX_BROADCAST_BYTES = ("photocat.maxBroadcastBytes", 16 << 20)
# Rows per block in operators that scan an ordered group block by block.
BLOCK_ROWS = ("photocat.blockRows", 100_000)
# Target rows per range partition when a large group is ranked.
RANGE_ROWS = ("photocat.rangeRows", 2_000_000)

SPARK_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict = {}
# Frames made by ``as_small``; asking again about one of them costs nothing.
_known_small: weakref.WeakSet = weakref.WeakSet()


def setting(spark: SparkSession, key_default) -> int:
    key, default = key_default
    return int(spark.conf.get(key, str(default)))


def build_session(master: str = "local[*]", **extra) -> SparkSession:
    """A session for tests and local runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("photocat")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of single expressions cost more to record than small queries take.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, gets a
    temporary folder when the setting is missing.
    """
    context = spark.sparkContext
    found = spark.conf.get(SPARK_CHECKPOINT_DIR, None) or context.getConf().get(
        SPARK_CHECKPOINT_DIR
    )
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError(f"set {SPARK_CHECKPOINT_DIR} to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# Off, a join may keep a child's partitioning on some of its keys.  That saves a
# shuffle where those keys are fine-grained and is harmful where one of them is
# a hot root, so it is switched off for single queries only.
CO_PARTITION_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def scoped_setting(spark: SparkSession, key: str, value: str):
    """Plans and runs what is inside with one session setting changed."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table read back.

    Cuts lineage, survives executor loss, and lets every later branch prune
    columns and skip row groups instead of recomputing ``df``.  The table is deleted
    when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """An intermediate table goes with its application; plans may read it until then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def as_small(df: DataFrame) -> DataFrame | None:
    """``df`` as a local table marked for broadcast, or None when it is not small.

    One job fetches at most one row beyond the allowed count, so the check and
    the evaluation are the same work and ``df`` is not computed again.
    """
    if df in _known_small:
        return df
    spark = df.sparkSession
    limit = setting(spark, MAX_BROADCAST_ROWS)
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > setting(spark, MAX_BROADCAST_BYTES):
        return None
    small = F.broadcast(spark.createDataFrame(rows, df.schema))
    _known_small.add(small)
    return small
