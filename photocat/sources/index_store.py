"""The index as an ordinary Parquet table, partitioned by root.

``photos/root=R`` holds the rows of root R.  A sync or an edit replaces the partitions of the roots
that it changes, by Spark's dynamic partition overwrite, and leaves the others alone; anything
that reads Parquet reads the table.  ``published`` beside it gets one row per publication:
which batch of which stream it was, and the highest id so far.

One writer at a time.  Frames over partitions that were replaced since must be read anew.
"""

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from photocat.operators.joins import lookup
from photocat.operators.sync import upgrade_index
from photocat.schema import PHOTOS_SCHEMA, SCHEMA_VERSION
from photocat.session import stage

_PUBLISHED = "number int, schema_version int, stream string, batch_id bigint, highest_id bigint"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty when nothing was ever written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def publications(spark: SparkSession, store: str) -> DataFrame:
    """One row per publication: number, schema_version, stream, batch_id, highest_id."""
    return _read(spark, f"{store}/published", _PUBLISHED)


def _known(spark: SparkSession, store: str, stream: str, batch_id: int | None):
    """(last number, highest id, newest schema version, number of this batch)."""
    mine = (F.col("batch_id") == batch_id) & (F.col("stream") == stream)
    return publications(spark, store).agg(
        F.coalesce(F.max("number"), F.lit(0)).alias("last"),
        F.coalesce(F.max("highest_id"), F.lit(0)).alias("highest_id"),
        F.max("schema_version").alias("schema_version"),
        F.max(F.when(mine, F.col("number"))).alias("done"),
    ).head()


def highest_id(spark: SparkSession, store: str) -> int:
    """The highest id that was ever published, without reading the index."""
    return _known(spark, store, "", None).highest_id


def write_index(
    photos: DataFrame,
    store: str,
    batch_id: int | None = None,
    changed_roots: DataFrame | None = None,
    stream: str = "",
) -> int:
    """Publishes rows and returns the number of the publication.

    With ``changed_roots(root)`` only those roots are replaced, by their rows in ``photos``; a root
    without rows there keeps what it has.  Otherwise ``photos`` becomes the whole index.  With
    ``batch_id`` a repeated batch of the same ``stream`` writes nothing and returns the number it
    has.  If a writer is lost between the rows and their entry in ``published``, the batch runs again and
    replaces the same partitions.  Rows without a root are refused.
    """
    spark = photos.sparkSession
    known = _known(spark, store, stream, batch_id)
    if known.done is not None:
        return known.done
    rows = photos.select(*PHOTOS_SCHEMA.names)
    if changed_roots is None:
        # The table may be what ``photos`` is read from, and is emptied first.
        rows = stage(rows, "index") if known.last else rows
    else:
        rows = lookup(rows, changed_roots.select("root").distinct(), ["root"], "left_semi")
    nowhere = F.coalesce(F.col("root"), F.lit("")) == ""
    rooted = F.when(nowhere, F.raise_error(F.lit("a photo without a root"))).otherwise(F.col("root"))
    seen = Observation()
    # The rebalance hint lets Spark split a huge root over many writers and
    # merge small roots into few, by the sizes it sees at run time.
    (
        rows.withColumn("root", rooted)
        .observe(seen, F.max("id").alias("top"))
        .hint("rebalance", "root")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if changed_roots is None else "dynamic")
        .partitionBy("root")
        .parquet(f"{store}/photos")
    )
    entry = (known.last + 1, SCHEMA_VERSION, stream, batch_id, max(known.highest_id, _observed(seen)))
    spark.createDataFrame([entry], _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{store}/published")
    return entry[0]


def _observed(seen: Observation) -> int:
    try:
        return seen.get["top"] or 0
    except Py4JJavaError:  # Spark found the plan to be empty and dropped the observed step
        return 0


def read_index(spark: SparkSession, store: str) -> DataFrame:
    """The index as it is now; empty before the first publication."""
    known = _known(spark, store, "", None)
    rows = _read(spark, f"{store}/photos", PHOTOS_SCHEMA)
    # Partitions of an older schema lack columns, which read as null and get their defaults.
    return upgrade_index(rows, known.schema_version or SCHEMA_VERSION)
