"""Written intermediates, distributed numbering and components for the operators."""

import uuid
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.session import scoped_setting, shared_dir

# White space and words as the contracts define them.
WORD = "[^\\x20\\x09-\\x0D]+"
# Rows that may be broadcast as a lookup table; the count is checked first.
MAX_LOOKUP_ROWS = 100_000
# Shuffle files go as soon as the query that wrote them is done, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one operator call writes below ``spark.checkpoint.dir``.

    A written table cuts lineage and survives lost executors.  ``drop`` deletes
    what later steps no longer read; the rest goes when the application ends.
    ``free_shuffles`` deletes what a table's query shuffled once the table is written.
    """

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with scoped_setting(self.spark, FREE_SHUFFLES, "true") if self.free_shuffles else nullcontext():
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(
    df: DataFrame, order: list, scratch: Scratch, name: str, index: str = "_index", weight: str | None = None
) -> DataFrame:
    """Adds the 0-based position of every row in the total order ``order``.

    ``weight`` also adds ``_before``, the sum of that column over all earlier
    rows.  The rows are range-partitioned and sorted, so no group, however
    large, meets in one task; the only global table has one row per partition,
    hence as many rows as ``spark.sql.shuffle.partitions`` at most.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    table = scratch.save(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        name,
    )
    slices = table.groupBy("_part").agg(
        F.count("*").alias("_rows"), *([F.sum(weight).alias("_sum")] if weight else [])
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_base")] if weight else []),
    )
    out = table.join(F.broadcast(slices), "_part")
    first = F.shiftleft("_part", 33)
    if weight:
        inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(
            "_before", F.col("_sum_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
        ).drop("_sum_base")
    return out.withColumn(index, F.col("_base") + F.col("_at") - first).drop("_part", "_at", "_base")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the smallest reachable node names it.

    Alternates neighbour minimum and pointer jumping over written tables, so
    the number of rounds grows with the logarithm of the longest chain.  A node
    with very many edges is combined before the shuffle by partial minima, and
    joins against it are plain shuffles that adaptive execution can split.
    """
    both = scratch.save(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{name}_edges",
    )
    label = scratch.save(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.min("a")).alias("component")
        ),
        f"{name}_0",
    )
    step = 0
    while True:
        step += 1
        near = (
            both.join(label.select(F.col("node").alias("b"), F.col("component").alias("_c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("_c").alias("_c"))
        )
        lower = label.join(near, "node").select(
            "node", F.least("component", "_c").alias("component"), F.col("component").alias("_old")
        )
        lower = scratch.save(lower, f"{name}_{step}n")
        # Jump: a node takes the label of its label.  Labels are nodes themselves.
        target = lower.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        jumped = lower.join(target, "component", "left").select(
            "node",
            F.least(F.col("component"), F.coalesce("_to", "component")).alias("component"),
            "_old",
        )
        jumped = scratch.save(jumped, f"{name}_{step}")
        moved = jumped.where(F.col("component") != F.col("_old")).limit(1).count()
        scratch.drop(f"{name}_{step - 1}", f"{name}_{step}n")
        label = jumped.drop("_old")
        if not moved:
            return label


def in_sample(hashed: Column, wanted: int, total: int) -> Column:
    """True for about twice ``wanted`` of ``total`` rows, those with the smallest hashes.

    A sort with a limit makes every partition send that many rows to the driver; on
    what this lets through it sends a few each.  All rows pass where there are few.
    """
    share = min(1.0, 2 * wanted / max(total, 1))
    return hashed.cast("double") <= (share - 0.5) * 2.0**64


def utf8(text: Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
