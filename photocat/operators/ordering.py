"""Order-dependent building blocks that never put one whole group in a task.

A root, job or asset tier may hold a third of all rows, so a window over the
whole group is used only after its size was checked.  Everything else works on
two levels: fixed-size blocks of consecutive positions, and one small row per
block that carries what the blocks before or after contribute.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.session import (
    BLOCK_ROWS,
    MAX_BROADCAST_ROWS,
    MAX_WINDOW_ROWS,
    RANGE_ROWS,
    setting,
    stage,
)


# Most range partitions of one sort, unless ``spark.sql.shuffle.partitions`` asks for more.
MAX_RANGES = 1_000


def group_sizes(df: DataFrame, group: list) -> tuple:
    """(groups, rows in the largest group, rows in all)."""
    counts = df.groupBy(*group).agg(F.count("*").alias("n"))
    row = counts.agg(
        F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).head()
    return tuple(row)


def rank_rows(
    df: DataFrame,
    group: list,
    order: list,
    pos: str = "pos",
    total: str | None = None,
    bound: DataFrame | None = None,
    sizes: tuple | None = None,
) -> DataFrame:
    """Adds the 0-based position of every row in its group.

    ``order`` must be a total order within a group.  ``total`` also adds the
    group's row count.  The size check counts ``df``, or ``bound``, a cheaper
    DataFrame with at least as many rows per group; ``sizes`` passes the result
    of ``group_sizes`` when it is known already.

    Small groups use ``row_number``.  When the largest group exceeds
    ``photocat.maxWindowRows`` the rows are range-partitioned on (group, order)
    instead, so a group of any size is spread over many sorted partitions, and
    a table with one row per (group, partition) supplies the offsets.
    """
    spark = df.sparkSession
    groups, largest, rows = sizes or group_sizes(df if bound is None else bound, group)
    if largest <= setting(spark, MAX_WINDOW_ROWS):
        whole = W.partitionBy(*group)
        out = df.withColumn(
            pos, (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint")
        )
        return out.withColumn(total, F.count("*").over(whole)) if total else out
    return _rank_by_range(df, group, order, pos, total, groups, rows)


def number_rows(df: DataFrame, order: list, rows: int, pos: str = "pos") -> DataFrame:
    """Adds the 0-based position of every row in the whole table, without a one-task sort."""
    return _rank_by_range(df, [], order, pos, None, 1, rows)


def _rank_by_range(df, group, order, pos, total, groups, rows) -> DataFrame:
    spark = df.sparkSession
    # Spark samples up to 300 keys per range to the driver, so their number is bounded; a
    # range that outgrows memory spills while it is sorted.
    parts = max(
        min(rows // setting(spark, RANGE_ROWS) + 1, MAX_RANGES),
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    keys = [F.col(c).asc() for c in group] + list(order)
    # The running id is (partition << 33) + row number inside the partition, and
    # the rows of a partition are sorted.  Writing the table fixes both, so the
    # two reads below always agree, also after lost executors.
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    table = stage(ranged, "ranked")
    slices = table.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    whole = W.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        slices = slices.withColumn(total, F.sum("_n").over(whole))
    slices = slices.drop("_n")
    # At most one slice per partition plus one per group.
    how = "broadcast" if parts + groups <= setting(spark, MAX_BROADCAST_ROWS) else "merge"
    return (
        join_null_safe(table, slices.hint(how), [*group, "_part"])
        .withColumn(pos, F.col("_base") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_base")
    )


def block_of(spark, pos="pos") -> Column:
    return F.call_function("div", F.col(pos), F.lit(setting(spark, BLOCK_ROWS)))


def shifted(
    df: DataFrame, group: list, pos: str, shifts: dict, reach: int
) -> DataFrame:
    """Adds ``name: lag(column, offset)`` for each ``name: (column, offset)``.

    Negative offsets look ahead.  Positions must be consecutive in each group
    and ``|offset| <= reach``.  Rows within ``reach`` of a block's edge are
    copied to the neighbouring block, so each block answers for itself.
    """
    size = setting(df.sparkSession, BLOCK_ROWS)
    if not 0 < reach < size:
        raise ValueError(f"reach must be between 1 and {size - 1}")
    block, inner = block_of(df.sparkSession, pos), F.pmod(F.col(pos), F.lit(size))
    homes = F.array_compact(
        F.array(
            block,
            F.when((inner < reach) & (block > 0), block - 1),
            F.when(inner >= size - reach, block + 1),
        )
    )
    copied = df.withColumn("_block", F.explode(homes))
    w = W.partitionBy(*group, "_block").orderBy(pos)
    for name, (column, offset) in shifts.items():
        copied = copied.withColumn(name, F.lag(column, offset).over(w))
    return copied.where(F.col("_block") == block).drop("_block")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """Inner join in which a null key meets a null key; keys are kept once."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    condition = F.lit(True)
    for key, name in names.items():
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(names), condition).drop(*names.values())


def _with_block_table(df, group, sizes, aggs, carries) -> DataFrame:
    """Joins one row per (group, block), extended by ``carries``, to every row."""
    spark = df.sparkSession
    table = df.groupBy(*group, "_block").agg(*aggs)
    for name, column in carries.items():
        table = table.withColumn(name, column)
    # At most one block per full range of positions plus one per group.
    blocks = sizes[2] // setting(spark, BLOCK_ROWS) + sizes[0]
    how = "broadcast" if blocks <= setting(spark, MAX_BROADCAST_ROWS) else "merge"
    return join_null_safe(df, table.hint(how), [*group, "_block"])


def _fits_window(df: DataFrame, sizes: tuple) -> bool:
    """The largest group may be handled by one window."""
    return sizes[1] <= setting(df.sparkSession, MAX_WINDOW_ROWS)


def _placed(df: DataFrame, group: list, order: str, sizes: tuple) -> DataFrame:
    """``df`` with ``_place``, the position of each row in its group by ``order``.

    Blocks are ranges of positions, so sparse order values make no more of them.
    Written, since the block table and the rows both read it.
    """
    ranked = rank_rows(df, group, [F.col(order)], pos="_place", sizes=sizes)
    return stage(ranked, "placed").withColumn("_block", block_of(df.sparkSession, "_place"))


def following(df: DataFrame, group: list, order: str, value: Column, out: str, first: str) -> DataFrame:
    """Adds the next non-null ``value`` after each row and the group's first one.

    ``order`` is unique in a group.
    """
    df = df.withColumn("_value", value)
    whole = W.partitionBy(*group).orderBy(F.col(order).desc())
    sizes = group_sizes(df, group)
    if _fits_window(df, sizes):
        past = whole.rowsBetween(W.unboundedPreceding, -1)
        every = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.withColumns(
            {
                out: F.last("_value", ignorenulls=True).over(past),
                first: F.last("_value", ignorenulls=True).over(every),
            }
        ).drop("_value")
    inside = (
        W.partitionBy(*group, "_block")
        .orderBy(F.col("_place").desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    blocks = W.partitionBy(*group).orderBy(F.col("_block").desc())
    later = blocks.rowsBetween(W.unboundedPreceding, -1)
    every = blocks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = _with_block_table(
        _placed(df, group, order, sizes),
        group,
        sizes,
        [F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_head")],
        {
            "_later": F.last("_head", ignorenulls=True).over(later),
            first: F.last("_head", ignorenulls=True).over(every),
        },
    )
    return rows.withColumn(
        out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_later"))
    ).drop("_place", "_block", "_value", "_head", "_later")


def prior_sum(df: DataFrame, group: list, order: str, value, out: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the group, and over all."""
    zero = F.lit(0)
    sizes = group_sizes(df, group)
    if _fits_window(df, sizes):
        past = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns(
            {
                out: F.coalesce(F.sum(value).over(past), zero),
                total: F.sum(value).over(W.partitionBy(*group)),
            }
        )
    inside = W.partitionBy(*group, "_block").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    rows = _with_block_table(
        _placed(df, group, order, sizes),
        group,
        sizes,
        [F.sum(value).alias("_sum")],
        {
            "_before": F.coalesce(F.sum("_sum").over(earlier), zero),
            total: F.sum("_sum").over(W.partitionBy(*group)),
        },
    )
    return rows.withColumn(
        out, F.col("_before") + F.coalesce(F.sum(value).over(inside), zero)
    ).drop("_place", "_block", "_sum", "_before")


def running_max(df: DataFrame, group: list, order: str, value: str, out: str) -> DataFrame:
    """Adds the largest ``value`` up to and including each row; ``order`` is unique in a group."""
    sizes = group_sizes(df, group)
    if _fits_window(df, sizes):
        upto = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.max(value).over(upto))
    inside = W.partitionBy(*group, "_block").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    rows = _with_block_table(
        _placed(df, group, order, sizes),
        group,
        sizes,
        [F.max(value).alias("_top")],
        {"_before": F.max("_top").over(earlier)},
    )
    return rows.withColumn(
        out, F.greatest(F.max(value).over(inside), F.col("_before"))
    ).drop("_place", "_block", "_top", "_before")
