"""Selections: sets of photo ids layered over a view."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positions per join key; with very many sessions on one stretch of a root a key
# still meets no more rows than these times the sessions.
RANGE_BLOCK = 1000


def select_all(view: DataFrame) -> DataFrame:
    """Every id that survives the filter."""
    return view.select("id")


def toggle_selection(selection: DataFrame, clicked: DataFrame) -> DataFrame:
    """Symmetric difference: clicked ids flip in or out."""
    both = selection.select("id").distinct().unionByName(clicked.select("id").distinct())
    return both.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")


def union_selection(selection: DataFrame, added: DataFrame) -> DataFrame:
    return selection.select("id").unionByName(added.select("id")).distinct()


def range_select(view: DataFrame, cursors: DataFrame) -> DataFrame:
    """Ids between anchor and clicked position, both included, per session.

    ``cursors(root, session, anchor, clicked)``.  Each range is split into the
    position blocks it covers, so the join is an equi-join on (root, block) and
    a large root is spread over its blocks.  A plain shuffle on both sides lets
    adaptive execution split a block on which very many sessions meet.
    """

    def block_of(pos):
        return F.call_function("div", F.col(pos), F.lit(RANGE_BLOCK))

    low, high = F.least("anchor", "clicked"), F.greatest("anchor", "clicked")
    ranges = cursors.select(
        "root", "session", "anchor", "clicked", low.alias("_low"), high.alias("_high")
    ).withColumn(
        "_block", F.explode(F.sequence(block_of("_low"), block_of("_high")))
    )
    rows = view.select("root", "id", "pos").withColumn("_block", block_of("pos"))
    return (
        rows.join(ranges, ["root", "_block"])
        .where(F.col("pos").between(F.col("_low"), F.col("_high")))
        .select("session", "anchor", "clicked", "root", "pos", "id")
    )
