"""Cached previews and thumbnails: what to keep, drop or rebuild."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photocat.operators.joins import lookup
from photocat.operators.ordering import prior_sum, rank_rows
from photocat.schema import OK
from photocat.session import MAX_WINDOW_ROWS, setting, stage

# Buckets of ``last_used`` that a tier's bytes are summed by.
BUCKETS = 4096


def cache_gc(assets: DataFrame, keep: DataFrame) -> DataFrame:
    """Assets whose hash nobody keeps: the rows to delete."""
    return assets.join(keep.select("hash"), "hash", "left_anti")


def retain_assets(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Assets of the given photos, in both size classes."""
    return assets.join(ids.select("id"), "id", "left_semi")


def dangling_assets(photos: DataFrame, assets: DataFrame) -> DataFrame:
    """Recorded asset paths of ingested photos that the listing does not have."""
    recorded = (
        photos.where(F.col("status") == OK)
        .select("id", F.explode(F.array("preview_path", "thumb_path")).alias("path"))
        .where(F.col("path").isNotNull())
    )
    return recorded.join(assets.select("path"), "path", "left_anti").select("id", "path")


def lru_evict(slots: DataFrame, budget: int, tier: list = ()) -> DataFrame:
    """Slots to evict per tier, least recently used first, ties by id, thumb first.

    Nothing is evicted within ``budget``; beyond it, slots go until at most
    three quarters of the budget remain.  An empty ``tier`` list means one
    budget for everything.  Sizes are not negative; a null size counts as zero.

    The slots are written once.  Bytes summed by buckets of ``last_used`` tell the one
    bucket of a tier in which the cut lies; only its rows are sorted, and tiers
    within the budget are left out before.
    """
    target = budget * 3 // 4
    size, by = F.coalesce("bytes", F.lit(0)), ["_tier"]
    # One text per tier, so that null tiers meet.
    named = slots.withColumn("_tier", F.to_json(F.struct(F.lit(1).alias("_"), *tier)))
    used = stage(named, "slots")
    time = F.col("last_used").cast("double")
    ends = used.groupBy(*by).agg(F.sum(size).alias("_total"), F.min(time).alias("_low"), F.max(time).alias("_high"))
    over = ends.where(F.col("_total") > budget)
    bucket = F.coalesce(F.width_bucket(time, F.col("_low"), F.col("_high"), F.lit(BUCKETS)), F.lit(0))
    bucket = F.when(F.col("last_used").isNull(), F.lit(-1).cast("bigint")).otherwise(bucket)
    placed = lookup(used, over, by, "inner").withColumn("_bucket", bucket)
    sums = placed.groupBy(*by, "_bucket").agg(
        F.sum(size).alias("_sum"), F.count("*").alias("_rows"), (F.max("_total") - target).alias("_goal")
    )
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("_past", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .where("_past < _goal")
        .groupBy(*by)
        .agg(
            F.max("_bucket").alias("_cut"),
            F.max_by(F.struct("_past", "_rows", "_goal"), "_bucket").alias("_at"),
        )
        .select(*by, "_cut", "_at.*")
    )
    cuts = stage(cuts, "cuts")
    largest = cuts.agg(F.coalesce(F.max("_rows"), F.lit(0))).head()[0]
    found = lookup(placed.drop("_total", "_low", "_high"), cuts, by, "inner")
    whole = found.where("_bucket < _cut")
    split = found.where("_bucket = _cut")
    size_class = F.when(F.col("kind") == "thumb", 0).otherwise(1)
    order = [F.col("last_used"), F.col("id"), size_class]
    if largest <= setting(slots.sparkSession, MAX_WINDOW_ROWS):
        past = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        summed = split.withColumn("_before", F.coalesce(F.sum(size).over(past), F.lit(0)))
    else:
        ranked = rank_rows(split, by, order, pos="_rank")
        summed = prior_sum(ranked, by, "_rank", "bytes", "_before", "_in_bucket")
    last = summed.where(F.col("_past") + F.coalesce("_before", F.lit(0)) < F.col("_goal"))
    return whole.select(*slots.columns).unionAll(last.select(*slots.columns))
