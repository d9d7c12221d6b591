"""Label and rotation edits, as batch updates and as folded event logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions.display import turned
from photocat.operators.joins import lookup, merged


def set_labels(photos: DataFrame, ids: DataFrame, label: int) -> DataFrame:
    """One label on many photos; unknown ids are skipped.

    Adds ``changed``, true where the label really differs.  ``ids`` may be as
    long as the library; only what proves small is broadcast.
    """
    wanted = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    changed = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("label") != label)
    return (
        lookup(photos, wanted, ["id"], hot=False)
        .withColumn("changed", changed)
        .withColumn("label", F.when(F.col("changed"), F.lit(label)).otherwise(F.col("label")))
        .drop("_hit")
    )


def set_rotations(
    photos: DataFrame, updates: DataFrame, turns: str | None = None, delta: str | None = None
) -> DataFrame:
    """Sets quarter turns (``turns`` column, mod 4) or advances them (``delta``).

    ``updates`` has one row per id; each photo advances from its own turn.
    """
    if (turns is None) == (delta is None):
        raise ValueError("give either turns or delta")
    step = updates.select("id", F.col(turns or delta).alias("_turn"))
    new = F.pmod(F.col("_turn"), F.lit(4)).cast("int") if turns else turned("rot_cw", "_turn")
    return (
        lookup(photos, step, ["id"], hot=False)
        .withColumn("rot_cw", F.when(F.col("_turn").isNotNull(), new).otherwise(F.col("rot_cw")))
        .drop("_turn")
    )


def latest_by_key(log: DataFrame, keys: list, values: list, order: list) -> DataFrame:
    """Last write per key.  Partial aggregation keeps hot keys cheap."""
    picked = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return log.groupBy(*keys).agg(picked).select(*keys, "_last.*")


def current_labels(label_events: DataFrame) -> DataFrame:
    return latest_by_key(label_events, ["id"], ["label"], ["ts", "event_id"])


def current_rotation(rotation_events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Net quarter turns per photo on top of ``base(id, rot_cw)``, in 0..3.

    With ``base`` the result covers exactly its photos.
    """
    net = rotation_events.groupBy("id").agg(F.sum("delta").alias("_net"))
    if base is None:
        return net.select("id", turned(F.lit(0), "_net").alias("rot_cw"))
    return merged(base, net, ["id"]).withColumn(
        "rot_cw", turned("rot_cw", F.coalesce(F.col("_net"), F.lit(0)))
    ).drop("_net")


def apply_labels(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """Photos with the folded labels; photos without an event keep theirs."""
    new = labels.select("id", F.col("label").alias("_new"))
    return (
        merged(photos, new, ["id"])
        .withColumn("label", F.coalesce(F.col("_new"), F.col("label")))
        .drop("_new")
    )


def recent_roots(root_opens: DataFrame, limit: int = 10) -> DataFrame:
    """Most recently opened roots, newest first, ties by path."""
    newest = root_opens.groupBy("path").agg(F.max("opened_at").alias("last_opened"))
    return newest.orderBy(F.col("last_opened").desc(), "path").limit(limit)


def label_mask_labels(mask: int) -> list:
    """Label codes a mask lets through."""
    return [code for code in range(6) if mask == 0 or mask & (1 << code)]


def label_predicate(mask: int, label: str = "label") -> Column:
    """``label IN (...)``, a form the parquet reader can push down."""
    return F.lit(True) if mask == 0 else F.col(label).isin(*label_mask_labels(mask))


def stored_label_predicate(mask: int, label: str = "label") -> Column:
    """``label_predicate`` before validation, which maps codes outside of 0 to 5 to 0."""
    if mask == 0:
        return F.lit(True)
    given = label_predicate(mask, label)
    if not mask & 1:
        return given
    return given | (F.col(label) < 0) | (F.col(label) > 5) | F.col(label).isNull()
