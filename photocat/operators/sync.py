"""Scan-versus-index differences and the next index snapshot."""

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions import paths as P
from photocat.functions.display import bounded_error
from photocat.operators.joins import lookup, merged
from photocat.operators.ordering import number_rows
from photocat.operators.scan import PAIR_KEYS
from photocat.schema import (
    ERROR,
    INGEST_COLUMNS,
    MISSING,
    OK,
    PENDING,
    PHOTO_DEFAULTS,
    PHOTOS_SCHEMA,
    SCHEMA_VERSION,
)
from photocat.session import CO_PARTITION_ALL_KEYS, as_small, scoped_setting, stage

PHOTO_COLUMNS = PHOTOS_SCHEMA.names
INITIAL_PARTITIONS, FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 1_000


def upgrade_index(df: DataFrame, found_version: int) -> DataFrame:
    """Brings rows of an older schema version to the current columns and defaults."""
    if found_version > SCHEMA_VERSION:
        raise ValueError(
            f"index version {found_version} is newer than supported {SCHEMA_VERSION}"
        )
    have = set(df.columns)

    def value(field):
        name, dtype = field.name, field.dataType.simpleString()
        default = PHOTO_DEFAULTS.get(name)
        if name not in have:
            text = "NULL" if default is None else str(default)
        else:
            text = name if default is None else f"coalesce({name}, {default})"
        return f"CAST({text} AS {dtype}) AS {name}"

    return df.selectExpr(*[value(f) for f in PHOTOS_SCHEMA])


def needs_refresh(status, mtime_ns, size, new_mtime_ns, new_size):
    """A known file must be ingested again: it was missing or it changed."""
    return (
        (F.col(status) == MISSING)
        | (F.col(mtime_ns) != F.col(new_mtime_ns))
        | (F.col(size) != F.col(new_size))
    )


def one_depth(scanned_roots: DataFrame) -> DataFrame:
    """Each root once; a root that was scanned both ways is an error."""
    if scanned_roots in _distinct_roots:
        return scanned_roots
    deep = F.min(F.coalesce("recursive", F.lit(False)))
    both = F.concat(F.lit("scanned with and without subfolders: "), F.coalesce("root", F.lit("")))
    return scanned_roots.groupBy("root").agg(
        F.when(deep == F.max(F.coalesce("recursive", F.lit(False))), deep)
        .otherwise(F.raise_error(F.max(both)))
        .alias("recursive")
    )


# Frames that ``known_roots`` made; their roots are distinct.
_distinct_roots: weakref.WeakSet = weakref.WeakSet()


def known_roots(scanned_roots: DataFrame) -> DataFrame:
    """``one_depth``, fetched where that proves small, so later joins need no check."""
    once = one_depth(scanned_roots)
    found = as_small(once) or once
    _distinct_roots.add(found)
    return found


def scan_diff(scan: DataFrame, index: DataFrame, scanned_roots: DataFrame) -> DataFrame:
    """Every scanned or indexed row with what a sync does to it.

    ``scanned_roots(root, recursive)`` names the roots whose scan succeeded and
    how deep it went.  It cannot be inferred from the scan: a scanned root may
    hold no files at all.  Output: all index columns, ``new_mtime_ns``,
    ``new_size``, ``new_jpeg_rel_path`` and ``action``.

    A scan made with ``keep_keys`` is joined on its pairing columns too, which
    the path determines.  ``stage_diff`` plans that join so that it keeps the
    scan's partitioning and sort order and shuffles only the index.
    """
    seen = scan.select(
        "root",
        "rel_path",
        F.col("mtime_ns").alias("new_mtime_ns"),
        F.col("size").alias("new_size"),
        F.col("jpeg_rel_path").alias("new_jpeg_rel_path"),
        F.lit(True).alias("_seen"),
        *[c for c in PAIR_KEYS if c in scan.columns],
    )
    keys = ["root", "rel_path"]
    if set(PAIR_KEYS) <= set(scan.columns):
        index = index.withColumns(
            {"_dir": P.parent_dir("rel_path"), "_stem": P.lowered_stem("rel_path")}
        )
        keys = ["root", *PAIR_KEYS, "rel_path"]
    both = lookup(index.join(seen, keys, "full_outer"), one_depth(scanned_roots), ["root"])
    in_scope = F.col("recursive") | P.is_direct_child("rel_path")
    action = (
        F.when(F.col("id").isNull(), "insert")
        .when(
            F.col("_seen"),
            F.when(
                needs_refresh("status", "mtime_ns", "size", "new_mtime_ns", "new_size"), "reset"
            )
            .when(~F.col("jpeg_rel_path").eqNullSafe(F.col("new_jpeg_rel_path")), "reattach")
            .otherwise("keep"),
        )
        .when(F.col("recursive").isNull() | ~in_scope, "out_of_scope")
        .when(F.col("status") == MISSING, "still_missing")
        .otherwise("mark_missing")
    )
    return both.withColumn("action", action).drop("_seen", "recursive", *PAIR_KEYS)


def missing_photos(scan: DataFrame, index: DataFrame, scanned_roots: DataFrame) -> DataFrame:
    """Live index rows inside the scan's depth scope that the scan did not see."""
    return (
        lookup(index.where(F.col("status") != MISSING), one_depth(scanned_roots), ["root"], "inner")
        .where(F.col("recursive") | P.is_direct_child("rel_path"))
        .drop("recursive")
        .join(scan.select("root", "rel_path"), ["root", "rel_path"], "left_anti")
    )


CHANGE_COLUMNS = ["id", "root", "rel_path", "new_mtime_ns", "new_size", "new_jpeg_rel_path", "action"]


def stage_changes(diff: DataFrame) -> DataFrame:
    """Writes the rows that a sync changes, with the seven columns it needs.

    The join runs on these columns only and reuses the scan's partitioning; an
    unchanged library leaves an empty table.  Shuffles start with many partitions, which
    Spark merges by their sizes, so what one task sorts does not grow with the table.
    """
    same = ("keep", "still_missing", "out_of_scope")
    changes = diff.where(~F.col("action").isin(*same)).select(*CHANGE_COLUMNS)
    spark = diff.sparkSession
    parts = max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with scoped_setting(spark, CO_PARTITION_ALL_KEYS, "false"), scoped_setting(spark, INITIAL_PARTITIONS, str(parts)):
        return stage(changes, "changes")


def apply_sync(diff: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The next snapshot of the index, from a ``scan_diff`` of all of it.

    With the ``index`` itself the diff is evaluated once; else kept rows come from it again.

    Reset rows return to pending with cleared ingest columns but keep id, label
    and rotation; reattached rows change only their pairing; missing rows only
    their status.  New rows get ids above the highest known one, in path order.
    """
    if index is None:
        index = diff.where("action <> 'insert'").select(*PHOTO_COLUMNS)
    return apply_changes(index, stage_changes(diff))


def apply_changes(index: DataFrame, changes: DataFrame, highest_id: int | None = None) -> DataFrame:
    """``index`` with staged ``changes``; see ``apply_sync``.

    ``highest_id`` names the highest known id when ``index`` is a part only.
    """
    updates, new = changes.selectExpr(
        "count_if(action <> 'insert')", "count_if(action = 'insert')"
    ).head()
    kept = index.select(*PHOTO_COLUMNS)
    if updates:
        changed = changes.where("action <> 'insert'").drop("root", "rel_path")
        kept = lookup(kept, changed, ["id"], hot=False).selectExpr(*[_next_value(f) for f in PHOTOS_SCHEMA])
    if not new:
        return kept
    top = highest_id
    if top is None:
        top = index.agg(F.max("id")).head()[0]
    fresh = changes.where("action = 'insert'").selectExpr(
        "root",
        "rel_path",
        "new_mtime_ns AS mtime_ns",
        "new_size AS size",
        "new_jpeg_rel_path AS jpeg_rel_path",
    )
    fresh = number_rows(fresh, [F.col("root"), P.path_key("rel_path")], new)
    fresh = fresh.withColumn("id", F.expr(f"pos + {top or 0}L + 1L")).drop("pos")
    return kept.unionByName(upgrade_index(fresh, SCHEMA_VERSION))


def _next_value(field) -> str:
    """SQL of a stored column after the row's ``action``; null means no change."""
    name = field.name
    if name in ("mtime_ns", "size"):
        text = f"CASE WHEN action = 'reset' THEN new_{name} ELSE {name} END"
    elif name == "jpeg_rel_path":
        text = f"CASE WHEN action IN ('reset', 'reattach') THEN new_{name} ELSE {name} END"
    elif name == "status":
        text = (
            f"CASE action WHEN 'reset' THEN {PENDING} WHEN 'mark_missing' THEN {MISSING}"
            " ELSE status END"
        )
    elif name == "orientation":
        text = f"CASE WHEN action = 'reset' THEN {PHOTO_DEFAULTS[name]} ELSE {name} END"
    elif name in (*INGEST_COLUMNS, "err_msg", "ingested_at"):
        text = f"CASE WHEN action = 'reset' THEN NULL ELSE {name} END"
    else:
        text = name
    return f"CAST({text} AS {field.dataType.simpleString()}) AS {name}"


def record_ingest(photos: DataFrame, results: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Merges ingest results; rows without a result and unknown ids change nothing.

    A success sets status, the ingest columns and the stamp; an error sets only
    status and message.  Several results of one photo apply in ``order``.
    """
    ok, failed = F.col("kind") == "ok", F.col("kind") == "error"
    info = F.struct(*INGEST_COLUMNS, "ingested_at")
    folded = results.groupBy("id").agg(
        F.max_by("kind", order).alias("_kind"),
        F.max_by(info, F.when(ok, F.col(order))).alias("_info"),
        F.max_by(bounded_error("err_msg"), F.when(failed, F.col(order))).alias("_err"),
        F.max(failed).alias("_failed"),
    )

    def value(field):
        name = field.name
        if name == "status":
            text = f"CASE _kind WHEN 'ok' THEN {OK} WHEN 'error' THEN {ERROR} ELSE status END"
        elif name == "err_msg":
            text = "CASE WHEN _failed THEN _err ELSE err_msg END"
        elif name in (*INGEST_COLUMNS, "ingested_at"):
            text = f"CASE WHEN _info IS NOT NULL THEN _info.{name} ELSE {name} END"
        else:
            text = name
        return f"CAST({text} AS {field.dataType.simpleString()}) AS {name}"

    return merged(photos, folded, ["id"]).selectExpr(*[value(f) for f in PHOTOS_SCHEMA])
