"""Filtered, sorted, positioned views of the index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions import paths as P
from photocat.operators.edits import label_predicate
from photocat.operators.joins import lookup
from photocat.operators.ordering import following, rank_rows, shifted
from photocat.schema import ERROR, MISSING, PENDING
from photocat.session import stage

ENTRY_COLUMNS = [
    "id", "root", "rel_path", "label", "status", "width", "height", "orientation",
    "rot_cw", "thumb_path", "err_msg", "jpeg_rel_path",
]
DETAIL_COLUMNS = [
    *ENTRY_COLUMNS, "preview_path", "camera", "lens", "taken_at", "shutter",
    "aperture", "iso", "focal_mm",
]
U32_MAX, U16_MAX = 4294967295, 65535
# Roots that a filter names one by one.
MAX_LISTED_ROOTS = 1000


def validate_rows(photos: DataFrame) -> DataFrame:
    """Decode rules for stored rows: out-of-range codes fall back, pixels pair up."""

    def pixel(name):
        stored = F.greatest(F.col(name), F.lit(0).cast("bigint"))
        return F.when(F.col(name).isNotNull() & (stored <= U32_MAX), stored)

    wide, high = pixel("width"), pixel("height")
    both = wide.isNotNull() & high.isNotNull()
    rules = {
        "label": F.when(F.col("label").between(0, 5), F.col("label")).otherwise(0),
        "status": F.when(F.col("status").between(0, 3), F.col("status")).otherwise(0),
        "rot_cw": F.pmod(F.col("rot_cw"), F.lit(4)).cast("int"),
        "orientation": F.when(
            F.col("orientation").between(0, U16_MAX), F.col("orientation")
        ).otherwise(1),
        "width": F.when(both, wide),
        "height": F.when(both, high),
        "iso": F.when(F.col("iso").between(0, U32_MAX), F.col("iso")),
    }
    return photos.withColumns({k: v for k, v in rules.items() if k in photos.columns})


def entries(photos: DataFrame) -> DataFrame:
    """The narrow row a contact sheet needs."""
    return validate_rows(photos.select(*ENTRY_COLUMNS))


def details(photos: DataFrame) -> DataFrame:
    """The wide row with exposure metadata."""
    return validate_rows(photos.select(*DETAIL_COLUMNS))


def live_entries(photos: DataFrame) -> DataFrame:
    """Rows not missing, in path order per root."""
    live = photos.where(F.col("status") != MISSING)
    return entries(live).orderBy("root", P.path_key("rel_path"))


def pending_queue(photos: DataFrame) -> DataFrame:
    """Rows awaiting ingest, in byte order of the path (not path order)."""
    return (
        photos.where(F.col("status") == PENDING)
        .select("id", "root", "rel_path", "mtime_ns", "size", "jpeg_rel_path")
        .orderBy("root", "rel_path")
    )


def photo_by_id(photos: DataFrame, photo_id: int) -> DataFrame:
    """One row, also a missing one; empty when the id is unknown."""
    return entries(photos.where(F.col("id") == photo_id))


def paired_only(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("jpeg_rel_path").isNotNull())


def for_root(events: DataFrame, roots) -> DataFrame:
    """Rows of the served roots; works on streams too.

    ``roots`` is a list of roots or a DataFrame with a ``root`` column.  A short
    list becomes a plain filter, which prunes partitions by root; a longer one is
    joined.
    """
    if not isinstance(roots, DataFrame):
        return events.where(F.col("root").isin(list(roots)))
    few = roots.select("root").distinct().limit(MAX_LISTED_ROOTS + 1).collect()
    if len(few) <= MAX_LISTED_ROOTS:
        return events.where(F.col("root").isin([r.root for r in few]))
    return lookup(events, roots.select("root").distinct(), ["root"], "left_semi")


def label_filter(df: DataFrame, mask: int) -> DataFrame:
    return df.where(label_predicate(mask))


def with_taken_at(view: DataFrame, photos: DataFrame) -> DataFrame:
    """Adds the capture stamp; null where the index has none."""
    return view.join(photos.select("id", "taken_at"), "id", "left")


def path_order() -> list:
    return [P.path_key("rel_path")]


def sort_filename() -> list:
    """Unicode-lowered file name, ties by path order."""
    return [F.lower(P.file_name("rel_path")), *path_order()]


def sort_taken_at() -> list:
    """Capture stamp, photos without one last, ties by path order."""
    return [F.col("taken_at").asc_nulls_last(), *path_order()]


SORTS = {"path": path_order, "filename": sort_filename, "taken_at": sort_taken_at}


def ordered_view(
    rows: DataFrame, mask: int = 0, sort: str = "filename", total: str | None = None
) -> DataFrame:
    """Rows that pass the filter with their 0-based display position per root.

    Sorting by ``taken_at`` needs that column on ``rows``.
    """
    return rank_rows(label_filter(rows, mask), ["root"], SORTS[sort](), total=total)


def position_of_total(rows: DataFrame, mask: int = 0, sort: str = "filename") -> DataFrame:
    """Adds the 1-based position and the number of photos shown per root."""
    view = ordered_view(rows, mask, sort, total="total")
    return view.withColumn("position", F.col("pos") + 1).drop("pos")


def neighbors(view: DataFrame, reach: int = 3) -> DataFrame:
    """Ids within ``reach`` positions, nearest first, left before right."""
    shifts = {}
    for distance in range(1, reach + 1):
        shifts[f"_l{distance}"] = ("id", distance)
        shifts[f"_r{distance}"] = ("id", -distance)
    near = shifted(view.select("root", "id", "pos"), ["root"], "pos", shifts, reach)
    return near.withColumn("neighbors", F.array_compact(F.array(*shifts))).drop(*shifts)


def advance_target(view: DataFrame) -> DataFrame:
    """The photo the cursor moves to after labelling: the next one, or itself at the end."""
    rows = shifted(
        view.select("root", "id", "pos"), ["root"], "pos", {"_next": ("id", -1)}, 1
    )
    return rows.withColumn("target_id", F.coalesce(F.col("_next"), F.col("id"))).drop("_next")


def next_error(view: DataFrame) -> DataFrame:
    """The next failed photo after each row, wrapping; null when nothing failed.

    The view is written once; its group sizes and the result come from that table.
    """
    failed = F.when(F.col("status") == ERROR, F.col("id"))
    shown = stage(view.select("root", "id", "pos", "status"), "shown")
    rows = following(shown, ["root"], "pos", failed, "_next", "_first")
    return rows.withColumn(
        "next_error_id", F.coalesce(F.col("_next"), F.col("_first"))
    ).drop("_next", "_first")


def sheet_pages(view: DataFrame, columns: int) -> DataFrame:
    """Row and column of every photo in a sheet of ``columns`` per row."""
    return view.withColumn(
        "sheet_row", F.call_function("div", F.col("pos"), F.lit(columns))
    ).withColumn("sheet_col", F.pmod("pos", F.lit(columns)).cast("bigint"))


def sheet_rows(view: DataFrame, columns: int) -> DataFrame:
    """Number of sheet rows per root."""
    return view.groupBy("root").agg(
        F.ceil(F.count("*") / F.lit(columns)).alias("sheet_rows")
    )


def prioritize(
    queue: DataFrame, wanted: DataFrame, group: list, position: str = "queue_pos"
) -> DataFrame:
    """Wanted ids first, each part in queue order; unknown ids are ignored.

    Adds the new 0-based ``priority_pos`` per group.
    """
    hits = wanted.select("id").distinct().withColumn("wanted", F.lit(True))
    marked = queue.join(hits, "id", "left").withColumn(
        "wanted", F.coalesce(F.col("wanted"), F.lit(False))
    )
    order = [F.col("wanted").desc(), F.col(position)]
    return rank_rows(marked, group, order, pos="priority_pos", bound=queue)


def queue_positions(photos: DataFrame) -> DataFrame:
    """The pending queue with each row's 0-based place in its root's queue."""
    pending = photos.where(F.col("status") == PENDING).select("id", "root", "rel_path")
    return rank_rows(pending, ["root"], [F.col("rel_path")], pos="queue_pos")
