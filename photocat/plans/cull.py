"""Culling: fold edits into the index, then filter, sort and export."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.operators.edits import (
    apply_labels,
    current_labels,
    current_rotation,
    stored_label_predicate,
)
from photocat.operators.export import export_plan, export_scope, export_set
from photocat.operators.views import ENTRY_COLUMNS, ordered_view, validate_rows
from photocat.schema import MISSING


def edited_photos(
    photos: DataFrame, label_events: DataFrame, rotation_events: DataFrame
) -> DataFrame:
    """The index with both edit logs folded in."""
    labelled = apply_labels(photos, current_labels(label_events))
    return current_rotation(rotation_events, labelled)


def culled_view(photos: DataFrame, mask: int = 0, sort: str = "filename") -> DataFrame:
    """Live rows of every root, filtered and in display order."""
    # On stored columns, so that status and label filters reach the scan.
    live = photos.where((F.col("status") != MISSING) & stored_label_predicate(mask))
    rows = validate_rows(live.select(*ENTRY_COLUMNS, *(["taken_at"] if sort == "taken_at" else [])))
    return ordered_view(rows, mask, sort)


def planned_export(
    photos: DataFrame,
    selection: DataFrame,
    dest_files: DataFrame,
    dest: str,
    mask: int = 0,
    sort: str = "filename",
    mode: str = "all",
) -> DataFrame:
    """The inspectable copy plan; run it with ``export_files``."""
    scope = export_scope(culled_view(photos, mask, sort), photos, selection)
    return export_plan(export_set(scope, mode), dest_files, dest)
