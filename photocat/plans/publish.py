"""Edits and ingest results published into a stored index.

Only the roots that hold a changed photo are read and replaced.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.operators.edits import apply_labels, current_labels, set_labels, set_rotations
from photocat.operators.ingest import ingest_job
from photocat.operators.joins import lookup
from photocat.operators.sync import record_ingest
from photocat.operators.views import for_root, pending_queue
from photocat.session import stage
from photocat.sources.index_store import read_index, write_index


def _publish(spark: SparkSession, store: str, ids: DataFrame, change, **batch) -> int | None:
    """Replaces the roots of ``ids`` by ``change`` of their rows; None if no photo is known."""
    index = read_index(spark, store)
    held = lookup(index.select("id", "root"), ids.select("id").distinct(), ["id"], "left_semi", hot=False)
    roots = stage(held.select("root").distinct(), "roots")
    if roots.isEmpty():
        return None
    return write_index(change(for_root(index, roots)), store, changed_roots=roots, **batch)


def publish_labels(spark: SparkSession, store: str, ids: DataFrame, label: int, **batch) -> int | None:
    """One label on many photos.  Roots in which no label differs are not written.

    ``batch`` may hold ``batch_id`` and ``stream``, as for ``write_index``.  Returns the
    publication's number, None if nothing changes.
    """
    others = read_index(spark, store).where(~F.col("label").eqNullSafe(label))
    differs = lookup(others.select("id"), ids.select("id").distinct(), ["id"], "left_semi", hot=False)
    changed = stage(differs.select("id"), "relabelled")
    return _publish(spark, store, changed, lambda mine: set_labels(mine, changed, label), **batch)


def publish_label_events(spark: SparkSession, store: str, events: DataFrame, **batch) -> int | None:
    """Applies a label log: the last event of each photo."""
    labels = stage(current_labels(events.where("id IS NOT NULL")), "labels")
    return _publish(spark, store, labels, lambda mine: apply_labels(mine, labels), **batch)


def publish_rotations(
    spark: SparkSession, store: str, updates: DataFrame, turns: str | None = None, delta: str | None = None, **batch
) -> int | None:
    """Sets or advances quarter turns, one row of ``updates`` per id."""
    updates = stage(updates, "turns")
    return _publish(spark, store, updates, lambda mine: set_rotations(mine, updates, turns, delta), **batch)


def publish_ingest(spark: SparkSession, store: str, results: DataFrame, **batch) -> int | None:
    """Merges ingest results."""
    results = stage(results, "results")
    return _publish(spark, store, results, lambda mine: record_ingest(mine, results), **batch)


def ingest_store(spark: SparkSession, store: str, read_header, stages: list, **batch) -> int | None:
    """Extracts all pending photos of a stored index and publishes what came out."""
    pending = pending_queue(read_index(spark, store))
    return publish_ingest(spark, store, ingest_job(pending, read_header, stages), **batch)
