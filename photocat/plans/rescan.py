"""Rescan: listing and previous snapshot to next snapshot and its summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions.paths import RAW_EXTENSIONS
from photocat.operators.ingest import ingest_job
from photocat.operators.scan import scan
from photocat.operators.stats import tally_counts
from photocat.operators.sync import (
    apply_changes,
    known_roots,
    record_ingest,
    scan_diff,
    stage_changes,
)
from photocat.operators.views import for_root, pending_queue
from photocat.schema import LABEL_COUNTS, PENDING
from photocat.session import stage
from photocat.sources.index_store import highest_id, read_index, write_index


def sync_roots(
    listing: DataFrame,
    index: DataFrame,
    scanned_roots: DataFrame,
    raw_exts=RAW_EXTENSIONS,
) -> DataFrame:
    """Scans the given roots and returns the next index snapshot."""
    scanned_roots = known_roots(scanned_roots)
    found = scan(listing, raw_exts=raw_exts, roots=scanned_roots, keep_keys=True)
    return apply_changes(index, stage_changes(scan_diff(found, index, scanned_roots)))


def sync_store(
    listing: DataFrame,
    store: str,
    scanned_roots: DataFrame,
    raw_exts=RAW_EXTENSIONS,
    batch_id: int | None = None,
    stream: str = "",
) -> int:
    """Syncs the scanned roots of a stored index and publishes what changed.

    Only the scanned roots are read and only those with a change are written,
    however large the rest of the index is.
    """
    spark = listing.sparkSession
    scanned_roots = known_roots(scanned_roots)
    mine = for_root(read_index(spark, store), scanned_roots)
    found = scan(listing, raw_exts=raw_exts, roots=scanned_roots, keep_keys=True)
    changes = stage_changes(scan_diff(found, mine, scanned_roots))
    photos = apply_changes(mine, changes, highest_id(spark, store))
    return write_index(photos, store, batch_id, changes.select("root").distinct(), stream)


def rescan_summary(
    listing: DataFrame,
    index: DataFrame,
    scanned_roots: DataFrame,
    raw_exts=RAW_EXTENSIONS,
) -> DataFrame:
    """Per root after a rescan: photos per label, errors, and how many to ingest.

    A scanned root without any photo has a row of zeros.
    """
    scanned_roots = known_roots(scanned_roots)
    photos = sync_roots(listing, index, scanned_roots, raw_exts)
    pending = F.count_if(F.col("status") == PENDING).alias("n_pending")
    counts = photos.groupBy("root").agg(*tally_counts(), pending)
    names = [*LABEL_COUNTS.values(), "n_errors", "n_pending"]
    # One pass: roots without photos come in by the outer side.
    every = counts.join(scanned_roots.select("root").distinct(), "root", "full_outer")
    return every.select("root", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def ingest_pending(photos: DataFrame, read_header, stages: list) -> DataFrame:
    """Extracts the pending photos and merges the results into the snapshot.

    Results are written before they are merged: extraction is the expensive
    step and must not run again when the merge does.
    """
    results = stage(ingest_job(pending_queue(photos), read_header, stages), "ingest")
    return record_ingest(photos, results)
