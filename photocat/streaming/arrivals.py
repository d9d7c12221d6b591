"""Listing snapshots, ingest results and relabels that arrive as streams, published into an index store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions.paths import RAW_EXTENSIONS
from photocat.plans.publish import publish_ingest, publish_label_events
from photocat.plans.rescan import sync_store


def stream_sync(
    listings: DataFrame,
    store: str,
    checkpoint: str,
    recursive: bool = True,
    raw_exts=RAW_EXTENSIONS,
    stream: str | None = None,
):
    """Syncs every arriving listing snapshot into an index store; returns a writer.

    ``stream`` names the stream in the store and must change with the checkpoint, whose
    batch numbers it qualifies; by default it is the checkpoint's path.

    A micro-batch must hold the whole listing of each root it mentions, for
    example one file per snapshot with ``maxFilesPerTrigger=1``, or all files of a snapshot, however
    many, in a run that starts once they are there.  A row with a
    null path says that its root was scanned, which is how an empty root
    reports itself.  A repeated micro-batch publishes nothing new.

    Where listings carry ``n_files``, the number of files of their root's snapshot, a
    micro-batch that holds another number is refused before anything is
    marked missing: the stream fails and goes on when the source is mended.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if "n_files" in batch.columns:
            _refuse_parts(batch)
        scanned = batch.select("root").distinct().withColumn("recursive", F.lit(recursive))
        files = batch.where(F.col("rel_path").isNotNull())
        sync_store(files, store, scanned, raw_exts, batch_id, stream or checkpoint)

    return listings.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def _refuse_parts(batch: DataFrame) -> None:
    """Raises for roots whose rows are not as many as their snapshot says."""
    said = F.max("n_files")
    counts = batch.groupBy("root").agg(F.count("rel_path").alias("n"), said.alias("said"), F.min("n_files").alias("low"))
    wrong = counts.where("said IS NOT NULL AND (n <> said OR low <> said)").orderBy("root").head(3)
    if wrong:
        raise ValueError("not a whole listing: " + ", ".join(f"{r.root} has {r.n} of {r.said} files" for r in wrong))


def stream_publish_ingest(results: DataFrame, store: str, checkpoint: str, stream: str | None = None):
    """Merges arriving ingest results into an index store; returns a writer.

    Only roots with a photo of the micro-batch are read and replaced.  Within a micro-batch
    results of one photo apply in the order of ``ingested_at``, micro-batches in theirs.
    Unknown ids change nothing; a repeated micro-batch publishes nothing new.
    Results of superseded batches are left out before, by ``stream_ingest_state`` or
    ``fresh_events``.  ``stream`` is as for ``stream_sync``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        known = batch.where("id IS NOT NULL")
        publish_ingest(batch.sparkSession, store, known, batch_id=batch_id, stream=stream or checkpoint)

    return results.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def stream_publish_labels(label_events: DataFrame, store: str, checkpoint: str, stream: str | None = None):
    """Applies arriving label events to an index store; returns a writer.

    Of one photo's events in a micro-batch the last by (``ts``, ``event_id``) counts;
    micro-batches apply in their order.  ``stream`` is as for ``stream_sync``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        publish_label_events(batch.sparkSession, store, batch, batch_id=batch_id, stream=stream or checkpoint)

    return label_events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
