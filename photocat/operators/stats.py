"""Counts and rates.  All are partial aggregations: hot groups combine map-side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.functions.paths import file_ext
from photocat.operators.edits import label_predicate
from photocat.operators.joins import lookup
from photocat.operators.ordering import following, running_max
from photocat.schema import ERROR, LABEL_COUNTS, MISSING


def tally(photos: DataFrame) -> DataFrame:
    """Photos per label, zero-filled, and errors, over the live rows of every root.

    A root of which only missing rows are left has a row of zeros.
    """
    return photos.groupBy("root").agg(*tally_counts())


def tally_counts() -> list:
    """The counts of ``tally`` as aggregates."""
    live = F.coalesce(F.col("status") != MISSING, F.lit(False))
    counts = [F.count_if(live & (F.col("label") == k)).alias(n) for k, n in LABEL_COUNTS.items()]
    return [*counts, F.count_if(F.col("status") == ERROR).alias("n_errors")]


def status_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy("root", "status").agg(F.count("*").alias("n"))


def sheet_stats(photos: DataFrame, mask: int, selection: DataFrame) -> DataFrame:
    """Per root: live rows, rows the filter shows, selected rows (also hidden ones).

    A root of which only missing rows are left has a row of zeros.
    """
    hits = selection.select("id").distinct().withColumn("_hit", F.lit(True))
    live = F.col("status") != MISSING
    return (
        photos.join(hits, "id", "left")
        .groupBy("root")
        .agg(
            F.count_if(live).alias("total"),
            F.count_if(live & label_predicate(mask)).alias("shown"),
            F.count_if(live & F.col("_hit")).alias("selected"),
        )
    )


def export_count(scope: DataFrame, mode: str = "all") -> DataFrame:
    """Photos of the export scope that contribute at least one file."""
    counts = F.col("jpeg_rel_path").isNotNull() if mode == "jpeg" else F.lit(True)
    return scope.groupBy("root").agg(F.count_if(counts).alias("n"))


def active_spans(batches: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """When each generation was active: ``started_event_id``, ``_until`` (null: still) and ``_cancelled``.

    A generation ends at the job's next start, or before it at a row of
    ``cancels(job, event_id)``.  Cancels of a job that runs nothing change
    nothing; one at the very event of a start ends what ran before.
    """
    marks = batches.select("job", "generation", "started_event_id")
    if cancels is not None:
        kind = batches.schema["generation"].dataType
        stops = cancels.select(
            "job", F.lit(None).cast(kind).alias("generation"), F.col("event_id").alias("started_event_id")
        )
        marks = marks.unionByName(stops).groupBy("job", "started_event_id").agg(F.max("generation").alias("generation"))
    mark = F.struct("started_event_id", F.col("generation").isNull().alias("stop"))
    spans = following(marks, ["job"], "started_event_id", mark, "_next", "_first")
    if cancels is not None:
        spans = spans.where(F.col("generation").isNotNull())
    return spans.select(
        "job",
        "generation",
        "started_event_id",
        F.col("_next.started_event_id").alias("_until"),
        (F.lit(cancels is not None) & F.coalesce(F.col("_next.stop"), F.lit(False))).alias("_cancelled"),
    )


def fresh_events(events: DataFrame, batches: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """Events with ``fresh``: their generation was the job's active one.

    A generation is active from its own start until the job's next start or
    cancel, so one equi-join to the event's own batch decides.  Events of a
    generation that never started are not fresh.
    """
    spans = active_spans(batches, cancels).drop("_cancelled")
    joined = lookup(events, spans, ["job", "generation"])
    fresh = (F.col("event_id") >= F.col("started_event_id")) & (
        F.col("_until").isNull() | (F.col("event_id") < F.col("_until"))
    )
    return joined.withColumn("fresh", F.coalesce(fresh, F.lit(False))).drop(
        "started_event_id", "_until"
    )


def batch_accounting(events: DataFrame, batches: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """Per batch: enqueued, ingested, failed, dropped as stale, and finished.

    A batch that a cancel ended is finished: what it still had queued counts as dropped.
    """
    fresh = F.col("fresh")
    done = (
        fresh_events(events.select("job", "generation", "event_id", "kind"), batches, cancels)
        .groupBy("job", "generation")
        .agg(
            F.count_if(fresh & (F.col("kind") == "Ingested")).alias("ingested"),
            F.count_if(fresh & (F.col("kind") == "Failed")).alias("failed"),
            F.count_if(~fresh).alias("dropped"),
        )
    )
    zero = F.lit(0).cast("bigint")
    out = batches.select("job", "generation", "enqueued").join(
        done, ["job", "generation"], "left"
    )
    out = out.withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("ingested", "failed", "dropped")}
    )
    out = out.withColumn(
        "finished",
        F.col("ingested") + F.col("failed") + F.col("dropped") == F.col("enqueued"),
    )
    if cancels is None:
        return out
    ended = active_spans(batches, cancels).where("_cancelled").select("job", "generation", "_cancelled")
    left = F.col("enqueued") - F.col("ingested") - F.col("failed")
    return (
        out.join(ended, ["job", "generation"], "left")
        .withColumns(
            {
                "dropped": F.when(F.col("_cancelled"), F.greatest("dropped", left)).otherwise(F.col("dropped")),
                "finished": F.coalesce(F.col("_cancelled"), F.col("finished")),
            }
        )
        .drop("_cancelled")
    )


def latest_ingest_status(events: DataFrame, batches: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """Latest outcome per (job, photo), ignoring events of superseded or cancelled batches."""
    fresh = fresh_events(events.select("job", "generation", "event_id", "id", "kind"), batches, cancels)
    return (
        fresh.where("fresh")
        .groupBy("job", "id")
        .agg(F.max_by("kind", "event_id").alias("kind"), F.max("event_id").alias("event_id"))
    )


def _seconds(first: Column, last: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", first, last) / F.lit(1e6)


def ingest_rate(events: DataFrame) -> DataFrame:
    """Whole files per second over each batch so far, at least half a second."""
    spent = _seconds(F.min("ts"), F.max("ts"))
    return events.groupBy("job", "generation").agg(
        F.count("*").alias("done"),
        F.floor(F.count("*") / F.greatest(spent, F.lit(0.5))).alias("rate"),
    )


def names_preview(names: DataFrame, group: list, order: str = "ordinal", show: int = 4):
    """First names of each group joined by commas, then how many more there are.

    Only the first ``show`` rows per group leave the map side.
    """
    w = W.partitionBy(*group).orderBy(order)
    first = (
        names.select(*group, "name", order)
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= show)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("_n", "name"))).alias("_shown"))
    )
    counts = names.groupBy(*group).agg(F.count("*").alias("_all"))
    shown = F.array_join(F.col("_shown.name"), ", ")
    rest = F.concat(F.lit(", … and "), (F.col("_all") - show).cast("string"), F.lit(" more"))
    return first.join(counts, group).select(
        *group,
        F.when(F.col("_all") > show, F.concat(shown, rest)).otherwise(shown).alias("preview"),
    )


def media_mix(scanned: DataFrame, ext: str = "cr3") -> DataFrame:
    """Share of one RAW format per root; a majority makes it reference media."""
    hits = F.count_if(file_ext("rel_path") == ext)
    return scanned.groupBy("root").agg(
        F.count("*").alias("total"),
        hits.alias("matching"),
        (hits / F.count("*")).alias("share"),
        (hits * 2 >= F.count("*")).alias("reference_media"),
    )


def progress_monotonic(ticks: DataFrame, group: str = "job", order: str = "event_id") -> DataFrame:
    """Progress per tick that never goes back: ``shown`` is the largest ``done`` so far."""
    return running_max(ticks, [group], order, "done", "shown")
