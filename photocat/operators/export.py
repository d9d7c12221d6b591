"""Export of originals: scope, file list, plan, copy and report."""

import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions.paths import file_name
from photocat.operators.joins import lookup, merged
from photocat.session import stage

MODES = ("all", "raw", "jpeg")


def parse_mode(text: str | None) -> str:
    """Stored mode text; anything unknown means all files."""
    return text if text in MODES else "all"


def export_scope(view: DataFrame, entries: DataFrame, selection: DataFrame) -> DataFrame:
    """What export works on: selected and shown photos, or the whole view.

    A root with any selected photo, shown or hidden, exports only the selected
    ones it shows; a root without a selection exports its view.
    """
    hits = selection.select("id").distinct()
    chosen = (
        entries.select("id", "root")
        .join(hits, "id", "left_semi")
        .select("root")
        .distinct()
        .withColumn("_chosen", F.lit(True))
    )
    marked = view.join(hits.withColumn("_hit", F.lit(True)), "id", "left")
    return (
        lookup(marked, chosen, ["root"])
        .where(F.col("_chosen").isNull() | F.col("_hit"))
        .drop("_chosen", "_hit")
    )


def export_set(scope: DataFrame, mode: str = "all") -> DataFrame:
    """One row per file to copy; a companion JPEG follows its RAW.

    ``ordinal`` orders the files of a root like its display.
    """
    raw = F.col("rel_path") if mode in ("all", "raw") else F.lit(None).cast("string")
    jpeg = F.col("jpeg_rel_path") if mode in ("all", "jpeg") else F.lit(None).cast("string")
    files = scope.select(
        "id", "root", "pos", F.posexplode(F.array(raw, jpeg)).alias("side", "file")
    ).where(F.col("file").isNotNull())
    return files.select(
        "root",
        (F.col("pos") * 2 + F.col("side")).alias("ordinal"),
        "id",
        F.concat_ws("/", "root", "file").alias("source"),
        file_name("file").alias("name"),
    )


def existing_names(files: DataFrame, dest_files: DataFrame) -> DataFrame:
    """Source names the destination already holds, at their first occurrence."""
    first = files.groupBy("name").agg(F.min(F.struct("root", "ordinal")).alias("_first"))
    return first.join(dest_files.select("name"), "name", "left_semi").select(
        "name", "_first.*"
    )


def export_winner(files: DataFrame) -> DataFrame:
    """The file that remains under each name: the last one in order."""
    last = F.max(F.struct("root", "ordinal", "id", "source")).alias("_last")
    return files.groupBy("name").agg(last).select("name", "_last.*")


def export_plan(files: DataFrame, dest_files: DataFrame, dest: str) -> DataFrame:
    """Adds destination path, action and whether the file is the one that remains.

    The winner flag joins on (root, ordinal), which is unique, so a name shared
    by very many files does not gather in one task.
    """
    wins = export_winner(files).select("root", "ordinal", F.lit(True).alias("_wins"))
    there = dest_files.select("name").distinct().withColumn("_there", F.lit(True))
    target = F.concat(F.lit(dest.rstrip("/") + "/"), F.col("name"))
    planned = merged(lookup(files, there, ["name"]), wins, ["root", "ordinal"])
    action = (
        F.when(F.col("_there") & (F.col("source") == target), "skip_same")
        .when(F.col("_there"), "overwrite")
        .otherwise("copy")
    )
    return planned.select(
        "root",
        "ordinal",
        "id",
        "source",
        "name",
        target.alias("dest_path"),
        action.alias("action"),
        F.coalesce("_wins", F.lit(False)).alias("winner"),
    )


def export_report(results: DataFrame, planned: int | None = None) -> DataFrame:
    """Copied, failed and processed counts; cancelled when fewer than planned ran."""
    report = results.agg(
        F.count_if("ok").alias("copied"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count("*").alias("processed"),
    )
    if planned is None:
        return report
    return report.withColumn("cancelled", F.col("processed") < planned)


def export_failures(results: DataFrame) -> DataFrame:
    """Failed sources with their reason, in export order."""
    return results.where(~F.col("ok")).select("root", "ordinal", "source", "reason").orderBy(
        "root", "ordinal"
    )


_PROBED = (
    "root string, ordinal bigint, source string, dest_path string, "
    "ok boolean, reason string, same boolean"
)
_COPIED = "root string, ordinal bigint, dest_path string, ok boolean, reason string"


def _file_workers():
    """Task functions; nested so that executors need no installed package."""

    def reason_of(error):
        if error.errno is None:
            return str(error)
        return f"{os.strerror(error.errno)} (os error {error.errno})"

    def probe_one(source, dest_path):
        same = os.path.exists(dest_path) and os.path.realpath(source) == os.path.realpath(dest_path)
        try:
            with open(source, "rb"):
                return True, None, same
        except OSError as error:
            return False, reason_of(error), False

    def probe(batches):
        for pdf in batches:
            found = [probe_one(s, d) for s, d in zip(pdf["source"], pdf["dest_path"])]
            checks = pd.DataFrame(found, columns=["ok", "reason", "same"], index=pdf.index)
            yield pd.concat([pdf[["root", "ordinal", "source", "dest_path"]], checks], axis=1)

    def copy_one(source, dest_path):
        try:
            shutil.copyfile(source, dest_path)
            shutil.copymode(source, dest_path)
            return True, None
        except OSError as error:
            return False, reason_of(error)

    def copy(batches):
        for pdf in batches:
            done = [copy_one(s, d) for s, d in zip(pdf["source"], pdf["dest_path"])]
            checks = pd.DataFrame(done, columns=["ok", "reason"], index=pdf.index)
            yield pd.concat([pdf[["root", "ordinal", "dest_path"]], checks], axis=1)

    return probe, copy


def export_files(plan: DataFrame, dest: str, tasks: int | None = None) -> DataFrame:
    """Copies the planned files into ``dest``; one result row per source.

    ``copies`` counts how often a source was copied in full, once at most.

    ``dest`` must be an existing folder that every executor can reach.  A
    failing file never stops the others, and a file that already is its own
    destination counts as copied.  When several sources share a name the last
    readable one remains, as if they were copied one after the other: every
    source is opened in parallel, then only the remaining one of each name is
    copied, so tasks never write one destination twice.  If such a copy fails
    the next-to-last source takes its place; only names without a finished copy
    are tried again.
    """
    if not os.path.isdir(dest):
        raise NotADirectoryError(f"not a folder to export to: {dest}")
    spark = plan.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probe, copy = _file_workers()
    sources = plan.select("root", "ordinal", "source", "dest_path")
    results = stage(
        sources.repartition(tasks, "root", "ordinal").mapInPandas(probe, _PROBED), "probe"
    )
    done, open_names = None, None
    while True:
        tried = results.where("ok")
        if open_names is not None:
            tried = lookup(tried, open_names, ["dest_path"], "left_semi")
        best = tried.groupBy("dest_path").agg(
            F.max(F.struct("root", "ordinal", "source", "same")).alias("_b")
        ).select("_b.*", "dest_path")
        copied = stage(
            best.where("not same").repartition(tasks, "dest_path").mapInPandas(copy, _COPIED),
            "copied",
        )
        finished = copied.where("ok").select("root", "ordinal")
        done = finished if done is None else done.unionByName(finished)
        failed = copied.where("not ok")
        if failed.isEmpty():
            break
        why = failed.select("root", "ordinal", F.col("reason").alias("_why"))
        results = stage(
            merged(results, why, ["root", "ordinal"])
            .withColumn("ok", F.col("ok") & F.col("_why").isNull())
            .withColumn("reason", F.coalesce("_why", "reason"))
            .drop("_why"),
            "probe",
        )
        open_names = failed.select("dest_path")
    times = done.groupBy("root", "ordinal").agg(F.count("*").alias("copies"))
    return merged(results, times, ["root", "ordinal"]).select(
        "root",
        "ordinal",
        "source",
        "ok",
        "reason",
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
