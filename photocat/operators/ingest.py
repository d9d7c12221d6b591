"""Running a user's extractor over the pending queue."""

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions import paths as P
from photocat.functions.display import bounded_error
from photocat.functions.exif import normalize_exif
from photocat.schema import EXIF_RAW_SCHEMA, INGEST_RESULT_SCHEMA

NO_PREVIEW = "no stage returned a preview"

_HEADER = EXIF_RAW_SCHEMA.names
_JOB_SCHEMA = (
    "id bigint, root string, rel_path string, mtime_ns bigint, size bigint, failure string, "
    "ingested_at bigint, "
    + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXIF_RAW_SCHEMA)
)


def _runner(read_header, stages, clock):
    header_names = list(_HEADER)
    no_preview = NO_PREVIEW
    text_names = {f.name for f in EXIF_RAW_SCHEMA if f.dataType.simpleString() == "string"}
    kept = ["id", "root", "rel_path", "mtime_ns", "size"]

    def extract(root, rel_path):
        header = dict(read_header(root, rel_path))
        for stage in stages:
            try:
                pixels = stage(root, rel_path)
            except Exception:
                continue
            if pixels is not None:
                header["width"], header["height"] = pixels
                return header
        raise ValueError(no_preview)

    def run(batches):
        for pdf in batches:
            headers, failures, stamps = [], [], []
            for root, rel_path in zip(pdf["root"], pdf["rel_path"]):
                try:
                    headers.append(extract(root, rel_path))
                    failures.append(None)
                except Exception as error:
                    headers.append({})
                    failures.append(str(error) or type(error).__name__)
                stamps.append(int(clock() * 1000))
            out = pdf[kept].reset_index(drop=True)
            out["failure"] = pd.Series(failures, dtype="object")
            out["ingested_at"] = pd.Series(stamps, dtype="int64")
            for name in header_names:
                kind = "object" if name in text_names else "Int64"
                out[name] = pd.Series([h.get(name) for h in headers], dtype=kind)
            yield out

    return run


def ingest_job(
    pending: DataFrame,
    read_header,
    stages: list,
    tasks: int | None = None,
    clock=time.time,
    order: list | None = None,
) -> DataFrame:
    """Extracts every pending photo; one result row each, for ``record_ingest``.

    ``read_header(root, rel_path)`` returns header columns as a dict.  Each of
    ``stages`` returns preview ``(width, height)`` or None; the first value
    wins and a failing stage is skipped.  A file that raises, or that no stage
    can read, becomes an error row and the job goes on.  Headers are
    normalised by built-in expressions afterwards.

    The queue is dealt in ``order``: each task has a run of it, and Spark starts low tasks
    first.  Without ``order`` that is ``priority_pos`` of ``prioritize`` where the queue has it, and
    else the order of ``pending_queue``.
    """
    spark = pending.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if order is None:
        order = ["priority_pos", "root", "rel_path"] if "priority_pos" in pending.columns else ["root", "rel_path"]
    # The id breaks ties, so that equal positions are spread as well.
    queue = pending.repartitionByRange(tasks, *order, "id").sortWithinPartitions(*order, "id")
    files = queue.select("id", "root", "rel_path", "mtime_ns", "size")
    raw = files.mapInPandas(_runner(read_header, stages, clock), _JOB_SCHEMA)
    keep = ["id", "failure", "ingested_at", "_hash"]
    hashed = raw.withColumn("_hash", P.asset_hash("root", "rel_path", "mtime_ns", "size"))
    clean = normalize_exif(hashed, *keep)
    ok = F.col("failure").isNull()
    values = {
        "kind": F.when(ok, "ok").otherwise("error"),
        "preview_path": P.preview_path("_hash"),
        "thumb_path": P.thumb_path("_hash"),
        "err_msg": bounded_error("failure"),
    }
    always = ("id", "kind", "err_msg", "ingested_at")
    out = []
    for field in INGEST_RESULT_SCHEMA:
        col = values.get(field.name, F.col(field.name))
        out.append((col if field.name in always else F.when(ok, col)).alias(field.name))
    return clean.select(*out)
