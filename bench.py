"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (default 2; the best run counts).  The inputs are
written as parquet tables first, untimed, as a catalog user holds them.  Every
query then runs over its whole tables into Spark's no-op sink, and all jobs it
starts itself (size checks, written intermediates) are part of its time.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks.fixtures import Fixtures  # noqa: E402
from checks.queries import ON_FIXTURES  # noqa: E402
from photocat.operators import edits  # noqa: E402
from photocat.plans.rescan import sync_roots  # noqa: E402
from photocat.session import build_session, stage  # noqa: E402

HEADLINE = (
    "scan",
    "scan_diff",
    "apply_sync",
    "rescan_summary",
    "set_labels",
    "record_ingest",
    "normalize_exif",
    "tally",
    "ordered_view",
    "sort_taken_at",
    "neighbors",
    "next_error",
    "range_select",
    "current_labels",
    "current_rotation",
    "batch_accounting",
    "progress_monotonic",
    "lru_evict",
    "cache_gc",
    "dangling_assets",
    "export_set",
    "export_plan",
    "write_index",
    "exif_line",
    "asset_hash",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:]
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    fx = Fixtures(spark, sf_dir, written=True)
    listed = fx.listing.count()
    deep = fx.scanned_roots.select("root").withColumn("recursive", F.lit(True))
    empty = fx.photos.limit(0)
    synced = stage(sync_roots(fx.listing, fx.photos, deep), "synced")
    everything = fx.photos.select("id")
    timed = {
        # Folders never seen before: every photo is new.
        "sync_cold": lambda: sync_roots(fx.listing, empty, deep),
        # The same folders again: nothing changed.
        "sync_warm": lambda: sync_roots(fx.listing, synced, deep),
        # One label for the whole library.
        "relabel_all": lambda: edits.set_labels(fx.photos, everything, 3),
        **{name: (lambda name=name: ON_FIXTURES[name](fx)) for name in HEADLINE},
    }

    def run(name):
        started = time.perf_counter()
        timed[name]().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in names or timed:
        run(name)  # writes the inputs it needs and warms the code up
    times = {
        name: round(min(run(name) for _ in range(runs)), 3) for name in names or timed
    }
    result = {
        "metric": "total time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "listing_rows": listed,
        "listing_rows_per_sec": {
            name: round(listed / times[name]) for name in ("sync_cold", "sync_warm") if name in times
        },
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
