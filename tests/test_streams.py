"""Streams must end where their batch twins end, whatever the micro-batches are."""

import datetime as dt
import random
import time

import pytest
from support import rows
from test_scan_sync import index

from photocat import streaming
from photocat.operators import edits, stats
from photocat.schema import INGEST_EVENT_SCHEMA, LABEL_EVENT_SCHEMA
from photocat.sources.events import ingest_event_source, label_event_source
from photocat.sources.index_store import publications, read_index

START = dt.datetime(2024, 1, 1)


def at(n):
    return START + dt.timedelta(seconds=n)


def write_parts(spark, data, schema, folder, parts=4):
    """One file per part, in order, so that micro-batches arrive in order."""
    size = -(-len(data) // parts)
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)


def drain(writer):
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def updates(spark, stream, folder):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    drain(stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp"))
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(2)
    return [(e, at(rng.randrange(60)), rng.choice([1, 1, 1, 2, 3, 4, 50]), rng.randrange(6)) for e in range(120)]


def test_current_labels(spark, tmp_path, labels):
    logs = str(tmp_path / "logs")
    write_parts(spark, labels, LABEL_EVENT_SCHEMA, logs)
    stream = label_event_source(spark, logs, maxFilesPerTrigger=1)
    seen = updates(spark, streaming.stream_current_labels(stream), tmp_path)
    assert seen.select("batch").distinct().count() == 4
    want = edits.current_labels(label_event_source(spark, logs, stream=False))
    assert rows(edits.latest_by_key(seen, ["id"], ["label"], ["batch"])) == rows(want)


def test_tally_follows_relabels_and_survives_a_repeated_batch(spark, tmp_path, labels):
    logs = str(tmp_path / "logs")
    write_parts(spark, labels, LABEL_EVENT_SCHEMA, logs)
    photos = index(
        spark, {"id": 1, "rel_path": "a", "label": 2}, {"id": 2, "rel_path": "b", "status": 2}, {"id": 3, "rel_path": "c"},
        {"id": 4, "rel_path": "d", "status": 3}, {"id": 5, "rel_path": "e", "root": "/s", "label": 5},
    )
    stream = streaming.stream_tally(label_event_source(spark, logs, maxFilesPerTrigger=1), photos, buckets=3)
    seen = updates(spark, stream, tmp_path)
    batch = label_event_source(spark, logs, stream=False)
    want = rows(stats.tally(edits.apply_labels(photos, edits.current_labels(batch))))
    assert rows(streaming.tally_now(photos, seen)) == want
    # The last micro-batch again, as after a lost acknowledgement: state and counts are the same.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    commits[-1].unlink()
    stream = streaming.stream_tally(label_event_source(spark, logs, maxFilesPerTrigger=1), photos, buckets=3)
    assert rows(streaming.tally_now(photos, updates(spark, stream, tmp_path))) == want


def ingest_log(seed=4):
    """Events and starts of two jobs in order; some events belong to an older generation."""
    rng = random.Random(seed)
    starts = [(j, g, g * 20 + k) for k, j in enumerate("ab") for g in range(1, 8)]
    events = []
    for e in range(20, 180):
        job = rng.choice("aaab")
        active = max([g for j, g, s in starts if j == job and s <= e], default=0)
        generation = max(0, active - (rng.random() < 0.2))
        events.append((e, at(e), job, generation, rng.randrange(9), rng.choice(["Ingested", "Failed"]), None))
    counts = {}
    for e in events:
        counts[e[2:4]] = counts.get(e[2:4], 0) + 1
    log = events + [
        (s, None, j, g, None, "Started", counts.get((j, g), 0) + (g % 3 == 0)) for j, g, s in starts
    ]
    return sorted(log, key=lambda r: (r[0], r[5] != "Started"))


@pytest.mark.parametrize("parts, shuffled", [(1, False), (4, False), (4, True)])
def test_ingest_state_drops_superseded_results(spark, tmp_path, parts, shuffled):
    """In any order: results before their start, and starts after those of later generations."""
    logs = str(tmp_path / "logs")
    log = ingest_log()
    active, want = {}, {}
    for event, _, job, generation, photo, kind, _ in log:
        if kind == "Started":
            active[job] = generation
        elif active.get(job) == generation:
            want[job, photo] = (kind, event)
    if shuffled:
        random.Random(7).shuffle(log)
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, parts)
    stream = streaming.stream_ingest_state(ingest_event_source(spark, logs, maxFilesPerTrigger=1), buckets=3)
    seen = updates(spark, stream, tmp_path)
    assert rows(streaming.latest_states(seen)) == sorted((*k, *v) for k, v in want.items())


def test_late_start_takes_back_an_outcome(spark, tmp_path):
    logs = str(tmp_path / "logs")
    log = [
        (5, at(5), "j", 1, 9, "Ingested", None), (1, None, "j", 1, None, "Started", 1), (4, None, "j", 2, None, "Started", 1),
        (None, None, None, None, None, "Ingested", None),
    ]
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 4)
    seen = updates(spark, streaming.stream_ingest_state(ingest_event_source(spark, logs, maxFilesPerTrigger=1)), tmp_path)
    assert [tuple(r) for r in seen.orderBy("batch").collect()] == [("j", 9, "Ingested", 5, 1), ("j", 9, None, None, 2)]
    assert rows(streaming.latest_states(seen)) == []


def test_late_start_gives_back_the_outcome_before(spark, tmp_path):
    """A result that is stale as a late start shows must not have ended the one before it."""
    logs = str(tmp_path / "logs")
    log = [
        (1, None, "j", 1, None, "Started", 1), (5, at(5), "j", 1, 9, "Failed", None), (6, None, "j", 2, None, "Started", 1),
        (20, at(20), "j", 2, 9, "Ingested", None), (15, None, "j", 3, None, "Started", 1),
    ]
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 5)
    seen = updates(spark, streaming.stream_ingest_state(ingest_event_source(spark, logs, maxFilesPerTrigger=1)), tmp_path)
    assert rows(streaming.latest_states(seen)) == [("j", 9, "Failed", 5)]


def test_ingest_state_of_many_generations(spark, tmp_path):
    """The next start is looked up, not searched among all starts of the job for every result."""
    logs, n = str(tmp_path / "logs"), 60_000
    numbers = spark.range(n).selectExpr("id * 10 AS event_id", "id AS generation", "id % 50 AS photo")
    columns = "event_id {}, CAST(NULL AS timestamp) AS ts, 'j' AS job, generation, {} AS id, '{}' AS kind, 1L AS enqueued"
    starts = numbers.selectExpr(*columns.format("", "CAST(NULL AS bigint)", "Started").split(", "))
    results = numbers.selectExpr(*columns.format("+ 5 AS event_id", "photo", "Ingested").split(", "))
    starts.unionByName(results).coalesce(1).write.parquet(logs)
    stream = streaming.stream_ingest_state(ingest_event_source(spark, logs), buckets=1)
    began = time.time()
    seen = updates(spark, stream, tmp_path)
    assert time.time() - began < 100
    want = [("j", photo, "Ingested", (n - 50 + photo) * 10 + 5) for photo in range(50)]
    assert rows(streaming.latest_states(seen)) == want


def test_long_numbers_stay_whole_and_rows_without_event_are_ignored(spark, tmp_path):
    logs, far = str(tmp_path / "logs"), 1 << 60
    log = [
        (far + 1, None, "j", 1, None, "Started", 1), (far + 5, at(5), "j", 1, far + 9, "Ingested", None),
        (None, None, "j", 1, None, "Started", 1), (None, at(6), "j", 1, far + 9, "Failed", None),
        (far + 4, None, "j", 2, None, "Started", 1), (far + 7, at(7), "j", 2, far + 11, "Failed", None),
    ]
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 2)
    stream = streaming.stream_ingest_state(ingest_event_source(spark, logs, maxFilesPerTrigger=1), buckets=1)
    assert rows(updates(spark, stream, tmp_path)) == [
        ("j", far + 9, None, None, 1), ("j", far + 9, "Ingested", far + 5, 0), ("j", far + 11, "Failed", far + 7, 1)
    ]


def test_each_batch_finishes_once(spark, tmp_path):
    logs = str(tmp_path / "logs")
    log = ingest_log()
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 5)
    stream = streaming.stream_batch_finished(ingest_event_source(spark, logs, maxFilesPerTrigger=1))
    seen = updates(spark, stream, tmp_path)
    enqueued = {r[2:4]: r[6] for r in log if r[5] == "Started"}
    counts = {}
    for r in log:
        if r[5] != "Started":
            counts[r[2:4]] = counts.get(r[2:4], 0) + 1
    want = sorted(k for k, n in enqueued.items() if n and counts.get(k, 0) == n)
    assert rows(seen.where("done > 0"), "job", "generation") == want


def test_redelivered_start_finishes_once(spark, tmp_path):
    """Results before their start, and the same start in three micro-batches."""
    logs = str(tmp_path / "logs")
    start = (0, at(0), "j", 1, None, "Started", 2)
    log = [(1, at(1), "j", 1, 5, "Ingested", None), start, (2, at(2), "j", 1, 6, "Failed", None), start, start]
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 5)
    stream = streaming.stream_batch_finished(ingest_event_source(spark, logs, maxFilesPerTrigger=1))
    seen = updates(spark, stream, tmp_path)
    assert rows(seen, "job", "generation", "done", "enqueued") == [("j", 1, 2, 2)]


def test_timers_remove_finished_and_idle_batches(spark, tmp_path):
    logs = str(tmp_path / "logs")
    log = [(i, at(i), "j", i, i, "Ingested", None) for i in range(4)] + [(9, None, "j", i, None, "Started", 1) for i in range(2)]
    write_parts(spark, log, INGEST_EVENT_SCHEMA, logs, 1)
    stream = streaming.stream_batch_finished(ingest_event_source(spark, logs), keep_seconds=0, idle_seconds=0)
    running = (
        stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.count())
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        running.processAllAvailable()
        kept = 4
        for turn in range(1, 4):  # the watermark moves on with what arrives
            time.sleep(1.5)
            write_parts(spark, [(20 + turn, at(turn), "k", turn, 1, "Ingested", None)], INGEST_EVENT_SCHEMA, logs, 1)
            running.processAllAvailable()
            kept = running.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        running.stop()
    assert kept < 4


def test_progress_and_rate(spark, tmp_path):
    logs = str(tmp_path / "logs")
    ticks = [("j", 5), ("j", 3), ("k", 1), ("j", 9), ("j", 8), ("k", 4)]
    write_parts(spark, ticks, "job string, done bigint", logs, 3)
    stream = spark.readStream.schema("job string, done bigint").option("maxFilesPerTrigger", 1).parquet(logs)
    seen = updates(spark, streaming.stream_progress(stream), tmp_path)
    assert rows(edits.latest_by_key(seen, ["job"], ["done"], ["batch"])) == [("j", 9), ("k", 4)]

    logs = str(tmp_path / "events")
    data = [(i, at(i * 20), "j", 1, i, "Ingested", None) for i in range(9)]
    write_parts(spark, data, INGEST_EVENT_SCHEMA, logs, 3)
    rate = streaming.stream_ingest_rate(ingest_event_source(spark, logs, maxFilesPerTrigger=1))
    seen = updates(spark, rate, tmp_path / "rate")
    got = edits.latest_by_key(seen, ["job", "window_start"], ["done", "rate"], ["batch"])
    assert rows(got) == [("j", at(0), 3, 0.05), ("j", at(60), 3, 0.05), ("j", at(120), 3, 0.05)]


def test_sync_of_arriving_snapshots(spark, tmp_path):
    arrivals, store = str(tmp_path / "arrivals"), str(tmp_path / "store")
    schema = "root string, rel_path string, mtime_ns bigint, size bigint"
    snapshots = [
        [("/r", "a.nef", 1, 1), ("/r", "b.nef", 1, 1), ("/s", "x.nef", 1, 1)],
        [("/r", "a.nef", 2, 1), ("/r", "a.jpg", 1, 1), ("/r", "c.nef", 1, 1)],
        [("/s", None, None, None)],
    ]
    for snapshot in snapshots:
        spark.createDataFrame(snapshot, schema).coalesce(1).write.mode("append").parquet(arrivals)
        listings = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        drain(streaming.stream_sync(listings, store, str(tmp_path / "cp")))
    got = rows(read_index(spark, store), "id", "root", "rel_path", "mtime_ns", "status", "jpeg_rel_path")
    assert got == [
        (1, "/r", "a.nef", 2, 0, "a.jpg"), (2, "/r", "b.nef", 1, 3, None), (3, "/s", "x.nef", 1, 3, None),
        (4, "/r", "c.nef", 1, 0, None),
    ]
    assert sorted(v.batch_id for v in publications(spark, store).collect()) == [0, 1, 2]


def test_half_a_listing_is_refused(spark, tmp_path):
    arrivals, store = str(tmp_path / "arrivals"), str(tmp_path / "store")
    schema = "root string, rel_path string, mtime_ns bigint, size bigint, n_files bigint"
    whole = [("/r", "a.nef", 1, 1, 2), ("/r", "b.nef", 1, 1, 2), ("/s", None, None, None, 0)]
    for snapshot, message in ((whole, None), (whole[:1], "/r has 1 of 2 files")):
        spark.createDataFrame(snapshot, schema).coalesce(1).write.mode("append").parquet(arrivals)
        listings = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        writer = streaming.stream_sync(listings, store, str(tmp_path / "cp"))
        if message is None:
            drain(writer)
        else:
            with pytest.raises(Exception, match=message):
                drain(writer)
    assert rows(read_index(spark, store), "rel_path", "status") == [("a.nef", 0), ("b.nef", 0)]


def test_results_and_relabels_are_published_as_they_arrive(spark, tmp_path):
    from photocat.operators.sync import record_ingest
    from photocat.sources.index_store import write_index
    from test_scan_sync import results

    store, logs, cards = str(tmp_path / "store"), str(tmp_path / "logs"), str(tmp_path / "cards")
    photos = index(
        spark, {"id": 1, "rel_path": "a.nef"}, {"id": 2, "rel_path": "b.nef", "label": 4},
        {"id": 3, "rel_path": "c.nef", "root": "/s"},
    )
    write_index(photos, store)
    found = results(
        spark, {"id": 1, "kind": "error", "err_msg": "first", "ingested_at": 1},
        {"id": 1, "kind": "ok", "width": 6, "height": 4, "orientation": 6, "camera": "c", "ingested_at": 2},
        {"id": 2, "kind": "error", "err_msg": "bad", "ingested_at": 3},
        {"id": 99, "kind": "error", "err_msg": "unknown", "ingested_at": 1}, {"kind": "ok", "ingested_at": 5},
    )
    found.coalesce(1).write.parquet(logs)
    for _ in range(2):  # the second run finds nothing new
        arriving = spark.readStream.schema(found.schema).parquet(logs)
        drain(streaming.stream_publish_ingest(arriving, store, str(tmp_path / "cp")))
    assert rows(read_index(spark, store)) == rows(record_ingest(photos, found.where("id IS NOT NULL")))
    # The same micro-batch under a fresh checkpoint, as after a lost acknowledgement.
    before = publications(spark, store).count()
    again = spark.readStream.schema(found.schema).parquet(logs)
    drain(streaming.stream_publish_ingest(again, store, str(tmp_path / "cp2"), stream=str(tmp_path / "cp")))
    assert publications(spark, store).count() == before == 2
    events = [(1, at(1), 1, 2), (2, at(3), 1, 5), (3, at(2), 1, 3), (4, at(4), 3, 1), (5, at(5), 99, 1), (6, at(6), None, 1)]
    spark.createDataFrame(events, LABEL_EVENT_SCHEMA).coalesce(1).write.parquet(cards)
    drain(streaming.stream_publish_labels(label_event_source(spark, cards), store, str(tmp_path / "cp3")))
    assert rows(read_index(spark, store), "id", "label") == [(1, 5), (2, 4), (3, 1)]
