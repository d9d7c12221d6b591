"""Filters, projections, selections and export on hand-written rows."""

import os

import pytest
from support import rows
from pyspark.sql import functions as F
from test_scan_sync import index

from photocat.operators import assets, edits, export, selection, stats, views
from photocat.plans import cull

NAMES = "id bigint, root string, rel_path string, label int, status int, jpeg_rel_path string, pos bigint"


def sheet(spark, *labels, pairs=(), root="/r"):
    """An ordered view: ids from 1, file names in id order."""
    data = [
        (i, root, f"IMG_{i:04d}.CR3", label, 1, f"IMG_{i:04d}.JPG" if i in pairs else None, i - 1)
        for i, label in enumerate(labels, 1)
    ]
    return spark.createDataFrame(data, NAMES)


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id bigint")


def test_label_masks(spark):
    view = sheet(spark, 0, 1, 2, 3, 4, 5)
    for mask, want in {0: range(1, 7), 0b111110: range(2, 7), 1: [1], 0b010100: [3, 5]}.items():
        assert [r[0] for r in rows(views.label_filter(view, mask), "id")] == list(want)
    plan = views.label_filter(view, 0b010100)._jdf.queryExecution().optimizedPlan().toString()
    assert "IN" in plan or "INSET" in plan


def test_sorts(spark):
    photos = index(
        spark, {"id": 1, "rel_path": "b.nef", "taken_at": "2024-01-02"}, {"id": 2, "rel_path": "A.nef"},
        {"id": 3, "rel_path": "z/a.nef", "taken_at": "2024-01-01"}, {"id": 4, "rel_path": "a/b.NEF", "taken_at": "2024-01-02"},
        {"id": 5, "rel_path": "É.nef"}, {"id": 6, "rel_path": "gone.nef", "status": 3},
    )
    by = {s: [r[1] for r in rows(cull.culled_view(photos, sort=s), "pos", "id")] for s in ("filename", "taken_at", "path")}
    assert by == {"filename": [2, 3, 4, 1, 5], "taken_at": [3, 4, 1, 2, 5], "path": [2, 4, 1, 3, 5]}


def test_pending_queue_is_in_byte_order(spark):
    photos = index(spark, {"id": 1, "rel_path": "a/x.nef"}, {"id": 2, "rel_path": "a-b.nef"}, {"id": 3, "rel_path": "0.nef", "status": 1})
    assert [r.rel_path for r in views.pending_queue(photos).collect()] == ["a-b.nef", "a/x.nef"]
    assert [r.rel_path for r in views.live_entries(photos).collect()] == ["0.nef", "a/x.nef", "a-b.nef"]
    assert [r.id for r in views.live_entries(photos).collect()] == [3, 1, 2]


def test_prioritize_is_stable_and_ignores_unknown_ids(spark):
    queue = spark.createDataFrame([("/r", i, i) for i in range(6)], "root string, id bigint, queue_pos bigint")
    got = views.prioritize(queue, ids(spark, 4, 2, 99), ["root"])
    assert [r[1] for r in rows(got, "priority_pos", "id")] == [2, 4, 0, 1, 3, 5]


def test_photo_by_id_finds_missing_rows(spark):
    photos = index(spark, {"id": 1, "rel_path": "a.nef", "status": 3})
    assert rows(views.photo_by_id(photos, 1), "id", "status") == [(1, 3)]
    assert views.photo_by_id(photos, 2).isEmpty()


def test_for_root(spark):
    events = spark.createDataFrame([("/a", 1), ("/b", 2)], "root string, n int")
    assert rows(views.for_root(events, ["/a"]), "n") == [(1,)]
    assert rows(views.for_root(events, spark.createDataFrame([("/b",)], "root string")), "n") == [(2,)]


def test_set_labels_counts_real_changes(spark):
    photos = index(spark, {"id": 1, "rel_path": "a", "label": 3}, {"id": 2, "rel_path": "b"}, {"id": 3, "rel_path": "c"})
    got = edits.set_labels(photos, ids(spark, 1, 2, 2, 77), 3)
    assert rows(got, "id", "label", "changed") == [(1, 3, False), (2, 3, True), (3, 0, False)]


def test_set_rotations(spark):
    photos = index(spark, {"id": 1, "rel_path": "a", "rot_cw": 3}, {"id": 2, "rel_path": "b", "rot_cw": 1}, {"id": 3, "rel_path": "c"})
    steps = spark.createDataFrame([(1, 1), (2, 6), (9, 1)], "id bigint, n int")
    assert rows(edits.set_rotations(photos, steps, delta="n"), "id", "rot_cw") == [(1, 0), (2, 3), (3, 0)]
    assert rows(edits.set_rotations(photos, steps, turns="n"), "id", "rot_cw") == [(1, 1), (2, 2), (3, 0)]
    with pytest.raises(ValueError):
        edits.set_rotations(photos, steps)


def test_folds(spark):
    log = spark.createDataFrame([("a", "1", 1), ("b", "x", 1), ("a", "2", 3), ("a", "old", 2)], "k string, v string, at bigint")
    assert rows(edits.latest_by_key(log, ["k"], ["v"], ["at"])) == [("a", "2"), ("b", "x")]
    turns = spark.createDataFrame([(1, 1), (1, 1), (2, -1)], "id bigint, delta int")
    assert rows(edits.current_rotation(turns)) == [(1, 2), (2, 3)]
    opens = spark.createDataFrame([("/a", 5), ("/b", 9), ("/a", 7), ("/c", 9)], "path string, opened_at bigint")
    assert [r.path for r in edits.recent_roots(opens, 2).collect()] == ["/b", "/c"]


def test_selection_sets(spark):
    assert rows(selection.toggle_selection(ids(spark, 1, 2), ids(spark, 2, 3))) == [(1,), (3,)]
    assert rows(selection.union_selection(ids(spark, 1, 2), ids(spark, 2, 3))) == [(1,), (2,), (3,)]
    assert rows(selection.select_all(views.label_filter(sheet(spark, 0, 1, 2), 0b111110))) == [(2,), (3,)]


def test_export_scope(spark):
    everything = sheet(spark, 0, 1, 2, 0).unionByName(
        sheet(spark, 1, 1, root="/s").withColumn("id", F.col("id") + 10)
    )
    view = views.label_filter(everything, 0b111110)
    scope = lambda *chosen: [r[0] for r in rows(export.export_scope(view, everything, ids(spark, *chosen)), "id")]
    assert scope() == [2, 3, 11, 12]
    assert scope(2) == [2, 11, 12]
    # A selection hidden by the filter still is a selection: nothing of that root goes out.
    assert scope(1) == [11, 12]
    assert scope(1, 3, 12) == [3, 12]


def test_export_set_modes(spark):
    view = sheet(spark, 0, 0, 0, pairs=(1, 3))
    names = {m: [r[1] for r in rows(export.export_set(view, m), "ordinal", "name")] for m in export.MODES}
    raws = ["IMG_0001.CR3", "IMG_0002.CR3", "IMG_0003.CR3"]
    jpegs = ["IMG_0001.JPG", "IMG_0003.JPG"]
    assert names == {"all": [raws[0], jpegs[0], raws[1], raws[2], jpegs[1]], "raw": raws, "jpeg": jpegs}
    assert rows(export.export_set(view, "raw"), "source")[0] == ("/r/IMG_0001.CR3",)
    assert [export.parse_mode(t) for t in ("raw", "jpeg", "all", "nope", None)] == ["raw", "jpeg", "all", "all", "all"]
    assert rows(stats.export_count(view, "jpeg"), "n") == [(2,)]
    assert rows(stats.export_count(view, "raw"), "n") == [(3,)]


FILES = "root string, ordinal bigint, id bigint, source string, name string"


def test_existing_names_and_winner(spark):
    data = [("/r", 0, 1, "/r/a/x.nef", "x.nef"), ("/r", 1, 2, "/r/y.nef", "y.nef"), ("/r", 2, 3, "/r/b/x.nef", "x.nef"), ("/r", 3, 4, "/r/z.nef", "z.nef")]
    files = spark.createDataFrame(data, FILES)
    there = spark.createDataFrame([("z.nef",), ("x.nef",)], "name string")
    assert rows(export.existing_names(files, there), "ordinal", "name") == [(0, "x.nef"), (3, "z.nef")]
    assert rows(export.export_winner(files), "name", "id") == [("x.nef", 3), ("y.nef", 2), ("z.nef", 4)]
    plan = export.export_plan(files, there, "/r/")
    assert rows(plan, "ordinal", "action", "winner") == [
        (0, "overwrite", False), (1, "copy", True), (2, "overwrite", True), (3, "skip_same", True),
    ]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_export_files_copies_like_one_after_the_other(spark, tmp_path):
    dest = tmp_path / "out"
    put(dest / "b.nef", "old")
    sources = [
        put(tmp_path / "a.nef", "first"), put(tmp_path / "b.nef", "new"), str(tmp_path / "lost.nef"),
        put(tmp_path / "sub" / "a.nef", "second"), put(dest / "own.nef", "own"), str(tmp_path / "gone" / "a.nef"),
    ]
    plan = spark.createDataFrame(
        [("/r", i, s, str(dest / os.path.basename(s))) for i, s in enumerate(sources)],
        "root string, ordinal bigint, source string, dest_path string",
    )
    results = export.export_files(plan, str(dest))
    missing = "No such file or directory (os error 2)"
    assert rows(results, "ordinal", "ok", "reason") == [
        (0, True, None), (1, True, None), (2, False, missing), (3, True, None), (4, True, None), (5, False, missing),
    ]
    assert {p.name: p.read_text() for p in dest.iterdir()} == {"a.nef": "second", "b.nef": "new", "own.nef": "own"}
    assert rows(export.export_report(results, planned=7)) == [(4, 2, 6, True)]
    assert rows(export.export_report(results, planned=6)) == [(4, 2, 6, False)]
    assert [r.ordinal for r in export.export_failures(results).collect()] == [2, 5]


def test_export_falls_back_when_the_last_copy_fails(spark, tmp_path):
    dest = tmp_path / "out"
    dest.mkdir()
    good = put(tmp_path / "a.nef", "first")
    folder = tmp_path / "sub" / "a.nef"
    folder.mkdir(parents=True)
    plan = spark.createDataFrame(
        [("/r", 0, good, str(dest / "a.nef")), ("/r", 1, str(folder), str(dest / "a.nef"))],
        "root string, ordinal bigint, source string, dest_path string",
    )
    got = rows(export.export_files(plan, str(dest)), "ordinal", "ok")
    assert got == [(0, True), (1, False)]
    assert (dest / "a.nef").read_text() == "first"


def test_export_needs_a_folder(spark, tmp_path):
    plan = spark.createDataFrame([], "root string, ordinal bigint, source string, dest_path string")
    with pytest.raises(NotADirectoryError):
        export.export_files(plan, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        export.export_files(plan, put(tmp_path / "file", "x"))


def test_counts(spark):
    photos = index(
        spark, {"id": 1, "rel_path": "a", "label": 1}, {"id": 2, "rel_path": "b", "label": 1, "status": 2},
        {"id": 3, "rel_path": "c", "status": 3, "label": 5}, {"id": 4, "rel_path": "d"},
    )
    assert rows(stats.tally(photos)) == [("/r", 1, 2, 0, 0, 0, 0, 1)]
    assert rows(stats.status_counts(photos)) == [("/r", 0, 2), ("/r", 2, 1), ("/r", 3, 1)]
    assert rows(stats.sheet_stats(photos, 0b111110, ids(spark, 1, 4, 99))) == [("/r", 3, 2, 2)]


def test_media_mix(spark):
    def mix(*names):
        return rows(stats.media_mix(spark.createDataFrame([("/r", n) for n in names], "root string, rel_path string")))

    assert mix("a.CR3", "b.nef") == [("/r", 2, 1, 0.5, True)]
    assert mix("a.CR3", "b.nef", "c.nef") == [("/r", 3, 1, 1 / 3, False)]


def test_ingest_rate_is_floored_at_half_a_second(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    data = [("j", 1, at), ("j", 1, at), ("j", 1, at), ("k", 1, at), ("k", 1, at + dt.timedelta(seconds=3))]
    events = spark.createDataFrame(data, "job string, generation bigint, ts timestamp_ntz")
    assert rows(stats.ingest_rate(events)) == [("j", 1, 3, 6), ("k", 1, 2, 0)]


def test_assets(spark):
    cached = spark.createDataFrame(
        [(1, "preview", "h1", "previews/h1.jpg"), (1, "thumb", "h1", "thumbs/h1.jpg"), (2, "thumb", "h2", "thumbs/h2.jpg")],
        "id bigint, kind string, hash string, path string",
    )
    assert rows(assets.cache_gc(cached, spark.createDataFrame([("h1",)], "hash string")), "path") == [("thumbs/h2.jpg",)]
    assert rows(assets.retain_assets(cached, ids(spark, 1)), "kind") == [("preview",), ("thumb",)]
    photos = index(
        spark, {"id": 1, "rel_path": "a", "status": 1, "preview_path": "previews/h1.jpg", "thumb_path": "thumbs/h9.jpg"},
        {"id": 2, "rel_path": "b", "status": 0, "preview_path": "previews/h8.jpg"},
    )
    assert rows(assets.dangling_assets(photos, cached)) == [(1, "thumbs/h9.jpg")]
