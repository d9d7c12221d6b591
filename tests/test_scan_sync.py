"""Scanning, diffing and syncing on hand-written rows."""

import pytest
from support import rows

from photocat.operators import scan as S
from photocat.operators import sync as Y
from photocat.schema import PHOTOS_SCHEMA, SCHEMA_VERSION
from photocat.session import CO_PARTITION_ALL_KEYS, scoped_setting

LISTING = "root string, rel_path string, mtime_ns bigint, size bigint"
SCAN = LISTING + ", jpeg_rel_path string"
SCOPE = "root string, recursive boolean"


def listing(spark, *paths, root="/r"):
    return spark.createDataFrame([(root, p, 1, 1) for p in paths], LISTING)


def index(spark, *photos):
    """Photos as dicts over the defaults of a fresh row."""
    base = {"root": "/r", "mtime_ns": 1, "size": 1, "orientation": 1, "rot_cw": 0, "label": 0, "status": 0}
    data = [tuple({**base, **p}.get(n) for n in PHOTOS_SCHEMA.names) for p in photos]
    return spark.createDataFrame(data, PHOTOS_SCHEMA)


def scanned(spark, *files):
    data = [({"root": "/r", "mtime_ns": 1, "size": 1} | f) for f in files]
    return spark.createDataFrame(
        [(f["root"], f["rel_path"], f["mtime_ns"], f["size"], f.get("jpeg_rel_path")) for f in data], SCAN
    )


def scope(spark, recursive=True, root="/r"):
    return spark.createDataFrame([(root, recursive)], SCOPE)


def test_scan_keeps_visible_raw_files_only(spark):
    files = listing(
        spark, "IMG_0001.CR3", "_MG_2.nef", "b.ArW", ".hidden.nef", ".trash/junk.dng", "a/.x/y.nef",
        "noext", "notes.txt", "x.gpr", "y.jpg", "sub/nested.cr3", "a.b/c.nef",
    )
    assert rows(S.scan(files), "rel_path") == [("IMG_0001.CR3",), ("_MG_2.nef",), ("b.ArW",)]
    deep = [r[0] for r in rows(S.scan(files, recursive=True), "rel_path")]
    assert deep == ["IMG_0001.CR3", "_MG_2.nef", "a.b/c.nef", "b.ArW", "sub/nested.cr3"]


def test_scan_orders_by_path_components(spark):
    files = S.scan(listing(spark, "a-b/x.nef", "a/x.nef", "a.nef", "A.nef"), recursive=True)
    got = [r.rel_path for r in S.sorted_scan(files).collect()]
    assert got == ["A.nef", "a/x.nef", "a-b/x.nef", "a.nef"]


def test_pairing(spark):
    files = listing(
        spark, "IMG_1.CR3", "img_1.JPG", "IMG_2.CR3", "IMG_2.jpeg", "IMG_2.JPG", "d/IMG_3.CR3", "IMG_3.jpg",
        "X.NEF", "X.DNG", "x.jpg", "É.NEF", "é.jpg", "only.jpg", "two.dots.nef", "two.dots.jpg",
    )
    assert rows(S.scan(files, recursive=True), "rel_path", "jpeg_rel_path") == [
        ("IMG_1.CR3", "img_1.JPG"), ("IMG_2.CR3", "IMG_2.JPG"), ("X.DNG", "x.jpg"), ("X.NEF", None),
        ("d/IMG_3.CR3", None), ("two.dots.nef", "two.dots.jpg"), ("É.NEF", None),
    ]


def test_pairing_stays_inside_its_root(spark):
    files = listing(spark, "a.nef", root="/r1").unionByName(listing(spark, "a.jpg", root="/r2"))
    assert rows(S.scan(files), "jpeg_rel_path") == [(None,)]


def test_scan_depth_per_root(spark):
    files = listing(spark, "a.nef", "d/b.nef", root="/r1").unionByName(
        listing(spark, "a.nef", "d/b.nef", root="/r2")
    ).unionByName(listing(spark, "z.nef", root="/r3"))
    roots = spark.createDataFrame([("/r1", True), ("/r2", False)], SCOPE)
    assert rows(S.scan(files, roots=roots), "root", "rel_path") == [
        ("/r1", "a.nef"), ("/r1", "d/b.nef"), ("/r2", "a.nef"),
    ]


def test_diff_actions(spark):
    before = index(
        spark,
        {"id": 1, "rel_path": "same.nef"}, {"id": 2, "rel_path": "touched.nef"}, {"id": 3, "rel_path": "grown.nef"},
        {"id": 4, "rel_path": "paired.nef"}, {"id": 5, "rel_path": "unpaired.nef", "jpeg_rel_path": "u.jpg"},
        {"id": 6, "rel_path": "back.nef", "status": 3}, {"id": 7, "rel_path": "gone.nef"},
        {"id": 8, "rel_path": "gone2.nef", "status": 3}, {"id": 9, "rel_path": "d/deep.nef"},
        {"id": 10, "rel_path": "other.nef", "root": "/failed"},
    )
    found = scanned(
        spark, {"rel_path": "same.nef"}, {"rel_path": "touched.nef", "mtime_ns": 2}, {"rel_path": "grown.nef", "size": 2},
        {"rel_path": "paired.nef", "jpeg_rel_path": "p.jpg"}, {"rel_path": "unpaired.nef"}, {"rel_path": "back.nef"},
        {"rel_path": "new.nef"},
    )
    shallow = Y.scan_diff(found, before, scope(spark, recursive=False))
    assert dict(rows(shallow, "rel_path", "action")) == {
        "same.nef": "keep", "touched.nef": "reset", "grown.nef": "reset", "paired.nef": "reattach",
        "unpaired.nef": "reattach", "back.nef": "reset", "gone.nef": "mark_missing", "gone2.nef": "still_missing",
        "d/deep.nef": "out_of_scope", "other.nef": "out_of_scope", "new.nef": "insert",
    }
    deep = Y.scan_diff(found, before, scope(spark))
    assert dict(rows(deep, "rel_path", "action"))["d/deep.nef"] == "mark_missing"
    assert rows(Y.missing_photos(found, before, scope(spark)), "id") == [(7,), (9,)]
    assert rows(Y.missing_photos(found, before, scope(spark, False)), "id") == [(7,)]


def test_sync_reset_keeps_identity_and_clears_the_rest(spark):
    full = {
        "id": 7, "rel_path": "a.nef", "label": 3, "rot_cw": 2, "status": 1, "width": 6, "height": 4, "orientation": 6,
        "camera": "c", "lens": "l", "taken_at": "t", "shutter": "s", "aperture": 2.8, "iso": 100, "focal_mm": 35.0,
        "err_msg": "e", "preview_path": "p", "thumb_path": "q", "ingested_at": 5, "jpeg_rel_path": "a.jpg",
    }
    before = index(spark, full)
    found = scanned(spark, {"rel_path": "a.nef", "mtime_ns": 9, "size": 8})
    got = Y.apply_sync(Y.scan_diff(found, before, scope(spark))).collect()
    want = index(spark, {"id": 7, "rel_path": "a.nef", "label": 3, "rot_cw": 2, "mtime_ns": 9, "size": 8}).collect()
    assert got == want


def test_sync_new_ids_follow_path_order_above_the_highest(spark):
    before = index(spark, {"id": 41, "rel_path": "z.nef"})
    found = scanned(
        spark, {"rel_path": "a-b/1.nef"}, {"rel_path": "a/1.nef"}, {"rel_path": "z.nef"},
        {"rel_path": "0.nef", "root": "/s"},
    )
    roots = scope(spark).unionByName(scope(spark, root="/s"))
    got = rows(Y.apply_sync(Y.scan_diff(found, before, roots)), "id", "rel_path", "status", "orientation")
    assert got == [(41, "z.nef", 0, 1), (42, "a/1.nef", 0, 1), (43, "a-b/1.nef", 0, 1), (44, "0.nef", 0, 1)]


def test_sync_twice_changes_nothing(spark):
    before = index(
        spark, {"id": 1, "rel_path": "a.nef", "status": 1}, {"id": 2, "rel_path": "b.nef", "status": 2},
        {"id": 3, "rel_path": "gone.nef"},
    )
    found = scanned(spark, {"rel_path": "a.nef", "jpeg_rel_path": "a.jpg"}, {"rel_path": "b.nef", "size": 2}, {"rel_path": "c.nef"})
    once = Y.apply_sync(Y.scan_diff(found, before, scope(spark)))
    twice_diff = Y.scan_diff(found, once, scope(spark))
    assert {r[0] for r in rows(twice_diff, "action")} == {"keep", "still_missing"}
    assert rows(Y.apply_sync(twice_diff)) == rows(once)


def test_scanned_empty_root_marks_its_rows_missing(spark):
    before = index(spark, {"id": 1, "rel_path": "a.nef"}, {"id": 2, "rel_path": "a.nef", "root": "/s"})
    after = Y.apply_sync(Y.scan_diff(scanned(spark), before, scope(spark)))
    assert rows(after, "id", "status") == [(1, 3), (2, 0)]


def test_sync_shuffles_each_side_once(spark):
    with scoped_setting(spark, CO_PARTITION_ALL_KEYS, "false"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = S.scan(listing(spark, "a.nef"), roots=scope(spark), keep_keys=True)
        diff = Y.scan_diff(found, index(spark, {"id": 1, "rel_path": "a.nef"}), scope(spark))
        plan = diff._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2
    assert spark.conf.get(CO_PARTITION_ALL_KEYS) == "true"
    assert rows(diff, "rel_path", "action") == [("a.nef", "keep")]


def test_sync_first_load_of_an_empty_index(spark):
    after = Y.apply_sync(Y.scan_diff(scanned(spark, {"rel_path": "a.nef"}), index(spark), scope(spark)))
    assert rows(after, "id", "rel_path", "status", "label") == [(1, "a.nef", 0, 0)]


def results(spark, *items):
    from photocat.schema import INGEST_RESULT_SCHEMA

    return spark.createDataFrame(
        [tuple(i.get(n) for n in INGEST_RESULT_SCHEMA.names) for i in items], INGEST_RESULT_SCHEMA
    )


def test_record_ingest(spark):
    before = index(
        spark, {"id": 1, "rel_path": "a.nef"}, {"id": 2, "rel_path": "b.nef", "camera": "old", "status": 1},
        {"id": 3, "rel_path": "c.nef"}, {"id": 4, "rel_path": "d.nef"},
    )
    ok = {
        "kind": "ok", "width": 6000, "height": 4000, "orientation": 6, "camera": "Canon EOS R6", "lens": "RF 24-70mm",
        "taken_at": "2026-08-24 10:00:00", "shutter": "1/250 s", "aperture": 2.8, "iso": 400, "focal_mm": 35.0,
        "preview_path": "p", "thumb_path": "t",
    }
    after = Y.record_ingest(
        before,
        results(
            spark, {"id": 1, "ingested_at": 10, **ok}, {"id": 2, "kind": "error", "err_msg": "x" * 500, "ingested_at": 11},
            {"id": 3, "kind": "error", "err_msg": "first", "ingested_at": 1}, {"id": 3, "ingested_at": 2, **ok},
            {"id": 99, "kind": "error", "err_msg": "unknown", "ingested_at": 1},
        ),
    )
    got = {r.id: r for r in after.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert {k: got[1][k] for k in ok if k != "kind"} == {k: v for k, v in ok.items() if k != "kind"}
    assert (got[1].status, got[1].ingested_at, got[1].err_msg) == (1, 10, None)
    assert (got[2].status, got[2].camera, got[2].err_msg) == (2, "old", "x" * 400)
    assert (got[3].status, got[3].err_msg, got[3].camera) == (1, "first", "Canon EOS R6")
    assert (got[4].status, got[4].width) == (0, None)


def test_upgrade_index_adds_defaults_and_refuses_the_future(spark):
    old = spark.createDataFrame([(1, "/r", "a.nef", 5, 6, 2)], "id bigint, root string, rel_path string, mtime_ns bigint, size bigint, label int")
    got = Y.upgrade_index(old, 1)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in PHOTOS_SCHEMA]
    row = got.head()
    assert (row.rot_cw, row.jpeg_rel_path, row.orientation, row.label, row.status) == (0, None, 1, 2, 0)
    with pytest.raises(ValueError):
        Y.upgrade_index(old, SCHEMA_VERSION + 1)


def test_joins_by_id_broadcast_no_table_that_only_looks_small(spark, tiny_limits):
    """Tables of a few KB of Parquet, which Spark by itself would broadcast, however many rows they hold."""
    from checks.fixtures import Fixtures
    from checks.queries import clashing, ingest_results
    from photocat.operators import edits, export
    from photocat.session import stage
    from support import SF

    fx = Fixtures(spark, SF, written=True)
    turns = stage(fx.photos.selectExpr("id", "1 AS delta", "2 AS label"), "turns")
    found = {
        "set_labels": edits.set_labels(fx.photos, turns, 3),
        "set_rotations": edits.set_rotations(fx.photos, turns, delta="delta"),
        "apply_labels": edits.apply_labels(fx.photos, turns),
        "current_rotation": edits.current_rotation(turns, fx.photos),
        "record_ingest": Y.record_ingest(fx.photos, stage(ingest_results(fx), "results")),
        "export_plan": export.export_plan(stage(clashing(fx), "files"), fx.dest_files, "/out"),
    }
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in found.items()}
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
