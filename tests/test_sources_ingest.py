"""File system sources, the index store and the extraction job."""

import os

import pytest
from support import rows
from pyspark.sql import functions as F
from test_scan_sync import index

from photocat.operators.ingest import NO_PREVIEW, ingest_job
from photocat.operators.scan import scan
from photocat.operators.views import pending_queue, prioritize, queue_positions
from photocat.plans import publish
from photocat.plans.rescan import ingest_pending, sync_store
from photocat.sources import index_store
from photocat.sources.listing_format import load_listing
from photocat.sources.listing import asset_listing, delete_assets, photo_listing


def touch(base, *names, text="x"):
    for name in names:
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.mark.parametrize("tasks", [1, 3, None])
def test_listing_walks_visible_files(spark, tmp_path, tasks):
    touch(tmp_path, "IMG_1.CR3", "_MG_2.CR2", ".hidden.nef", ".trash/junk.dng", "sub/a.nef", "sub/deep/er/b.nef", "sub/.x/c.nef")
    touch(tmp_path, "empty.nef", text="")
    os.symlink(tmp_path / "IMG_1.CR3", tmp_path / "link.nef")
    os.utime(tmp_path / "IMG_1.CR3", ns=(1, 1700000000123456789))
    os.utime(tmp_path / "_MG_2.CR2", ns=(1, -1500))
    root = str(tmp_path)
    flat = photo_listing(spark, [root], tasks=tasks)
    assert [r[1] for r in rows(flat)] == ["IMG_1.CR3", "_MG_2.CR2", "empty.nef"]
    deep = photo_listing(spark, [root], recursive=True, tasks=tasks)
    found = {r[1]: r[2:] for r in rows(deep)}
    assert sorted(found) == ["IMG_1.CR3", "_MG_2.CR2", "empty.nef", "sub/a.nef", "sub/deep/er/b.nef"]
    assert found["IMG_1.CR3"] == (1700000000123456789, 1)
    assert found["_MG_2.CR2"][0] == -1500
    assert found["empty.nef"][1] == 0


def test_listing_of_many_roots_feeds_a_scan(spark, tmp_path):
    touch(tmp_path, "a/x.NEF", "a/x.jpg", "b/y.nef", "b/.dot/z.nef")
    listing = photo_listing(spark, [str(tmp_path / "a"), str(tmp_path / "b")], recursive=True)
    got = rows(scan(listing, recursive=True), "root", "rel_path", "jpeg_rel_path")
    assert got == [(str(tmp_path / "a"), "x.NEF", "x.jpg"), (str(tmp_path / "b"), "y.nef", None)]


def test_listing_accepts_a_hidden_root_and_refuses_a_bad_one(spark, tmp_path):
    touch(tmp_path, ".card/a.nef")
    assert photo_listing(spark, [str(tmp_path / ".card")]).count() == 1
    for bad in ("none", ".card/a.nef"):
        with pytest.raises(Exception, match="cannot list"):
            photo_listing(spark, [str(tmp_path / bad)]).collect()


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_listing_format_gives_the_rows_of_the_listing(spark, tmp_path, tasks):
    touch(tmp_path, *[f"a/{d}/IMG_{i}.{e}" for d in ("x", "y/z") for i in range(9) for e in ("nef", "jpg")])
    touch(tmp_path, "a/.trash/junk.nef", "a/.h.nef", "a/_M.nef", "b/y.nef", "b/x.NEF")
    os.symlink(tmp_path / "a/_M.nef", tmp_path / "a/link.nef")
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    for recursive in (False, True):
        found = load_listing(spark, roots, recursive, tasks)
        assert found.columns == ["root", "rel_path", "mtime_ns", "size"]
        assert rows(found) == rows(photo_listing(spark, roots, recursive))
    deep = load_listing(spark, roots, True, tasks)
    assert deep.select(F.spark_partition_id().alias("p")).distinct().count() >= min(tasks, 10)
    raws = deep.where((F.col("root") == roots[0]) & F.col("rel_path").endswith(".nef"))
    assert len(rows(raws)) == 19
    assert rows(deep.where(F.col("root").isin("/none", roots[1])), "rel_path") == [("x.NEF",), ("y.nef",)]
    assert rows(deep.where("root = '/none'")) == []


def test_listing_format_pushes_filters(spark, tmp_path):
    touch(tmp_path, "a/x.nef", "b/y.nef")
    found = load_listing(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).where(
        (F.col("root") == str(tmp_path / "a")) & F.col("rel_path").endswith(".nef") & (F.col("size") > 0)
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert all("size" in f and "EndsWith" not in f and "root" not in f for f in filters)
    assert rows(found, "rel_path") == [("x.nef",)]
    with pytest.raises(Exception, match="cannot list"):
        load_listing(spark, [str(tmp_path / "none")]).collect()


def test_asset_listing_and_collection(spark, tmp_path):
    assert asset_listing(spark, str(tmp_path)).count() == 0
    touch(tmp_path, "previews/keep1.jpg", "previews/stale1.JPG", "previews/notes.txt", "previews/x.jpeg", "thumbs/keep1.jpg", "thumbs/stale2.jpg")
    found = asset_listing(spark, str(tmp_path))
    assert rows(found, "kind", "hash", "path") == [
        ("preview", "keep1", "previews/keep1.jpg"), ("preview", "stale1", "previews/stale1.JPG"),
        ("thumb", "keep1", "thumbs/keep1.jpg"), ("thumb", "stale2", "thumbs/stale2.jpg"),
    ]
    from photocat.operators.assets import cache_gc

    doomed = cache_gc(found, spark.createDataFrame([("keep1",)], "hash string"))
    assert rows(delete_assets(doomed, str(tmp_path)), "removed") == [(True,), (True,)]
    assert sorted(p.name for p in tmp_path.glob("*/*")) == ["keep1.jpg", "keep1.jpg", "notes.txt", "x.jpeg"]


def test_listing_is_spread_over_tasks(spark, tmp_path):
    """One deep folder chain and one flat folder still give many partitions of stat calls."""
    deep = tmp_path / "card" / "DCIM" / "100"
    deep.mkdir(parents=True)
    for i in range(200):
        (deep / f"IMG_{i:04}.NEF").write_bytes(b"x")
    for listing in (
        photo_listing(spark, [str(tmp_path / "card")], recursive=True, tasks=6),
        photo_listing(spark, [str(deep)], tasks=6),
    ):
        used = listing.select(F.spark_partition_id().alias("p")).distinct().count()
        assert listing.count() == 200 and used >= 5


def test_index_store_publications(spark, tmp_path):
    store = str(tmp_path / "store")
    assert index_store.read_index(spark, store).count() == 0 and index_store.highest_id(spark, store) == 0
    first = index(spark, {"id": 5, "rel_path": "a.nef", "root": "/a b/c=1"}, {"id": 2, "rel_path": "b.nef", "root": "/r"})
    second = index(spark, {"id": 1, "rel_path": "a.nef", "root": "/a b/c=1", "label": 4})
    assert index_store.write_index(first, store) == 1
    assert rows(index_store.read_index(spark, store)) == rows(first)
    assert index_store.write_index(second, store, batch_id=7) == 2
    # A repeated batch writes nothing; the same number of another stream is another batch.
    assert index_store.write_index(first, store, batch_id=7) == 2
    assert rows(index_store.read_index(spark, store)) == rows(second)
    assert index_store.highest_id(spark, store) == 5
    assert index_store.write_index(first, store, batch_id=7, stream="other") == 3
    # The whole index may be replaced from itself.
    index_store.write_index(index_store.read_index(spark, store).where("id = 5"), store)
    assert [r.id for r in index_store.read_index(spark, store).collect()] == [5]
    for nowhere in (None, ""):
        with pytest.raises(Exception, match="without a root"):
            index_store.write_index(index(spark, {"id": 1, "rel_path": "a.nef", "root": nowhere}), str(tmp_path / "none"))


def test_partitions_of_an_older_schema_get_defaults(spark, tmp_path):
    store = str(tmp_path / "store")
    old = index(spark, {"id": 1, "rel_path": "a.nef", "root": "/r"}).drop("rot_cw", "jpeg_rel_path")
    old.write.partitionBy("root").parquet(f"{store}/photos")
    index_store.write_index(index(spark, {"id": 2, "rel_path": "b.nef", "root": "/s"}), store, changed_roots=roots_of(spark, "/s"))
    assert rows(index_store.read_index(spark, store), "id", "rot_cw", "jpeg_rel_path") == [(1, 0, None), (2, 0, None)]


def roots_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def files_of(store):
    """Data files by root, with their times of writing."""
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in (store / "photos").glob("root=*")}


def test_index_store_writes_changed_roots_only(spark, tmp_path):
    store = str(tmp_path / "store")
    index_store.write_index(
        index(spark, {"id": 1, "rel_path": "a.nef"}, {"id": 2, "rel_path": "b.nef", "root": "/s"}, {"id": 3, "rel_path": "c.nef", "root": "/t"}),
        store,
    )
    files = spark.createDataFrame(
        [("/r", "a.nef", 1, 1), ("/s", "b.nef", 1, 1), ("/s", "new.nef", 1, 1)],
        "root string, rel_path string, mtime_ns bigint, size bigint",
    )
    roots = spark.createDataFrame([("/r", True), ("/s", True)], "root string, recursive boolean")
    before = files_of(tmp_path / "store")
    assert sync_store(files, store, roots) == 2
    after = files_of(tmp_path / "store")
    assert {r for r in after if after[r] != before[r]} == {"root=%2Fs"}
    now = index_store.read_index(spark, store)
    assert rows(now, "id", "root", "rel_path") == [(1, "/r", "a.nef"), (2, "/s", "b.nef"), (3, "/t", "c.nef"), (4, "/s", "new.nef")]
    assert sync_store(files, store, roots) == 3 and files_of(tmp_path / "store") == after
    # An emptied root stays, with its rows missing; nothing else is rewritten.
    gone = spark.createDataFrame([("/t", True)], "root string, recursive boolean")
    sync_store(files.limit(0), store, gone)
    after = index_store.read_index(spark, store)
    assert rows(after, "id", "status") == [(1, 0), (2, 0), (3, 3), (4, 0)]


def test_index_reader_prunes_roots_and_columns(spark, tmp_path):
    store = str(tmp_path / "store")
    index_store.write_index(index(spark, {"id": 1, "rel_path": "a.nef"}, {"id": 2, "rel_path": "b.nef", "root": "/s"}), store)
    df = index_store.read_index(spark, store).where("root = '/s' AND status = 0").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "isnotnull(root" in partition_filters and "= /s" in partition_filters
    assert "ReadSchema: struct<id:bigint,status:int>" in plan
    assert [r.id for r in df.collect()] == [2]


def extractor():
    def read_header(root, rel_path):
        if rel_path == "broken.nef":
            raise RuntimeError("x" * 500)
        if rel_path == "silent.nef":
            raise KeyError()
        return {"make": "Acme", "exposure_n": 1, "exposure_d": 250, "orientation": 6}

    def preview(root, rel_path):
        if rel_path.startswith("stage"):
            raise ValueError("first stage cannot")
        return None if rel_path == "thumb.nef" or rel_path == "empty.nef" else (6000, 4000)

    def thumbnail(root, rel_path):
        return None if rel_path == "empty.nef" else (160, 120)

    return read_header, [preview, thumbnail]


def test_ingest_job_isolates_rows(spark):
    names = ("fine.nef", "broken.nef", "silent.nef", "stage.nef", "thumb.nef", "empty.nef")
    photos = index(spark, *[{"id": i, "rel_path": n} for i, n in enumerate(names, 1)], {"id": 9, "rel_path": "done.nef", "status": 1})
    got = {r.id: r for r in ingest_job(pending_queue(photos), *extractor(), clock=lambda: 5.0).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert {i: r.kind for i, r in got.items()} == {1: "ok", 2: "error", 3: "error", 4: "ok", 5: "ok", 6: "error"}
    assert (got[1].width, got[1].height, got[1].camera, got[1].shutter, got[1].orientation) == (6000, 4000, "Acme", "1/250 s", 6)
    assert got[1].preview_path.startswith("previews/") and got[1].ingested_at == 5000
    assert got[2].err_msg == "x" * 400 and got[2].width is None and got[2].preview_path is None
    assert got[3].err_msg == "KeyError"
    assert (got[4].width, got[5].width) == (160, 160)
    assert got[6].err_msg == NO_PREVIEW
    after = ingest_pending(photos, *extractor())
    assert dict(rows(after, "id", "status")) == {1: 1, 2: 2, 3: 2, 4: 1, 5: 1, 6: 2, 9: 1}
    assert pending_queue(after).isEmpty()


def test_edits_are_published_into_their_roots_only(spark, tmp_path):
    store = str(tmp_path / "store")
    index_store.write_index(
        index(
            spark, {"id": 1, "rel_path": "a.nef", "label": 2}, {"id": 2, "rel_path": "b.nef", "root": "/s", "rot_cw": 3},
            {"id": 3, "rel_path": "c.nef", "root": "/t"}, {"id": 4, "rel_path": "d.nef", "root": "/t"},
        ),
        store,
    )

    def now(*columns):
        return rows(index_store.read_index(spark, store), "id", *columns)

    def written(call):
        before = files_of(tmp_path / "store")
        number = call()
        after = files_of(tmp_path / "store")
        return number, sorted(r for r in after if after[r] != before[r])

    ids = spark.createDataFrame([(1,), (3,), (99,)], "id bigint")
    # Photo 1 has the label, so its root is left alone.
    assert written(lambda: publish.publish_labels(spark, store, ids, 2)) == (2, ["root=%2Ft"])
    assert now("label") == [(1, 2), (2, 0), (3, 2), (4, 0)]
    assert written(lambda: publish.publish_labels(spark, store, ids, 2)) == (None, [])
    turns = spark.createDataFrame([(2, 2), (98, 1)], "id bigint, by int")
    call = lambda: publish.publish_rotations(spark, store, turns, delta="by", batch_id=1, stream="turns")
    assert written(call) == (3, ["root=%2Fs"])
    assert written(call) == (3, [])
    assert now("rot_cw") == [(1, 0), (2, 1), (3, 0), (4, 0)]

    def read_header(root, rel_path):
        if rel_path == "d.nef":
            raise ValueError("no header")
        return {"make": "Acme", "model": "One"}

    before = now("status")
    assert [s for _, s in before] == [0, 0, 0, 0]
    number, _ = written(lambda: publish.ingest_store(spark, store, read_header, [lambda root, path: (6, 4)]))
    assert number == 4
    assert now("status", "camera", "err_msg", "label") == [
        (1, 1, "Acme One", None, 2), (2, 1, "Acme One", None, 0), (3, 1, "Acme One", None, 2), (4, 2, None, "no header", 0),
    ]
    assert written(lambda: publish.ingest_store(spark, store, read_header, [])) == (None, [])


def test_ingest_starts_at_the_front_of_the_queue(spark, tmp_path):
    """Tasks with low numbers hold the front, and each works in queue order."""
    photos = index(spark, *[{"id": i, "rel_path": f"{(i * 37) % 100:03}.nef"} for i in range(1, 101)])
    wanted = spark.createDataFrame([(i,) for i in range(90, 101)], "id bigint")
    queue = prioritize(queue_positions(photos), wanted, ["root"]).join(photos.select("id", "mtime_ns", "size"), "id")

    def started(pending):
        begun = F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")
        done = ingest_job(pending, lambda root, path: {}, [lambda root, path: (1, 1)], tasks=8)
        return [(r.task, r.id) for r in done.select("id", *begun).orderBy("at").collect()]

    order = started(queue)
    assert len({task for task, _ in order}) >= 6
    assert [i for _, i in order] == [r.id for r in queue.orderBy("priority_pos").collect()]
    assert {i for _, i in order[:11]} == set(range(90, 101))
    plain = started(pending_queue(photos))
    assert [i for _, i in plain] == [r.id for r in photos.orderBy("rel_path").collect()]


def test_a_long_folder_is_listed_in_chunks(tmp_path):
    """A task holds few names at once, however many the folder has."""
    import pandas as pd

    from photocat.sources import listing

    for i in range(listing.NAMES_AT_ONCE + 5):
        (tmp_path / f"{i}.nef").touch()
    names, _ = listing._walkers()
    root = os.fsencode(str(tmp_path))
    start = pd.DataFrame([("r", root, b"", True)], columns=["root", "raw_root", "raw_path", "folder"])
    found = list(names([start]))
    assert max(map(len, found)) <= listing.NAMES_AT_ONCE
    assert len(set(pd.concat(found)["raw_path"])) == listing.NAMES_AT_ONCE + 5
