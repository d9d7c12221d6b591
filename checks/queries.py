"""Every registered query with the SQL that must give the same rows."""

import os
from contextlib import ExitStack

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.ctes import with_ctes
from checks.files import new_folder, put_files
from photocat.functions import display as D
from photocat.functions import exif as E
from photocat.functions import paths as P
from photocat.operators import assets, edits, export, scan, selection, stats, sync, views
from photocat.operators.ingest import ingest_job
from photocat.operators.ordering import rank_rows
from photocat.plans import publish
from photocat.plans.cull import culled_view, edited_photos, planned_export
from photocat.plans.rescan import rescan_summary, sync_roots
from photocat.schema import PHOTOS_SCHEMA
from photocat.session import new_path, scoped_setting, stage
from photocat.sources import events as event_sources
from photocat.sources.index_store import read_index, write_index
from photocat.sources.listing_format import load_listing
from photocat.sources.listing import asset_listing, delete_assets, photo_listing
from photocat import streaming

QUERIES, SQL, ON_FIXTURES = {}, {}, {}
LABELED = 0b111110
DEST = "/cards/c1/day1"


def query(name, sql=None):
    def register(fn):
        ON_FIXTURES[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(X.Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return fn

    return register


def labelled_view(fx):
    """Live, labelled rows in file-name order."""
    return culled_view(fx.photos, LABELED, "filename")


# --- scans, sources, sinks -------------------------------------------------


@query("scan", "SELECT root, rel_path, mtime_ns, size, jpeg_rel_path FROM scan_all")
def _(fx):
    return scan.scan(fx.listing, recursive=True)


@query("scan_per_root", "SELECT root, rel_path, mtime_ns, size, jpeg_rel_path FROM scan_scoped")
def _(fx):
    return scan.scan(fx.listing, roots=fx.scanned_roots)


@query(
    "photo_listing",
    "SELECT root, rel_path, mtime_ns, size FROM listing WHERE NOT (rel_path LIKE '.%' OR rel_path LIKE '%/.%')",
)
def _(fx):
    folder = new_folder(fx.spark, "cards")
    path = F.concat(F.lit(folder), "root", F.lit("/"), "rel_path")
    put_files(fx.listing.select(path.alias("path"), "size", "mtime_ns"))
    roots = [f"{folder}/cards/{name}" for name in os.listdir(f"{folder}/cards")]
    found = photo_listing(fx.spark, roots, recursive=True)
    return found.withColumn("root", F.substring("root", len(folder) + 1, 1000))


@query(
    "photo_listing_format",
    """SELECT root, rel_path, mtime_ns, size FROM listing
       WHERE NOT (rel_path LIKE '.%' OR rel_path LIKE '%/.%') AND rel_path LIKE '%.NEF'""",
)
def _(fx):
    folder = new_folder(fx.spark, "cards")
    path = F.concat(F.lit(folder), "root", F.lit("/"), "rel_path")
    put_files(fx.listing.select(path.alias("path"), "size", "mtime_ns"))
    roots = [f"{folder}/cards/{name}" for name in os.listdir(f"{folder}/cards")]
    found = load_listing(fx.spark, roots, recursive=True).where(F.col("rel_path").endswith(".NEF"))
    return found.withColumn("root", F.substring("root", len(folder) + 1, 1000))


@query(
    "asset_listing",
    "SELECT kind, hash, kind || 's/' || hash || '.jpg' AS path, bytes, last_used FROM cache_files WHERE id % 4 <> 2",
)
def _(fx):
    folder = new_folder(fx.spark, "cache")
    ends = F.expr("CASE id % 4 WHEN 2 THEN '.tmp' ELSE '.jpg' END")
    path = F.concat(F.lit(f"{folder}/"), "kind", F.lit("s/"), "hash", ends)
    put_files(
        fx.cache_files.select(
            path.alias("path"), F.col("bytes").alias("size"), F.col("last_used").alias("mtime_ns")
        )
    )
    return asset_listing(fx.spark, folder)


@query(
    "export_files",
    """SELECT root, ordinal, source, there AS ok,
         CASE WHEN NOT there THEN 'No such file or directory (os error 2)' END AS reason,
         CASE WHEN there AND row_number() OVER (PARTITION BY name, there ORDER BY root DESC, ordinal DESC) = 1
              THEN 1 ELSE 0 END::BIGINT AS copies
       FROM (SELECT *, source IN (SELECT source FROM clashing WHERE id % 9 <> 1) AS there FROM clashing) c""",
)
def _(fx):
    home, dest = new_folder(fx.spark, "originals"), new_folder(fx.spark, "out")
    files = stage(clashing(fx), "files").withColumn("source", F.concat(F.lit(home), "source"))
    there = files.where("id % 9 <> 1").select(
        F.col("source").alias("path"), (F.col("id") % 100).alias("size"), F.col("id").alias("mtime_ns")
    )
    put_files(there)
    plan = export.export_plan(files, fx.dest_files, dest)
    done = export.export_files(plan, dest)
    return done.withColumn("source", F.substring("source", len(home) + 1, 1000))


@query("write_index", "SELECT root, count(*) AS n, max(id) AS top FROM photos GROUP BY root")
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    return read_index(fx.spark, store).groupBy("root").agg(
        F.count("*").alias("n"), F.max("id").alias("top")
    )


@query("read_index", f"SELECT {', '.join(PHOTOS_SCHEMA.names)} FROM photos")
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    return read_index(fx.spark, store)


@query(
    "upgrade_index",
    """SELECT id, root, rel_path, mtime_ns, size, CAST(NULL AS bigint) AS width, CAST(NULL AS bigint) AS height,
         CAST(1 AS int) AS orientation, CAST(0 AS int) AS rot_cw, CAST(NULL AS string) AS camera, CAST(NULL AS string) AS lens,
         CAST(NULL AS string) AS taken_at, CAST(NULL AS string) AS shutter, CAST(NULL AS double) AS aperture,
         CAST(NULL AS bigint) AS iso, CAST(NULL AS double) AS focal_mm, label, CAST(status AS int) AS status,
         CAST(NULL AS string) AS err_msg, CAST(NULL AS string) AS preview_path, CAST(NULL AS string) AS thumb_path,
         CAST(NULL AS string) AS jpeg_rel_path, CAST(NULL AS bigint) AS ingested_at FROM photos_index""",
)
def _(fx):
    return sync.upgrade_index(fx.photos_index.drop("rot_cw", "jpeg_rel_path"), 1)


def _replayed(fx, frame, source, **kwargs):
    """Writes a log as files and reads it back through a streaming source."""
    logs, out = new_path(fx.spark, "log"), new_path(fx.spark, "out")
    frame.repartition(4).write.parquet(logs)
    _drain(
        source(fx.spark, logs, maxFilesPerTrigger=2)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-checkpoint")
    )
    return fx.spark.read.parquet(out)


def _drain(writer):
    """Runs a stream over everything that is there and waits for it."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("label_event_source", "SELECT event_id, ts, id, CAST(label AS int) AS label FROM label_events")
def _(fx):
    return _replayed(fx, fx.label_events, event_sources.label_event_source)


@query(
    "ingest_event_source",
    """SELECT event_id, ts, job, generation, id, kind, CAST(NULL AS bigint) AS enqueued FROM ingest_events
       UNION ALL SELECT started_event_id, NULL, job, generation, NULL, 'Started', enqueued FROM ingest_batches""",
)
def _(fx):
    return _replayed(fx, ingest_log(fx), event_sources.ingest_event_source)


def ingest_log(fx):
    """Ingest events and batch starts in one log."""
    none = F.lit(None)
    starts = fx.ingest_batches.select(
        F.col("started_event_id").alias("event_id"),
        none.cast("timestamp_ntz").alias("ts"),
        "job",
        "generation",
        none.cast("bigint").alias("id"),
        F.lit("Started").alias("kind"),
        "enqueued",
    )
    return fx.ingest_events.withColumn("enqueued", none.cast("bigint")).unionByName(starts)


# --- projections, filters, predicates --------------------------------------

_FILES = "SELECT root, rel_path, size FROM listing WHERE "
_EXT = r"lower(regexp_extract(rel_path, '\.([^./]*)$', 1))"


@query("visible_files", _FILES + "NOT (rel_path LIKE '.%' OR rel_path LIKE '%/.%')")
def _(fx):
    return scan.visible_files(fx.listing).select("root", "rel_path", "size")


@query("depth_filter", _FILES + "rel_path NOT LIKE '%/%'")
def _(fx):
    return scan.depth_filter(fx.listing).select("root", "rel_path", "size")


@query("raw_files", _FILES + _EXT + " IN ('nef', 'cr3', 'arw', 'dng', 'raf')")
def _(fx):
    return scan.raw_files(fx.listing).select("root", "rel_path", "size")


@query("jpeg_files", _FILES + _EXT + " IN ('jpg', 'jpeg')")
def _(fx):
    return scan.jpeg_files(fx.listing).select("root", "rel_path", "size")


@query(
    "label_filter",
    """SELECT 'mixed' AS mask, id, root, label FROM photos WHERE (0b010100 & (1 << label)) <> 0
       UNION ALL SELECT 'labeled', id, root, label FROM photos WHERE label <> 0
       UNION ALL SELECT 'unlabeled', id, root, label FROM photos WHERE label = 0
       UNION ALL SELECT 'all', id, root, label FROM photos""".replace("0b010100", "20"),
)
def _(fx):
    rows = fx.photos.select("id", "root", "label")
    masks = {"mixed": 0b010100, "labeled": LABELED, "unlabeled": 1, "all": 0}
    parts = [
        views.label_filter(rows, m).select(F.lit(n).alias("mask"), "id", "root", "label")
        for n, m in masks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_ENTRY = ", ".join(views.ENTRY_COLUMNS)
_DETAIL = ", ".join(views.DETAIL_COLUMNS)
_PIXELS = """CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN width END AS width,
  CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN height END AS height"""


def _paired(columns):
    return columns.replace("width, height", _PIXELS)


@query("live_entries", f"SELECT {_paired(_ENTRY)} FROM live")
def _(fx):
    return views.live_entries(fx.photos)


@query(
    "pending_queue",
    """SELECT id, root, rel_path, mtime_ns, size, jpeg_rel_path,
         row_number() OVER (PARTITION BY root ORDER BY rel_path) - 1 AS queue_pos
       FROM photos WHERE status = 0""",
)
def _(fx):
    return views.pending_queue(fx.photos).join(
        views.queue_positions(fx.photos).select("id", "queue_pos"), "id"
    )


@query("entries", f"SELECT {_paired(_ENTRY)} FROM photos")
def _(fx):
    return views.entries(fx.photos)


@query("details", f"SELECT {_paired(_DETAIL)} FROM photos")
def _(fx):
    return views.details(fx.photos)


_VALID = """SELECT id, CAST(CASE WHEN label BETWEEN 0 AND 5 THEN label ELSE 0 END AS int) AS label,
  CAST(CASE WHEN status BETWEEN 0 AND 3 THEN status ELSE 0 END AS int) AS status,
  CAST(((rot_cw % 4) + 4) % 4 AS int) AS rot_cw,
  CAST(CASE WHEN orientation BETWEEN 0 AND 65535 THEN orientation ELSE 1 END AS int) AS orientation,
  CASE WHEN w <= 4294967295 AND h <= 4294967295 THEN w END AS width,
  CASE WHEN w <= 4294967295 AND h <= 4294967295 THEN h END AS height,
  CASE WHEN iso BETWEEN 0 AND 4294967295 THEN iso END AS iso
FROM (SELECT *, CASE WHEN width < 0 THEN 0 ELSE width END AS w, CASE WHEN height < 0 THEN 0 ELSE height END AS h
      FROM stored_rows) s"""


@query("validate_rows", _VALID)
def _(fx):
    return views.validate_rows(fx.stored_rows).select(
        "id", "label", "status", "rot_cw", "orientation", "width", "height", "iso"
    )


@query("photo_by_id", f"SELECT {_paired(_ENTRY)} FROM photos WHERE id = 47")
def _(fx):
    return views.photo_by_id(fx.photos, 47)


@query(
    "needs_refresh",
    """SELECT i.id, i.status = 3 OR i.mtime_ns <> s.mtime_ns OR i.size <> s.size AS refresh
       FROM photos i JOIN scan_all s ON i.root = s.root AND i.rel_path = s.rel_path""",
)
def _(fx):
    found = scan.scan(fx.listing, recursive=True).select(
        "root", "rel_path", F.col("mtime_ns").alias("m"), F.col("size").alias("s")
    )
    return fx.photos.join(found, ["root", "rel_path"]).select(
        "id", sync.needs_refresh("status", "mtime_ns", "size", "m", "s").alias("refresh")
    )


@query("paired_only", "SELECT id, root, jpeg_rel_path FROM photos WHERE jpeg_rel_path IS NOT NULL")
def _(fx):
    return views.paired_only(fx.photos).select("id", "root", "jpeg_rel_path")


@query(
    "for_root",
    """SELECT p.root, e.event_id, e.kind FROM ingest_events e JOIN photos p ON e.id = p.id
       WHERE p.root IN (SELECT root FROM scanned_roots WHERE recursive)""",
)
def _(fx):
    tagged = fx.ingest_events.join(fx.photos.select("id", "root"), "id").select(
        "root", "event_id", "kind"
    )
    return views.for_root(tagged, fx.scanned_roots.where("recursive"))


# --- joins ------------------------------------------------------------------


@query("pair_raw_jpeg", "SELECT root, rel_path, jpeg_rel_path FROM scan_all")
def _(fx):
    files = scan.visible_files(fx.listing).select("root", "rel_path")
    return scan.pair_raw_jpeg(files).select("root", "rel_path", "jpeg_rel_path")


@query(
    "scan_diff",
    "SELECT root, rel_path, id, action, new_mtime_ns, new_size, new_jpeg_rel_path FROM diff",
)
def _(fx):
    found = scan.scan(fx.listing, roots=fx.scanned_roots)
    return sync.scan_diff(found, fx.photos_index, fx.scanned_roots).select(
        "root", "rel_path", "id", "action", "new_mtime_ns", "new_size", "new_jpeg_rel_path"
    )


@query("missing_photos", "SELECT id, root, rel_path FROM diff WHERE action = 'mark_missing'")
def _(fx):
    found = scan.scan(fx.listing, roots=fx.scanned_roots)
    return sync.missing_photos(found, fx.photos_index, fx.scanned_roots).select(
        "id", "root", "rel_path"
    )


@query("apply_sync", f"SELECT {', '.join(PHOTOS_SCHEMA.names)} FROM synced")
def _(fx):
    return sync_roots(fx.listing, fx.photos, fx.scanned_roots)


@query("apply_sync_repeated_root", f"SELECT {', '.join(PHOTOS_SCHEMA.names)} FROM synced")
def _(fx):
    return sync_roots(fx.listing, fx.photos, fx.scanned_roots.unionByName(fx.scanned_roots))


@query(
    "rescan_summary",
    """SELECT root, count(*) FILTER (WHERE label = 0 AND status <> 3) AS n_none,
         count(*) FILTER (WHERE label = 1 AND status <> 3) AS n_red,
         count(*) FILTER (WHERE label = 2 AND status <> 3) AS n_yellow,
         count(*) FILTER (WHERE label = 3 AND status <> 3) AS n_green,
         count(*) FILTER (WHERE label = 4 AND status <> 3) AS n_blue,
         count(*) FILTER (WHERE label = 5 AND status <> 3) AS n_purple,
         count(*) FILTER (WHERE status = 2) AS n_errors, count(*) FILTER (WHERE status = 0) AS n_pending
       FROM synced GROUP BY root
       UNION ALL SELECT root, 0, 0, 0, 0, 0, 0, 0, 0 FROM scanned_roots WHERE root NOT IN (SELECT root FROM synced)""",
)
def _(fx):
    return rescan_summary(fx.listing, fx.photos, fx.scanned_roots)


@query(
    "set_labels",
    """SELECT id, CAST(CASE WHEN id IN (SELECT id FROM selection) THEN 3 ELSE label END AS int) AS label,
         id IN (SELECT id FROM selection) AND label <> 3 AS changed FROM photos""",
)
def _(fx):
    unknown = fx.selection.select((-F.col("id") - 1).alias("id"))
    return edits.set_labels(fx.photos, fx.selection.unionByName(unknown), 3).select(
        "id", "label", "changed"
    )


@query(
    "set_rotations",
    """SELECT id, CAST(CASE WHEN id % 5 = 0 THEN ((id % 11 - 5) % 4 + 4) % 4 ELSE rot_cw END AS int) AS turned_to,
         CAST(CASE WHEN id % 3 = 0 THEN (rot_cw + 3) % 4 ELSE rot_cw END AS int) AS advanced_to FROM photos""",
)
def _(fx):
    to = fx.photos.where("id % 5 = 0").selectExpr("id", "id % 11 - 5 AS turns")
    by = fx.photos.where("id % 3 = 0").selectExpr("id", "-1 AS delta")
    one = edits.set_rotations(fx.photos, to, turns="turns").select(
        "id", F.col("rot_cw").alias("turned_to")
    )
    two = edits.set_rotations(fx.photos, by, delta="delta").select(
        "id", F.col("rot_cw").alias("advanced_to")
    )
    return one.join(two, "id")


@query(
    "publish_labels",
    """SELECT id, root, CAST(CASE WHEN id IN (SELECT id FROM selection) THEN 3 ELSE label END AS int) AS label,
         rel_path, status FROM photos""",
)
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    publish.publish_labels(fx.spark, store, fx.selection, 3)
    return read_index(fx.spark, store).select("id", "root", "label", "rel_path", "status")


@query(
    "publish_rotations",
    """SELECT id, root, CAST(CASE WHEN id % 3 = 0 THEN (rot_cw + 3) % 4 ELSE rot_cw END AS int) AS rot_cw FROM photos""",
)
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    by = fx.photos.where("id % 3 = 0").selectExpr("id", "-1 AS delta")
    publish.publish_rotations(fx.spark, store, by, delta="delta")
    return read_index(fx.spark, store).select("id", "root", "rot_cw")


def ingest_results(fx):
    clean = E.normalize_exif(fx.exif_raw, "id")
    text = F.col("id").cast("string")
    ok = clean.where("id % 7 <> 0").select(
        "*",
        F.lit("ok").alias("kind"),
        F.concat(F.lit("previews/"), text, F.lit(".jpg")).alias("preview_path"),
        F.concat(F.lit("thumbs/"), text, F.lit(".jpg")).alias("thumb_path"),
        (F.lit(1800000000000) + F.col("id")).alias("ingested_at"),
    )
    bad = clean.where("id % 7 = 0 OR id % 11 = 0").select(
        "id",
        F.lit("error").alias("kind"),
        F.concat(F.repeat(F.lit("bad file "), 60), text).alias("err_msg"),
        (F.lit(1800000001000) + F.col("id")).alias("ingested_at"),
    )
    return ok.unionByName(bad, allowMissingColumns=True)


@query(
    "record_ingest",
    "SELECT p.id, p.root, p.rel_path, p.mtime_ns, p.size, p.rot_cw, p.label, p.jpeg_rel_path, "
    + ", ".join(
        f"CASE WHEN k.id IS NULL THEN p.{c} ELSE k.{c} END AS {c}"
        for c in (
            "width height orientation camera lens taken_at shutter aperture iso focal_mm "
            "preview_path thumb_path ingested_at"
        ).split()
    )
    + """, CAST(CASE WHEN b.id IS NOT NULL THEN 2 WHEN k.id IS NOT NULL THEN 1 ELSE p.status END AS int) AS status,
      CASE WHEN b.id IS NOT NULL THEN substring(b.err_msg, 1, 400) ELSE p.err_msg END AS err_msg
      FROM photos p LEFT JOIN (SELECT * FROM results WHERE kind = 'ok') k ON p.id = k.id
      LEFT JOIN (SELECT * FROM results WHERE kind = 'error') b ON p.id = b.id""",
)
def _(fx):
    return sync.record_ingest(fx.photos, ingest_results(fx))


@query(
    "publish_ingest",
    "SELECT p.id, p.root, p.rel_path, p.mtime_ns, p.size, p.rot_cw, p.label, p.jpeg_rel_path, "
    + ", ".join(
        f"CASE WHEN k.id IS NULL THEN p.{c} ELSE k.{c} END AS {c}"
        for c in (
            "width height orientation camera lens taken_at shutter aperture iso focal_mm "
            "preview_path thumb_path ingested_at"
        ).split()
    )
    + """, CAST(CASE WHEN b.id IS NOT NULL THEN 2 WHEN k.id IS NOT NULL THEN 1 ELSE p.status END AS int) AS status,
      CASE WHEN b.id IS NOT NULL THEN substring(b.err_msg, 1, 400) ELSE p.err_msg END AS err_msg
      FROM photos p LEFT JOIN (SELECT * FROM results WHERE kind = 'ok') k ON p.id = k.id
      LEFT JOIN (SELECT * FROM results WHERE kind = 'error') b ON p.id = b.id""",
)
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    publish.publish_ingest(fx.spark, store, ingest_results(fx))
    return read_index(fx.spark, store)


@query(
    "with_taken_at",
    "SELECT e.id, e.root, e.rel_path, x.taken_at FROM live e LEFT JOIN exif x ON e.id = x.id",
)
def _(fx):
    rows = views.live_entries(fx.photos).select("id", "root", "rel_path")
    return views.with_taken_at(rows, E.normalize_exif(fx.exif_raw, "id"))


def export_files_of(fx, mode="all"):
    scope = export.export_scope(labelled_view(fx), fx.photos, fx.selection)
    return export.export_set(scope, mode)


def clashing(fx):
    """The export list under names that collide, as several cards would give."""
    stem = F.concat(F.lit("IMG_"), F.lpad((F.col("id") % 400).cast("string"), 4, "0"), F.lit("."))
    return export_files_of(fx).withColumn("name", F.concat(stem, P.file_ext("name")))


@query(
    "existing_names",
    """SELECT name, f.root AS root, f.ordinal AS ordinal
       FROM (SELECT name, min((root, ordinal)) AS first FROM files GROUP BY name) g,
       LATERAL (SELECT struct_extract_at(g.first, 1) AS root, struct_extract_at(g.first, 2) AS ordinal) f
       WHERE name IN (SELECT name FROM dest_files)""",
)
def _(fx):
    return export.existing_names(export_files_of(fx), fx.dest_files)


@query(
    "cache_gc",
    "SELECT hash, id, kind, bytes FROM cache_files WHERE hash NOT IN (SELECT hash FROM cache_files WHERE keep = 1)",
)
def _(fx):
    keep = fx.cache_files.where("keep = 1")
    return assets.cache_gc(fx.cache_files, keep).select("hash", "id", "kind", "bytes")


@query(
    "delete_assets",
    """SELECT kind, hash, (SELECT count(*) FROM cache_files WHERE hash NOT IN
           (SELECT hash FROM cache_files WHERE keep = 1)) AS n_removed
       FROM cache_files WHERE hash IN (SELECT hash FROM cache_files WHERE keep = 1)""",
)
def _(fx):
    """Lists a cache, deletes what nobody keeps, and lists it again."""
    folder = new_folder(fx.spark, "cache")
    path = F.concat(F.lit(f"{folder}/"), "kind", F.lit("s/"), "hash", F.lit(".jpg"))
    put_files(
        fx.cache_files.select(path.alias("path"), F.col("bytes").alias("size"), F.col("last_used").alias("mtime_ns"))
    )
    doomed = assets.cache_gc(asset_listing(fx.spark, folder), fx.cache_files.where("keep = 1"))
    removed = stage(delete_assets(doomed, folder), "removed").where("removed").count()
    return asset_listing(fx.spark, folder).select("kind", "hash", F.lit(removed).cast("bigint").alias("n_removed"))


@query(
    "retain_assets",
    "SELECT id, kind, bytes FROM cache_files WHERE id IN (SELECT id FROM selection)",
)
def _(fx):
    return assets.retain_assets(fx.cache_files, fx.selection).select("id", "kind", "bytes")


@query(
    "dangling_assets",
    """SELECT id, path FROM (SELECT id, preview_path AS path FROM photos WHERE status = 1
         UNION ALL SELECT id, thumb_path FROM photos WHERE status = 1) a
       WHERE path NOT IN (SELECT kind || 's/' || hash || '.jpg' FROM cache_files WHERE keep = 1 AND bytes % 3 <> 0)""",
)
def _(fx):
    there = fx.cache_files.where("keep = 1 AND bytes % 3 <> 0").selectExpr(
        "kind || 's/' || hash || '.jpg' AS path"
    )
    return assets.dangling_assets(fx.photos, there)


# --- aggregations -----------------------------------------------------------

_TALLY = """SELECT root, count(*) FILTER (WHERE label = 0 AND status <> 3) AS n_none,
  count(*) FILTER (WHERE label = 1 AND status <> 3) AS n_red,
  count(*) FILTER (WHERE label = 2 AND status <> 3) AS n_yellow,
  count(*) FILTER (WHERE label = 3 AND status <> 3) AS n_green,
  count(*) FILTER (WHERE label = 4 AND status <> 3) AS n_blue,
  count(*) FILTER (WHERE label = 5 AND status <> 3) AS n_purple,
  count(*) FILTER (WHERE status = 2) AS n_errors FROM {} GROUP BY root"""


@query("tally", _TALLY.format("photos"))
def _(fx):
    return stats.tally(fx.photos)


@query("status_counts", "SELECT root, status, count(*) AS n FROM photos GROUP BY root, status")
def _(fx):
    return stats.status_counts(fx.photos)


@query(
    "sheet_stats",
    """SELECT root, count(*) FILTER (WHERE status <> 3) AS total,
         count(*) FILTER (WHERE label BETWEEN 1 AND 5 AND status <> 3) AS shown,
         count(*) FILTER (WHERE id IN (SELECT id FROM selection) AND status <> 3) AS selected FROM photos GROUP BY root""",
)
def _(fx):
    return stats.sheet_stats(fx.photos, LABELED, fx.selection)


@query(
    "export_count",
    """SELECT 'all' AS mode, root, count(*) AS n FROM scope GROUP BY root
       UNION ALL SELECT 'raw', root, count(*) FROM scope GROUP BY root
       UNION ALL SELECT 'jpeg', root, count(jpeg_rel_path) FROM scope GROUP BY root""",
)
def _(fx):
    scope = stage(export.export_scope(labelled_view(fx), fx.photos, fx.selection), "scope")
    parts = [
        stats.export_count(scope, m).select(F.lit(m).alias("mode"), "root", "n")
        for m in export.MODES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "export_report",
    """SELECT count(*) FILTER (WHERE id % 9 <> 1) AS copied, count(*) FILTER (WHERE id % 9 = 1) AS failed,
         count(*) AS processed, count(*) < 1000000000 AS cancelled FROM files""",
)
def _(fx):
    results = export_files_of(fx).withColumn("ok", F.col("id") % 9 != 1)
    return export.export_report(results, planned=1_000_000_000)


@query(
    "export_failures",
    "SELECT root, ordinal, source, 'lost ' || name AS reason FROM files WHERE id % 9 = 1",
)
def _(fx):
    results = export_files_of(fx).withColumn("ok", F.col("id") % 9 != 1)
    return export.export_failures(
        results.withColumn("reason", F.concat(F.lit("lost "), F.col("name")))
    )


@query(
    "latest_by_key",
    "SELECT path, max(opened_at) AS opened_at FROM root_opens GROUP BY path",
)
def _(fx):
    return edits.latest_by_key(fx.root_opens, ["path"], ["opened_at"], ["opened_at"])


@query("current_labels", "SELECT id, CAST(label AS int) AS label FROM labels_now")
def _(fx):
    return edits.current_labels(fx.label_events)


@query(
    "current_rotation",
    """SELECT p.id, CAST(((p.rot_cw + coalesce(r.net, 0)) % 4 + 4) % 4 AS int) AS rot_cw FROM photos p
       LEFT JOIN (SELECT id, CAST(sum(delta) AS bigint) AS net FROM rotation_events GROUP BY id) r ON p.id = r.id""",
)
def _(fx):
    return edits.current_rotation(fx.rotation_events, fx.photos.select("id", "rot_cw"))


@query(
    "edited_photos",
    """SELECT p.id, CAST(coalesce(l.label, p.label) AS int) AS label,
         CAST(((p.rot_cw + coalesce(r.net, 0)) % 4 + 4) % 4 AS int) AS rot_cw FROM photos p
       LEFT JOIN labels_now l ON p.id = l.id
       LEFT JOIN (SELECT id, CAST(sum(delta) AS bigint) AS net FROM rotation_events GROUP BY id) r ON p.id = r.id""",
)
def _(fx):
    return edited_photos(fx.photos, fx.label_events, fx.rotation_events).select(
        "id", "label", "rot_cw"
    )


@query(
    "recent_roots",
    """SELECT path, max(opened_at) AS last_opened FROM root_opens GROUP BY path
       ORDER BY last_opened DESC, path LIMIT 5""",
)
def _(fx):
    return edits.recent_roots(fx.root_opens, 5)


@query(
    "batch_accounting",
    """SELECT b.job, b.generation, b.enqueued,
         count(*) FILTER (WHERE j.fresh AND j.kind = 'Ingested') AS ingested,
         count(*) FILTER (WHERE j.fresh AND j.kind = 'Failed') AS failed,
         count(*) FILTER (WHERE NOT j.fresh) AS dropped,
         count(j.event_id) = b.enqueued AS finished
       FROM ingest_batches b LEFT JOIN judged j ON b.job = j.job AND b.generation = j.generation
       GROUP BY b.job, b.generation, b.enqueued""",
)
def _(fx):
    return stats.batch_accounting(fx.ingest_events, fx.ingest_batches)


def cancels(fx):
    return fx.ingest_batches.where("generation % 3 = 1").selectExpr("job", "started_event_id + 40 AS event_id")


@query(
    "batch_accounting_cancelled",
    """SELECT job, generation, enqueued, ingested, failed,
         CASE WHEN ended THEN greatest(stale, enqueued - ingested - failed) ELSE stale END AS dropped,
         ended OR ingested + failed + stale = enqueued AS finished
       FROM (SELECT b.job, b.generation, b.enqueued, s.ended,
               count(*) FILTER (WHERE j.fresh AND j.kind = 'Ingested') AS ingested,
               count(*) FILTER (WHERE j.fresh AND j.kind = 'Failed') AS failed,
               count(*) FILTER (WHERE NOT j.fresh) AS stale
             FROM ingest_batches b JOIN cancel_spans s ON b.job = s.job AND b.generation = s.generation
             LEFT JOIN cancel_judged j ON b.job = j.job AND b.generation = j.generation
             GROUP BY b.job, b.generation, b.enqueued, s.ended) c""",
)
def _(fx):
    return stats.batch_accounting(fx.ingest_events, fx.ingest_batches, cancels(fx))


@query(
    "latest_ingest_status_cancelled",
    """SELECT job, id, arg_max(kind, event_id) AS kind, max(event_id) AS event_id
       FROM cancel_judged WHERE fresh GROUP BY job, id""",
)
def _(fx):
    return stats.latest_ingest_status(fx.ingest_events, fx.ingest_batches, cancels(fx))


@query(
    "ingest_rate",
    """SELECT job, generation, count(*) AS done,
         CAST(floor(count(*) / greatest(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0.5)) AS bigint) AS rate
       FROM ingest_events GROUP BY job, generation""",
)
def _(fx):
    return stats.ingest_rate(fx.ingest_events)


@query(
    "names_preview",
    """SELECT root, string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE n <= 4)
         || CASE WHEN count(*) > 4 THEN ', … and ' || CAST(count(*) - 4 AS string) || ' more' ELSE '' END AS preview
       FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ordinal) AS n FROM files) f GROUP BY root""",
)
def _(fx):
    return stats.names_preview(stage(export_files_of(fx), "files"), ["root"])


@query(
    "media_mix",
    """SELECT root, count(*) AS total, count(*) FILTER (WHERE lower(rel_path) LIKE '%.cr3') AS matching,
         count(*) FILTER (WHERE lower(rel_path) LIKE '%.cr3') / count(*) AS share,
         count(*) FILTER (WHERE lower(rel_path) LIKE '%.cr3') * 2 >= count(*) AS reference_media
       FROM scan_all GROUP BY root""",
)
def _(fx):
    return stats.media_mix(scan.scan(fx.listing, recursive=True))


# --- order-dependent operators ------------------------------------------------


@query("ordered_view", "SELECT root, id, label, pos FROM view_name")
def _(fx):
    return labelled_view(fx).select("root", "id", "label", "pos")


@query(
    "position_of_total",
    "SELECT root, id, pos + 1 AS position, count(*) OVER (PARTITION BY root) AS total FROM view_name",
)
def _(fx):
    rows = fx.photos.where("status <> 3")
    return views.position_of_total(rows, LABELED).select("root", "id", "position", "total")


@query(
    "neighbors",
    """SELECT root, id, pos, concat_ws(',', l1, r1, l2, r2, l3, r3) AS near FROM (SELECT root, id, pos,
         lag(id, 1) OVER w AS l1, lead(id, 1) OVER w AS r1, lag(id, 2) OVER w AS l2, lead(id, 2) OVER w AS r2,
         lag(id, 3) OVER w AS l3, lead(id, 3) OVER w AS r3
       FROM view_name WINDOW w AS (PARTITION BY root ORDER BY pos)) v""",
)
def _(fx):
    near = F.array_join(F.transform("neighbors", lambda i: i.cast("string")), ",")
    return views.neighbors(labelled_view(fx)).select("root", "id", "pos", near.alias("near"))


@query(
    "advance_target",
    "SELECT root, id, pos, coalesce(lead(id) OVER (PARTITION BY root ORDER BY pos), id) AS target_id FROM view_name",
)
def _(fx):
    return views.advance_target(labelled_view(fx))


@query(
    "next_error",
    """SELECT root, id, pos, status, coalesce(
         first_value(CASE WHEN status = 2 THEN id END IGNORE NULLS) OVER (PARTITION BY root ORDER BY pos
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         first_value(CASE WHEN status = 2 THEN id END IGNORE NULLS) OVER (PARTITION BY root ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_error_id FROM view_name""",
)
def _(fx):
    return views.next_error(labelled_view(fx))


@query(
    "range_select",
    """SELECT c.session, c.anchor, c.clicked, v.root, v.pos, v.id FROM cursors c JOIN view_name v ON c.root = v.root
       AND v.pos BETWEEN least(c.anchor, c.clicked) AND greatest(c.anchor, c.clicked)""",
)
def _(fx):
    return selection.range_select(labelled_view(fx), fx.cursors)


@query(
    "sheet_pages",
    "SELECT root, id, pos, pos // 6 AS sheet_row, pos % 6 AS sheet_col FROM view_name",
)
def _(fx):
    view = labelled_view(fx).select("root", "id", "pos")
    return views.sheet_pages(view, 6)


@query(
    "sheet_rows",
    "SELECT root, CAST(ceil(count(*) / 6) AS bigint) AS sheet_rows FROM view_name GROUP BY root",
)
def _(fx):
    return views.sheet_rows(labelled_view(fx), 6)


_EVICT = """SELECT id, kind, bytes FROM (SELECT *, sum(bytes) OVER ({part}) AS total,
    coalesce(sum(bytes) OVER ({part} ORDER BY last_used, id, CASE kind WHEN 'thumb' THEN 0 ELSE 1 END
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM cache_files) c
  WHERE total > 1000000 AND total - prior > 750000"""


@query("lru_evict", _EVICT.format(part="PARTITION BY kind"))
def _(fx):
    slots = fx.cache_files.select("id", "kind", "bytes", "last_used")
    return assets.lru_evict(slots, 1_000_000, ["kind"]).select("id", "kind", "bytes")


@query("lru_evict_shared", _EVICT.format(part=""))
def _(fx):
    slots = fx.cache_files.select("id", "kind", "bytes", "last_used")
    return assets.lru_evict(slots, 1_000_000).select("id", "kind", "bytes")


@query(
    "export_winner",
    """SELECT name, root, ordinal, id, source FROM (SELECT *, row_number() OVER (PARTITION BY name
         ORDER BY root DESC, ordinal DESC) AS rn FROM clashing) f WHERE rn = 1""",
)
def _(fx):
    return export.export_winner(clashing(fx))


@query(
    "progress_monotonic",
    """SELECT job, event_id, done, max(done) OVER (PARTITION BY job ORDER BY event_id
         ROWS UNBOUNDED PRECEDING) AS shown FROM progress_ticks""",
)
def _(fx):
    return stats.progress_monotonic(fx.progress_ticks)


# --- null groups and sparse ids, in both size regimes ------------------------

# Limits under which every group is larger than a window may be.
_RANGED = {"photocat.maxWindowRows": 1, "photocat.blockRows": 16, "photocat.rangeRows": 400}


def both_regimes(name, sql):
    """Registers the query as it is, and once more as for groups too large for a window."""

    def register(fn):
        def ranged(fx):
            with ExitStack() as settings:
                for key, value in _RANGED.items():
                    settings.enter_context(scoped_setting(fx.spark, key, str(value)))
                return fn(fx)

        query(name, sql)(fn)
        query(f"{name}_ranged", sql)(ranged)
        return fn

    return register


@both_regimes(
    "progress_sparse_null_job",
    """SELECT CASE WHEN event_id % 3 <> 0 THEN job END AS job, event_id * 1000003 AS event_id, done,
         max(done) OVER (PARTITION BY CASE WHEN event_id % 3 <> 0 THEN job END ORDER BY event_id
           ROWS UNBOUNDED PRECEDING) AS shown FROM progress_ticks""",
)
def _(fx):
    ticks = fx.progress_ticks.withColumns(
        {"job": F.when(F.col("event_id") % 3 != 0, F.col("job")), "event_id": F.col("event_id") * 1000003}
    )
    return stats.progress_monotonic(ticks)


@both_regimes(
    "ordered_view_null_root",
    """SELECT CASE WHEN root <> '/cards/c3' THEN root END AS root, id, pos FROM view_name""",
)
def _(fx):
    rows = fx.photos.where("status <> 3").withColumn(
        "root", F.when(F.col("root") != "/cards/c3", F.col("root"))
    )
    return views.ordered_view(rows, LABELED).select("root", "id", "pos")


@both_regimes(
    "lru_evict_null_tier",
    _EVICT.format(part="PARTITION BY CASE kind WHEN 'thumb' THEN kind END").replace(
        "SELECT id, kind, bytes", "SELECT id, CASE kind WHEN 'thumb' THEN kind END AS tier, bytes"
    ),
)
def _(fx):
    slots = fx.cache_files.select("id", "kind", "bytes", "last_used").withColumn(
        "tier", F.when(F.col("kind") == "thumb", F.col("kind"))
    )
    return assets.lru_evict(slots, 1_000_000, ["tier"]).select("id", "tier", "bytes")


@both_regimes(
    "batch_accounting_sparse",
    """SELECT b.job, b.generation, b.enqueued,
         count(*) FILTER (WHERE j.fresh AND j.kind = 'Ingested') AS ingested,
         count(*) FILTER (WHERE j.fresh AND j.kind = 'Failed') AS failed,
         count(*) FILTER (WHERE NOT j.fresh) AS dropped,
         count(j.event_id) = b.enqueued AS finished
       FROM ingest_batches b LEFT JOIN judged j ON b.job = j.job AND b.generation = j.generation
       GROUP BY b.job, b.generation, b.enqueued""",
)
def _(fx):
    sparse = lambda name: (F.col(name) * 1000003).alias(name)
    events = fx.ingest_events.withColumn("event_id", sparse("event_id"))
    batches = fx.ingest_batches.withColumn("started_event_id", sparse("started_event_id"))
    return stats.batch_accounting(events, batches)


# --- sorts -------------------------------------------------------------------


@query("sort_filename", "SELECT root, id, pos FROM view_name")
def _(fx):
    rows = fx.photos.where("status <> 3 AND label <> 0")
    return rank_rows(rows, ["root"], views.sort_filename()).select("root", "id", "pos")


@query("sort_taken_at", "SELECT root, id, taken_at, pos FROM view_time")
def _(fx):
    view = culled_view(fx.photos, sort="taken_at")
    return view.select("root", "id", "taken_at", "pos")


@query(
    "path_order",
    """SELECT root, rel_path, row_number() OVER (PARTITION BY root ORDER BY string_split(rel_path, '/')) - 1 AS pos
       FROM listing""",
)
def _(fx):
    rows = fx.listing.select("root", "rel_path")
    return rank_rows(rows, ["root"], views.path_order())


@query(
    "prioritize",
    """SELECT root, id, queue_pos, priority FROM (SELECT *, row_number() OVER (PARTITION BY root
         ORDER BY id IN (SELECT id FROM selection) DESC, queue_pos) - 1 AS priority
       FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY rel_path) - 1 AS queue_pos
             FROM photos WHERE status = 0) q) p""",
)
def _(fx):
    queue = views.queue_positions(fx.photos)
    return views.prioritize(queue, fx.selection, ["root"]).select(
        "root", "id", "queue_pos", F.col("priority_pos").alias("priority")
    )


# --- sets ----------------------------------------------------------------------


@query("select_all", "SELECT id FROM view_name")
def _(fx):
    return selection.select_all(labelled_view(fx))


@query(
    "toggle_selection",
    """SELECT id FROM photos WHERE (id IN (SELECT id FROM selection)) <> (id % 3 = 0)""",
)
def _(fx):
    return selection.toggle_selection(fx.selection, fx.photos.where("id % 3 = 0"))


@query(
    "union_selection",
    "SELECT id FROM photos WHERE id IN (SELECT id FROM selection) OR id % 3 = 0",
)
def _(fx):
    return selection.union_selection(fx.selection, fx.photos.where("id % 3 = 0"))


@query("export_scope", "SELECT root, id, pos FROM scope")
def _(fx):
    scope = export.export_scope(labelled_view(fx), fx.photos, fx.selection)
    return scope.select("root", "id", "pos")


@query(
    "export_set",
    """SELECT 'all' AS mode, root, ordinal, id, source, name FROM files
       UNION ALL SELECT 'raw', root, ordinal, id, source, name FROM files WHERE ordinal % 2 = 0
       UNION ALL SELECT 'jpeg', root, ordinal, id, source, name FROM files WHERE ordinal % 2 = 1""",
)
def _(fx):
    scope = stage(export.export_scope(labelled_view(fx), fx.photos, fx.selection), "scope")
    parts = [
        export.export_set(scope, export.parse_mode(text)).withColumn("mode", F.lit(mode))
        for mode, text in (("all", "nope"), ("raw", "raw"), ("jpeg", "jpeg"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PLAN = """SELECT root, ordinal, id, source, name, '{dest}/' || name AS dest_path,
  CASE WHEN there AND source = '{dest}/' || name THEN 'skip_same' WHEN there THEN 'overwrite' ELSE 'copy' END AS action,
  rn = 1 AS winner
FROM (SELECT *, name IN (SELECT name FROM dest_files) AS there,
        row_number() OVER (PARTITION BY name ORDER BY root DESC, ordinal DESC) AS rn FROM {files}) f"""


@query("export_plan", _PLAN.format(dest=DEST, files="files"))
def _(fx):
    return planned_export(fx.photos, fx.selection, fx.dest_files, DEST, LABELED)


@query("export_plan_clashing", _PLAN.format(dest="/out", files="clashing"))
def _(fx):
    return export.export_plan(clashing(fx), fx.dest_files, "/out")


# --- scalar functions --------------------------------------------------------------


@query(
    "path_parts",
    r"""SELECT root, rel_path, regexp_extract(rel_path, '([^/]*)$', 1) AS name,
         nullif(lower(regexp_extract(rel_path, '\.([^./]*)$', 1)), '') AS ext,
         regexp_replace(rel_path, '/?[^/]*$', '') AS dir,
         CASE WHEN regexp_extract(rel_path, '([^/]*)$', 1) LIKE '%.%'
           THEN lower(regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\.[^.]*$', '')) END AS stem
       FROM listing""",
)
def _(fx):
    return fx.listing.select(
        "root",
        "rel_path",
        P.file_name("rel_path").alias("name"),
        P.file_ext("rel_path").alias("ext"),
        P.parent_dir("rel_path").alias("dir"),
        P.lowered_stem("rel_path").alias("stem"),
    )


def _one(name, sql, column):
    """Registers a per-photo expression over the header columns."""

    @query(name, sql)
    def _(fx, column=column):
        return fx.exif_raw.select("id", column().alias("value"))


for _name, _source, _column in (
    ("orientation_of", "orientation", E.orientation_of),
    ("camera_of", "camera", E.camera_of),
    ("lens_of", "lens", E.lens_of),
    ("taken_at_of", "taken_at", E.taken_at_of),
    ("shutter_of", "shutter", E.shutter_of),
    ("aperture_of", "aperture", E.aperture_of),
    ("iso_of", "iso", E.iso_of),
    ("focal_mm_of", "focal_mm", E.focal_mm_of),
):
    _one(_name, f"SELECT id, {_source} AS value FROM exif", _column)


@query(
    "format_capture_time",
    r"""SELECT id, regexp_replace(trim(date_time_original), '^([0-9]{4}):([0-9]{2}):([0-9]{2})', '\1-\2-\3') AS a,
         regexp_replace(trim(create_date), '^([0-9]{4}):([0-9]{2}):([0-9]{2})', '\1-\2-\3') AS b FROM exif_raw""",
)
def _(fx):
    return fx.exif_raw.select(
        "id",
        E.format_capture_time("date_time_original").alias("a"),
        E.format_capture_time("create_date").alias("b"),
    )


@query(
    "format_shutter",
    """SELECT id, CASE WHEN s >= 1 THEN CASE WHEN round(s * 10) % 10 = 0
           THEN CAST(CAST(round(s * 10) AS bigint) // 10 AS string) || ' s' ELSE printf('%.1f', round(s * 10) / 10) || ' s' END
         WHEN s > 0 THEN '1/' || CAST(CAST(greatest(round(1 / s), 1) AS bigint) AS string) || ' s' END AS value
       FROM (SELECT id, CASE WHEN focal_n > 0 AND exposure_d > 0 THEN focal_n / exposure_d END AS s FROM exif_raw) x""",
)
def _(fx):
    return fx.exif_raw.select("id", E.format_shutter("focal_n", "exposure_d").alias("value"))


_LE = " || ".join(f"substr(lpad(hex({{0}}), 16, '0'), {2 * i + 1}, 2)" for i in range(7, -1, -1))


@query(
    "asset_hash",
    f"""SELECT id, md5(encode(root) || unhex('00') || encode(rel_path) || unhex('00')
          || unhex({_LE.format('mtime_ns')} || repeat('0', 16) || {_LE.format('size')})) AS hash FROM photos""",
)
def _(fx):
    return fx.photos.select(
        "id", P.asset_hash("root", "rel_path", "mtime_ns", "size").alias("hash")
    )


@query(
    "asset_paths",
    "SELECT id, kind, 'previews/' || hash || '.jpg' AS preview, 'thumbs/' || hash || '.jpg' AS thumb FROM cache_files",
)
def _(fx):
    return fx.cache_files.select(
        "id", "kind", P.preview_path("hash").alias("preview"), P.thumb_path("hash").alias("thumb")
    )


@query(
    "mtime_codec",
    """SELECT id, CAST(make_timestamp(mtime_ns // 1000) AS timestamp) AS at, (mtime_ns // 1000) * 1000 AS back FROM photos""",
)
def _(fx):
    at = P.mtime_timestamp("mtime_ns")
    return fx.photos.select(
        "id",
        F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")).alias("at"),
        P.timestamp_mtime(at).alias("back"),
    )


_SWAP = "((orientation BETWEEN 5 AND 8) <> (rot_cw % 2 = 1))"
_KNOWN = "width IS NOT NULL AND height IS NOT NULL"


@query(
    "display_pixels",
    f"""SELECT id, CASE WHEN {_KNOWN} THEN CASE WHEN {_SWAP} THEN height ELSE width END END AS shown_width,
          CASE WHEN {_KNOWN} THEN CASE WHEN {_SWAP} THEN width ELSE height END END AS shown_height FROM photos""",
)
def _(fx):
    wide, high = D.display_pixels()
    return fx.photos.select("id", wide.alias("shown_width"), high.alias("shown_height"))


@query(
    "display_aspect",
    f"""SELECT id, CASE WHEN {_KNOWN} AND width > 0 AND height > 0
          THEN CASE WHEN {_SWAP} THEN height / width ELSE width / height END ELSE 1.5 END AS aspect FROM photos""",
)
def _(fx):
    return fx.photos.select("id", D.display_aspect().alias("aspect"))


@query(
    "effective_orientation",
    """SELECT id, CAST(CASE WHEN orientation IN (1, 6, 3, 8)
         THEN list_extract([1, 6, 3, 8], 1 + (list_position([1, 6, 3, 8], orientation) - 1 + rot_cw) % 4)
         ELSE list_extract([2, 7, 4, 5], 1 + (list_position([2, 7, 4, 5], orientation) - 1 + rot_cw) % 4) END AS int) AS flag
       FROM photos""",
)
def _(fx):
    return fx.photos.select("id", D.effective_orientation().alias("flag"))


@query(
    "turned",
    "SELECT event_id, CAST(((event_id % 7 + delta) % 4 + 4) % 4 AS int) AS rot_cw FROM "
    "(SELECT event_id, delta FROM rotation_events) r",
)
def _(fx):
    return fx.rotation_events.select(
        "event_id", D.turned(F.col("event_id") % 7, "delta").alias("rot_cw")
    )


@query(
    "label_name",
    "SELECT id, list_extract(['unlabeled', 'red', 'yellow', 'green', 'blue', 'purple'], label + 1) AS label FROM photos",
)
def _(fx):
    return fx.photos.select("id", D.label_name().alias("label"))


@query(
    "status_name",
    "SELECT id, list_extract(['pending', 'ok', 'error', 'missing'], status + 1) AS status FROM photos",
)
def _(fx):
    return fx.photos.select("id", D.status_name().alias("status"))


def _trim_sql(c):
    return (
        f"CASE WHEN abs({c} - round({c})) < 0.05 THEN CAST(CAST(round({c}) AS bigint) AS string)"
        f" ELSE printf('%.1f', {c}) END"
    )


@query("trim_number", f"SELECT id, {_trim_sql('focal_mm')} AS focal, {_trim_sql('aperture')} AS f FROM exif")
def _(fx):
    return E.normalize_exif(fx.exif_raw, "id").select(
        "id", D.trim_number("focal_mm").alias("focal"), D.trim_number("aperture").alias("f")
    )


@query(
    "exif_line",
    f"""SELECT id, CASE WHEN coalesce(camera, lens, CAST(aperture AS string), shutter, CAST(iso AS string),
            CAST(focal_mm AS string), taken_at) IS NULL THEN regexp_extract(rel_path, '([^/]*)$', 1)
          ELSE concat_ws(' · ', camera, lens, 'f/' || {_trim_sql('aperture')}, shutter, 'ISO ' || CAST(iso AS string),
            {_trim_sql('focal_mm')} || 'mm', taken_at) END AS line
        FROM (SELECT id, rel_path, camera, lens, shutter, taken_at, iso, aperture, focal_mm FROM photos WHERE id % 19 <> 4
              UNION ALL SELECT id, rel_path, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM photos WHERE id % 19 = 4) p""",
)
def _(fx):
    names = ("camera", "lens", "shutter", "taken_at", "iso", "aperture", "focal_mm")
    blanked = fx.photos.withColumns({c: F.when(F.col("id") % 19 != 4, F.col(c)) for c in names})
    return blanked.select("id", D.exif_line().alias("line"))


@query("bounded_error", "SELECT id, substring(repeat(rel_path, 30), 1, 400) AS message FROM photos")
def _(fx):
    return fx.photos.select("id", D.bounded_error(F.repeat("rel_path", F.lit(30))).alias("message"))


@query("normalize_exif", "SELECT * FROM exif")
def _(fx):
    return E.normalize_exif(fx.exif_raw, "id")


# --- user code ----------------------------------------------------------------------


def _job_functions():
    """A stub extractor: names decide what can be read."""

    def read_header(root, rel_path):
        if "4.NEF" in rel_path:
            raise ValueError("header is damaged in " + rel_path)
        return {"make": " Acme ", "model": rel_path.rsplit(".", 1)[1], "orientation": 6, "iso_ratings": 200}

    def preview(root, rel_path):
        if rel_path.endswith("CR3"):
            raise RuntimeError("no preview")
        return None if "7." in rel_path else (6000, 4000)

    def thumbnail(root, rel_path):
        return (160, 120) if "7.NEF" not in rel_path else None

    return read_header, [preview, thumbnail]


@query(
    "ingest_job",
    """SELECT id, CASE WHEN failure IS NULL THEN 'ok' ELSE 'error' END AS kind, failure AS err_msg,
         CAST(CASE WHEN failure IS NULL THEN CASE WHEN small THEN 160 ELSE 6000 END END AS bigint) AS width,
         CASE WHEN failure IS NULL THEN 'Acme ' || ext END AS camera
       FROM (SELECT id, rel_path LIKE '%CR3' OR rel_path LIKE '%7.%' AS small, regexp_extract(rel_path, '([^.]*)$', 1) AS ext,
               CASE WHEN rel_path LIKE '%4.NEF%' THEN 'header is damaged in ' || rel_path
                    WHEN rel_path LIKE '%7.NEF%' THEN 'no stage returned a preview' END AS failure
             FROM photos WHERE status = 0) p""",
)
def _(fx):
    done = ingest_job(views.pending_queue(fx.photos), *_job_functions())
    return done.select("id", "kind", "err_msg", "width", "camera")


# --- streams -------------------------------------------------------------------------


def _replay(fx, frame, order="event_id"):
    """A stream over the rows of ``frame``, written as several files first."""
    logs = new_path(fx.spark, "log")
    frame.repartitionByRange(4, order).sortWithinPartitions(order).write.parquet(logs)
    return fx.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(logs)


def _updates(fx, stream, mode="update"):
    """Every update a streaming aggregation emits, with its micro-batch number."""
    out = new_path(fx.spark, "out")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _drain(
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", out + "-checkpoint")
    )
    return fx.spark.read.parquet(out)


@query("stream_current_labels", "SELECT id, CAST(label AS int) AS label FROM labels_now")
def _(fx):
    seen = _updates(fx, streaming.stream_current_labels(_replay(fx, fx.label_events)))
    return edits.latest_by_key(seen, ["id"], ["label"], ["batch"])


@query("stream_progress", "SELECT job, max(done) AS done FROM progress_ticks GROUP BY job")
def _(fx):
    seen = _updates(fx, streaming.stream_progress(_replay(fx, fx.progress_ticks)))
    return edits.latest_by_key(seen, ["job"], ["done"], ["batch"])


@query(
    "stream_batch_finished",
    """SELECT e.job, e.generation, count(*) AS done, b.enqueued FROM ingest_events e
       JOIN ingest_batches b ON e.job = b.job AND e.generation = b.generation
       GROUP BY e.job, e.generation, b.enqueued HAVING count(*) = b.enqueued""",
)
def _(fx):
    seen = _updates(fx, streaming.stream_batch_finished(_replay(fx, ingest_log(fx))))
    return seen.drop("batch")


@query(
    "stream_ingest_rate",
    """SELECT job, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS done, count(*) / 60 AS rate
       FROM ingest_events GROUP BY ALL""",
)
def _(fx):
    seen = _updates(fx, streaming.stream_ingest_rate(_replay(fx, fx.ingest_events)))
    return edits.latest_by_key(seen, ["job", "window_start"], ["done", "rate"], ["batch"])


@query(
    "stream_ingest_state",
    """SELECT job, id, arg_max(kind, event_id) AS kind, max(event_id) AS event_id
       FROM judged WHERE fresh GROUP BY job, id""",
)
def _(fx):
    # In no order: results come before their start, and starts after those of later generations.
    log = _replay(fx, ingest_log(fx), F.md5(F.concat_ws("-", "event_id", "kind")))
    return streaming.latest_states(_updates(fx, streaming.stream_ingest_state(log)))


@query(
    "latest_ingest_status",
    """SELECT job, id, arg_max(kind, event_id) AS kind, max(event_id) AS event_id
       FROM judged WHERE fresh GROUP BY job, id""",
)
def _(fx):
    return stats.latest_ingest_status(fx.ingest_events, fx.ingest_batches)


@query(
    "stream_tally",
    _TALLY.format(
        "(SELECT p.root, p.status, coalesce(l.label, p.label) AS label FROM photos p "
        "LEFT JOIN labels_now l ON p.id = l.id) x"
    ),
)
def _(fx):
    photos = stage(fx.photos, "photos")
    return streaming.tally_now(photos, _updates(fx, streaming.stream_tally(_replay(fx, fx.label_events), photos)))


# The index ends as after the batch operator.
SQL["stream_publish_ingest"] = SQL["record_ingest"]


@query("stream_publish_ingest")
def _(fx):
    """All results of a photo arrive in one micro-batch."""
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    _drain(streaming.stream_publish_ingest(_replay(fx, ingest_results(fx), "id"), store, store + "-checkpoint"))
    return read_index(fx.spark, store)


@query(
    "stream_publish_labels",
    """SELECT p.id, p.root, p.rel_path, CAST(coalesce(l.label, p.label) AS int) AS label
       FROM photos p LEFT JOIN labels_now l ON p.id = l.id""",
)
def _(fx):
    store = new_path(fx.spark, "index")
    write_index(fx.photos, store)
    _drain(streaming.stream_publish_labels(_replay(fx, fx.label_events, "id"), store, store + "-checkpoint"))
    return read_index(fx.spark, store).select("id", "root", "rel_path", "label")


@query("stream_sync_two", "SELECT root, rel_path, mtime_ns, size, jpeg_rel_path FROM scan_all")
def _(fx):
    """Two streams, each with its own checkpoint, publish into one store."""
    store = new_path(fx.spark, "index")
    rows = fx.listing.select("root", "rel_path", "mtime_ns", "size")
    for name, part in (("low", "root <= '/cards/c2'"), ("high", "root > '/cards/c2'")):
        arrivals = new_path(fx.spark, name)
        rows.where(part).write.parquet(arrivals)
        listings = fx.spark.readStream.schema(rows.schema).parquet(arrivals)
        _drain(streaming.stream_sync(listings, store, f"{store}-{name}"))
    return read_index(fx.spark, store).select("root", "rel_path", "mtime_ns", "size", "jpeg_rel_path")


@query("stream_sync", "SELECT root, rel_path, mtime_ns, size, jpeg_rel_path FROM scan_all")
def _(fx):
    arrivals, store = new_path(fx.spark, "arrivals"), new_path(fx.spark, "index")
    rows = fx.listing.select("root", "rel_path", "mtime_ns", "size")
    # The same listing arrives twice, each time as the files of one micro-batch; the second sync must change nothing.
    for _ in range(2):
        rows.write.mode("append").parquet(arrivals)
        listings = fx.spark.readStream.schema(rows.schema).parquet(arrivals)
        _drain(streaming.stream_sync(listings, store, store + "-checkpoint"))
    return read_index(fx.spark, store).select(
        "root", "rel_path", "mtime_ns", "size", "jpeg_rel_path"
    )
