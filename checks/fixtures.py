"""Photo-shaped inputs derived from the driver tables, for Spark and as SQL."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.session import stage


EXTS = ("nef", "cr3", "arw", "dng", "raf")


class Fixtures:
    """The views over one scale-factor folder; each is built on first use.

    ``written=True`` writes every view as a parquet table first and reads that,
    which is how a catalog user holds these inputs; the bench uses it so that
    it times operators and not the derivation of their inputs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, written: bool = False):
        self.spark, self.sf_dir, self.written, self._made = spark, sf_dir, written, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Uses every core when a table is a single small file; else leaves it alone."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if len(df.inputFiles()) > 1 else df.repartition(cores, key)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            view = VIEWS[name](self)
            self._made[name] = stage(view, name) if self.written else view
        return self._made[name]


def listing(fx):
    def kind(k, every):
        return F.when(F.col("o_orderkey") % every == 0, F.lit(k))

    kinds = F.array_compact(
        F.array(F.lit(0), kind(1, 3), kind(2, 30), kind(3, 42), kind(4, 50), kind(5, 10), kind(6, 100))
    )
    orders = fx.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return (
        fx.spread(orders, "o_orderkey")
        .selectExpr(
            "o_orderkey",
            "o_totalprice",
            "'/cards/c' || CAST(o_custkey % 7 AS string) AS root",
            "CASE WHEN o_orderkey % 40 = 3 THEN '.trash/' WHEN o_orderkey % 4 = 0 THEN ''"
            " WHEN o_orderkey % 4 = 1 THEN 'day1/' WHEN o_orderkey % 4 = 2 THEN 'day1-b/'"
            " ELSE 'day2/sub/' END AS dir",
            "CASE WHEN o_orderkey % 7 = 0 THEN '_MG_' ELSE 'IMG_' END"
            " || lpad(CAST(o_orderkey AS string), 8, '0') AS stem",
        )
        .withColumn("k", F.explode(kinds))
        .selectExpr(
            "root",
            "dir || CASE k WHEN 0 THEN stem || '.' || CASE o_orderkey % 6 WHEN 0 THEN 'NEF'"
            " WHEN 1 THEN 'CR3' WHEN 2 THEN 'arw' WHEN 3 THEN 'Dng' WHEN 4 THEN 'gpr' ELSE 'RAF' END"
            " WHEN 1 THEN lower(stem) || '.JPG' WHEN 2 THEN stem || '.jpeg' WHEN 3 THEN stem || '.DNG'"
            " WHEN 4 THEN '.' || stem || '.NEF' WHEN 5 THEN stem || '.txt' ELSE stem END AS rel_path",
            "1600000000000000000 + o_orderkey * 1000000007 AS mtime_ns",
            "CAST(floor(o_totalprice * 100) AS bigint) + k AS size",
            "o_orderkey",
        )
    )


def photos_index(fx):
    gone = F.array_compact(F.array(F.lit(0), F.when(F.col("o_orderkey") % 17 == 0, F.lit(1))))
    return (
        fx.listing.where(
            "lower(rel_path) NOT LIKE '%.jp%g' AND rel_path NOT LIKE '%.txt' AND rel_path LIKE '%.%'"
            " AND rel_path NOT LIKE '%.DNG' AND rel_path NOT LIKE '.%' AND rel_path NOT LIKE '%/.%'"
            " AND rel_path NOT LIKE '%.gpr' AND o_orderkey % 9 <> 0"
        )
        .withColumn("g", F.explode(gone))
        .selectExpr(
            "o_orderkey * 2 + g + 1 AS id",
            "root",
            "CASE WHEN g = 1 THEN 'GONE_' || CAST(o_orderkey AS string) || '.NEF' ELSE rel_path END AS rel_path",
            "mtime_ns - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS mtime_ns",
            "size + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS size",
            "CASE WHEN o_orderkey % 23 = 0 THEN 3 WHEN o_orderkey % 10 = 1 THEN 2"
            " WHEN o_orderkey % 10 IN (2, 3) THEN 0 ELSE 1 END AS status",
            "CAST(o_orderkey % 6 AS int) AS label",
            "CAST(o_orderkey % 4 AS int) AS rot_cw",
            "CASE WHEN o_orderkey % 19 = 0 THEN 'old.jpg' END AS jpeg_rel_path",
        )
    )


def photos(fx):
    """The index with every stored column filled, some of them null."""
    return fx.photos_index.selectExpr(
        "id", "root", "rel_path", "mtime_ns", "size",
        "CASE WHEN id % 20 = 1 THEN NULL ELSE 4000 + id % 3 * 1000 END AS width",
        "CASE WHEN id % 25 = 1 THEN NULL ELSE 3000 + id % 2 * 1000 END AS height",
        "CAST(1 + id % 8 AS int) AS orientation", "rot_cw",
        "CASE WHEN id % 4 <> 3 THEN 'Camera ' || CAST(id % 5 AS string) END AS camera",
        "CASE WHEN id % 6 <> 5 THEN 'Lens ' || CAST(id % 3 AS string) END AS lens",
        "CASE WHEN id % 7 <> 2 THEN '2024-05-' || lpad(CAST(1 + id % 28 AS string), 2, '0') || ' 10:00:00' END AS taken_at",
        "CASE WHEN id % 9 <> 4 THEN '1/250 s' END AS shutter",
        "CASE WHEN id % 8 <> 5 THEN CAST(10 + id % 30 AS double) / 10 END AS aperture",
        "CASE WHEN id % 10 <> 3 THEN 100 * (1 + id % 12) END AS iso",
        "CASE WHEN id % 11 <> 7 THEN CAST(id % 600 AS double) / 4 END AS focal_mm",
        "label", "status",
        "CASE WHEN status = 2 THEN 'cannot read ' || rel_path END AS err_msg",
        "CASE WHEN status = 1 THEN 'previews/' || md5(root || '/' || rel_path) || '.jpg' END AS preview_path",
        "CASE WHEN status = 1 THEN 'thumbs/' || md5(root || '/' || rel_path) || '.jpg' END AS thumb_path",
        "jpeg_rel_path",
        "CASE WHEN status = 1 THEN 1700000000000 + id END AS ingested_at",
    )


def stored_rows(fx):
    """Rows as a damaged index may hold them: codes and sizes out of range."""
    return fx.photos.selectExpr(
        "id", "root", "rel_path", "mtime_ns", "size",
        "CASE WHEN id % 13 = 1 THEN -width WHEN id % 13 = 2 THEN 5000000000 ELSE width END AS width",
        "CASE WHEN id % 17 = 1 THEN -height ELSE height END AS height",
        "CAST(CASE WHEN id % 10 = 1 THEN 70000 WHEN id % 10 = 3 THEN -2 ELSE orientation END AS int) AS orientation",
        "CAST(rot_cw + CASE WHEN id % 5 = 1 THEN 7 WHEN id % 5 = 2 THEN -9 ELSE 0 END AS int) AS rot_cw",
        "camera", "lens", "taken_at", "shutter", "aperture",
        "CASE WHEN id % 14 = 1 THEN -iso WHEN id % 14 = 3 THEN 5000000000 ELSE iso END AS iso", "focal_mm",
        "CAST(CASE WHEN id % 11 = 1 THEN 9 WHEN id % 11 = 2 THEN -1 ELSE label END AS int) AS label",
        "CAST(CASE WHEN id % 15 = 1 THEN 4 WHEN id % 15 = 3 THEN -3 ELSE status END AS int) AS status",
        "err_msg", "preview_path", "thumb_path", "jpeg_rel_path", "ingested_at",
    )


def exif_raw(fx):
    orders = fx.spread(fx.table("orders").select("o_orderkey"), "o_orderkey")
    return orders.selectExpr(
        "o_orderkey * 2 + 1 AS id",
        "CASE o_orderkey % 5 WHEN 0 THEN ' Canon ' WHEN 1 THEN 'NIKON CORPORATION' WHEN 2 THEN 'SONY'"
        " WHEN 3 THEN '' ELSE '  ' END AS make",
        "CASE o_orderkey % 4 WHEN 0 THEN 'R5 ' WHEN 1 THEN 'Z 8' WHEN 2 THEN '' ELSE 'ILCE-7M4' END AS model",
        "CASE o_orderkey % 3 WHEN 0 THEN ' RF 24-70mm ' WHEN 1 THEN '' END AS lens_model",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Detected 50mm' END AS lens_name",
        "CAST(CASE o_orderkey % 11 WHEN 10 THEN NULL ELSE o_orderkey % 11 END AS int) AS orientation",
        "CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN ' unknown '"
        " ELSE '2024:05:' || lpad(CAST(1 + o_orderkey % 28 AS string), 2, '0') || ' 12:33:44' END AS date_time_original",
        "CASE WHEN o_orderkey % 16 = 0 THEN '2023:01:02' END AS create_date",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 40 ELSE 1 END END AS exposure_n",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE o_orderkey % 8000 END END AS exposure_d",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 12 END AS apex_shutter_n",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 END AS apex_shutter_d",
        "CASE WHEN o_orderkey % 3 <> 0 THEN 14 + o_orderkey % 200 END AS fnumber_n",
        "CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 4) * 10 END AS fnumber_d",
        "CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 900 END AS apex_aperture_n",
        "CASE WHEN o_orderkey % 4 <> 1 THEN 100 END AS apex_aperture_d",
        "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9) * 100 END AS iso_ratings",
        "CASE WHEN o_orderkey % 3 = 1 THEN 3200 END AS iso_speed",
        "CASE WHEN o_orderkey % 2 = 0 THEN 100 END AS rei",
        "o_orderkey % 600 AS focal_n",
        "o_orderkey % 5 AS focal_d",
        "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 6000 END AS width",
        "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 4000 END AS height",
    )


_LABEL_CASE = (
    "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3"
    " WHEN 'signup' THEN 4 ELSE 0 END AS label"
)
_GENERATION = (
    "CAST(greatest(floor(event_id / 100.0) - CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END, 0) AS bigint) AS generation"
)
_KIND = "CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Ingested' END AS kind"


def to_label_events(events):
    return events.selectExpr("event_id", "ts", "user_id * 2 + 1 AS id", _LABEL_CASE)


def to_rotation_events(events):
    return events.selectExpr(
        "event_id", "ts", "user_id * 2 + 1 AS id", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta"
    )


def to_ingest_events(events):
    return events.selectExpr(
        "event_id", "ts", "'job' || CAST(user_id % 3 AS string) AS job", _GENERATION,
        "user_id * 2 + 1 AS id", _KIND,
    )


def ingest_batches(fx):
    return fx.ingest_events.groupBy("job", "generation").agg(F.count("*").alias("n")).selectExpr(
        "job", "generation", "generation * 100 AS started_event_id",
        "n + CASE WHEN generation % 4 = 0 THEN 1 ELSE 0 END AS enqueued",
    )


def progress_ticks(fx):
    """Progress per job as it might arrive: every fifth tick reports an older count."""
    return fx.ingest_events.selectExpr(
        "job", "event_id", "event_id - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END AS done"
    )


def root_opens(fx):
    return fx.table("events").selectExpr(
        "'/cards/c' || CAST(user_id % 7 AS string) AS path", "event_id * 1000 AS opened_at"
    )


def scanned_roots(fx):
    return (
        fx.photos_index.where("root <> '/cards/c5'").select("root").distinct()
        .withColumn("recursive", F.col("root") != "/cards/c3")
    )


def selection(fx):
    """Selected ids; card c2 has none."""
    return fx.photos_index.where("id % 5 = 0 AND root <> '/cards/c2'").select("id")


def dest_files(fx):
    return (
        fx.listing.where("o_orderkey % 25 = 0")
        .select(F.substring_index("rel_path", "/", -1).alias("name"))
        .distinct()
    )


def cache_files(fx):
    kinds = F.explode(F.array(F.lit("preview"), F.lit("thumb")))
    return fx.photos_index.withColumn("kind", kinds).selectExpr(
        "id", "kind", "md5(root || '/' || rel_path) AS hash",
        "1000 + (id * CASE WHEN kind = 'preview' THEN 31 ELSE 7 END) % 5000 AS bytes",
        "(id * 7919) % 100003 AS last_used",
        "CASE WHEN status = 1 AND id % 12 <> 5 THEN 1 ELSE 0 END AS keep",
    )


def cursors(fx):
    """Anchor and clicked positions, one session per 500 ids; some run past the end."""
    return fx.photos_index.where("id % 500 = 1").selectExpr(
        "root", "id AS session", "id % 997 AS anchor", "id * 7 % 1999 AS clicked"
    )


VIEWS = {
    "listing": listing,
    "photos_index": photos_index,
    "photos": photos,
    "stored_rows": stored_rows,
    "exif_raw": exif_raw,
    "label_events": lambda fx: to_label_events(fx.table("events")),
    "rotation_events": lambda fx: to_rotation_events(fx.table("events")),
    "ingest_events": lambda fx: to_ingest_events(fx.table("events")),
    "ingest_batches": ingest_batches,
    "progress_ticks": progress_ticks,
    "root_opens": root_opens,
    "scanned_roots": scanned_roots,
    "selection": selection,
    "dest_files": dest_files,
    "cache_files": cache_files,
    "cursors": cursors,
}
