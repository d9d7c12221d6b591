"""Schemas, codes and defaults shared by every module."""

from pyspark.sql import types as T

SCHEMA_VERSION = 3

# Label and status codes as they are stored.
LABELS = {0: "unlabeled", 1: "red", 2: "yellow", 3: "green", 4: "blue", 5: "purple"}
LABEL_COUNTS = {code: f"n_{name}" for code, name in LABELS.items()} | {0: "n_none"}
STATUSES = {0: "pending", 1: "ok", 2: "error", 3: "missing"}
PENDING, OK, ERROR, MISSING = 0, 1, 2, 3

# Named label masks (bit n = label code n, 0 = no filtering).
MASK_ALL = 0
MASK_LABELED = 0b111110
MASK_UNLABELED = 0b000001

# Longest error message kept on a row, and the layout default
# for photos whose pixels have not been measured.
MAX_ERROR_CHARS = 400
DEFAULT_ASPECT = 1.5


def _field(name, dtype):
    return T.StructField(name, dtype, True)


# Columns that a successful ingest fills and that a reset clears.
INGEST_FIELDS = [
    _field("width", T.LongType()),
    _field("height", T.LongType()),
    _field("orientation", T.IntegerType()),
    _field("camera", T.StringType()),
    _field("lens", T.StringType()),
    _field("taken_at", T.StringType()),
    _field("shutter", T.StringType()),
    _field("aperture", T.DoubleType()),
    _field("iso", T.LongType()),
    _field("focal_mm", T.DoubleType()),
    _field("preview_path", T.StringType()),
    _field("thumb_path", T.StringType()),
]
INGEST_COLUMNS = [f.name for f in INGEST_FIELDS]

PHOTOS_SCHEMA = T.StructType(
    [
        _field("id", T.LongType()),
        _field("root", T.StringType()),
        _field("rel_path", T.StringType()),
        _field("mtime_ns", T.LongType()),
        _field("size", T.LongType()),
        *INGEST_FIELDS[:3],
        _field("rot_cw", T.IntegerType()),
        *INGEST_FIELDS[3:10],
        _field("label", T.IntegerType()),
        _field("status", T.IntegerType()),
        _field("err_msg", T.StringType()),
        *INGEST_FIELDS[10:],
        _field("jpeg_rel_path", T.StringType()),
        _field("ingested_at", T.LongType()),
    ]
)

# Values of columns that are never null in a stored row.
PHOTO_DEFAULTS = {"orientation": 1, "rot_cw": 0, "label": 0, "status": 0}

LISTING_SCHEMA = T.StructType(
    [
        _field("root", T.StringType()),
        _field("rel_path", T.StringType()),
        _field("mtime_ns", T.LongType()),
        _field("size", T.LongType()),
    ]
)

# One row per finished extraction; kind is "ok" or "error".
INGEST_RESULT_SCHEMA = T.StructType(
    [
        _field("id", T.LongType()),
        _field("kind", T.StringType()),
        *INGEST_FIELDS,
        _field("err_msg", T.StringType()),
        _field("ingested_at", T.LongType()),
    ]
)

# Header columns as a decoder reports them; rationals are numerator (_n) and
# denominator (_d).
EXIF_RAW_SCHEMA = T.StructType(
    [
        _field("make", T.StringType()),
        _field("model", T.StringType()),
        _field("lens_model", T.StringType()),
        _field("lens_name", T.StringType()),
        _field("orientation", T.IntegerType()),
        _field("date_time_original", T.StringType()),
        _field("create_date", T.StringType()),
        _field("exposure_n", T.LongType()),
        _field("exposure_d", T.LongType()),
        _field("apex_shutter_n", T.LongType()),
        _field("apex_shutter_d", T.LongType()),
        _field("fnumber_n", T.LongType()),
        _field("fnumber_d", T.LongType()),
        _field("apex_aperture_n", T.LongType()),
        _field("apex_aperture_d", T.LongType()),
        _field("iso_ratings", T.LongType()),
        _field("iso_speed", T.LongType()),
        _field("rei", T.LongType()),
        _field("focal_n", T.LongType()),
        _field("focal_d", T.LongType()),
        _field("width", T.LongType()),
        _field("height", T.LongType()),
    ]
)

INGEST_EVENT_SCHEMA = T.StructType(
    [
        _field("event_id", T.LongType()),
        _field("ts", T.TimestampNTZType()),
        _field("job", T.StringType()),
        _field("generation", T.LongType()),
        _field("id", T.LongType()),
        _field("kind", T.StringType()),
        _field("enqueued", T.LongType()),
    ]
)

LABEL_EVENT_SCHEMA = T.StructType(
    [
        _field("event_id", T.LongType()),
        _field("ts", T.TimestampNTZType()),
        _field("id", T.LongType()),
        _field("label", T.IntegerType()),
    ]
)
