"""EXIF header columns to clean exposure metadata, as built-in expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions.paths import _col

# Code points with the Unicode White_Space property.
_WHITESPACE_CODES = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, _WHITESPACE_CODES))


def trimmed(c) -> Column:
    """Strips Unicode white space from both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _text(c) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def _ratio(n, d) -> Column:
    return F.try_divide(_col(n).cast("double"), _col(d).cast("double"))


def _positive(value: Column) -> Column:
    return F.when((value > 0) & (value < F.lit(float("inf"))), value)


def _tenths(value: Column) -> Column:
    return F.round(value * 10) / 10


def orientation_of(orientation="orientation") -> Column:
    value = _col(orientation)
    return F.when(value.between(1, 8), value).otherwise(F.lit(1)).cast("int")


def camera_of(make="make", model="model") -> Column:
    return F.nullif(F.concat_ws(" ", _text(make), _text(model)), F.lit(""))


def lens_of(lens_model="lens_model", lens_name="lens_name") -> Column:
    return F.coalesce(_text(lens_model), _text(lens_name))


def format_capture_time(raw) -> Column:
    """``2024:05:01 12:33:44`` to ``2024-05-01 12:33:44``; other text is only trimmed."""
    return F.regexp_replace(
        trimmed(raw), "^([0-9]{4}):([0-9]{2}):([0-9]{2})", "$1-$2-$3"
    )


def taken_at_of(original="date_time_original", created="create_date") -> Column:
    """The original stamp wins whenever it is present, even when blank."""
    return format_capture_time(F.coalesce(_col(original), _col(created)))


def format_seconds(seconds: Column) -> Column:
    """``1/250 s`` below one second, ``2.5 s`` or ``30 s`` from one second up.

    One decimal digit leaves one dot, so dropping ``.0`` only affects whole
    seconds.  Zero, negative, infinite and undefined values give null.
    """
    tenths = F.least(_tenths(seconds), F.lit(float(2**64))).cast("decimal(38,1)")
    long_text = F.replace(tenths.cast("string"), F.lit(".0"), F.lit(""))
    reciprocal = F.greatest(F.round(F.lit(1.0) / seconds), F.lit(1.0)).cast("bigint")
    return F.when(
        (seconds >= 1) & (seconds < F.lit(float("inf"))), F.concat(long_text, F.lit(" s"))
    ).when(
        (seconds > 0) & (seconds < 1),
        F.concat(F.lit("1/"), reciprocal.cast("string"), F.lit(" s")),
    )


def format_shutter(n, d) -> Column:
    return format_seconds(_ratio(n, d))


def shutter_of(
    exposure_n="exposure_n",
    exposure_d="exposure_d",
    apex_n="apex_shutter_n",
    apex_d="apex_shutter_d",
    apex_is_seconds: bool = False,
) -> Column:
    """Exposure time when present (even when it formats to null), else APEX.

    An APEX shutter value ``x`` means ``2^-x`` seconds.  With
    ``apex_is_seconds=True`` the value is taken as seconds directly, for
    catalogs whose stored texts were produced that way.
    """
    apex = _ratio(apex_n, apex_d)
    seconds = F.when(_col(exposure_n).isNotNull(), _ratio(exposure_n, exposure_d)).otherwise(
        apex if apex_is_seconds else F.pow(F.lit(2.0), -apex)
    )
    return format_seconds(seconds)


def aperture_of(
    fnumber_n="fnumber_n",
    fnumber_d="fnumber_d",
    apex_n="apex_aperture_n",
    apex_d="apex_aperture_d",
) -> Column:
    """F-number in tenths; an unusable one falls through to APEX ``2^(x/2)``."""
    direct = _positive(_ratio(fnumber_n, fnumber_d))
    apex = _positive(F.pow(F.lit(2.0), _positive(_ratio(apex_n, apex_d)) / 2))
    return F.coalesce(_tenths(direct), _tenths(apex))


def iso_of(ratings="iso_ratings", speed="iso_speed", index="rei") -> Column:
    """First rating present; a zero there means unknown and does not fall through."""
    value = F.coalesce(*[_col(c).cast("bigint") for c in (ratings, speed, index)])
    return F.when(value > 0, value)


def focal_mm_of(n="focal_n", d="focal_d") -> Column:
    return _positive(_ratio(n, d))


def normalize_exif(df: DataFrame, *keep: str) -> DataFrame:
    """Raw header columns to ingest columns; ``keep`` names columns to carry over."""
    return df.select(
        *keep,
        F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        orientation_of().alias("orientation"),
        camera_of().alias("camera"),
        lens_of().alias("lens"),
        taken_at_of().alias("taken_at"),
        shutter_of().alias("shutter"),
        aperture_of().alias("aperture"),
        iso_of().alias("iso"),
        focal_mm_of().alias("focal_mm"),
    )
