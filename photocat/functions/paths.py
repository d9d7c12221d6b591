"""Path, extension and content-key expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# RAW extensions that take part in a scan.
RAW_EXTENSIONS = (
    "3fr", "ari", "arw", "bay", "cr2", "cr3", "crw", "dcr", "dng", "erf", "fff",
    "iiq", "kdc", "mef", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2",
    "rwl", "sr2", "srw", "x3f",
)
# Companion extensions; these files are never photos themselves.
JPEG_EXTENSIONS = ("jpg", "jpeg")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower-cases A-Z only; accented letters keep their case."""
    return F.translate(_col(c), _UPPER, _UPPER.lower())


def file_name(path) -> Column:
    """Last path component."""
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path) -> Column:
    """Everything above the last component; empty at the top level."""
    path = _col(path)
    cut = F.length(path) - F.length(file_name(path)) - F.lit(1)
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def file_ext(path) -> Column:
    """Lower-cased text after the last dot of the name; null without a dot."""
    name = file_name(path)
    return F.when(F.contains(name, F.lit(".")), ascii_lower(F.substring_index(name, ".", -1)))


def lowered_stem(path) -> Column:
    """ASCII-lowered name before the last dot; null without a dot."""
    name = file_name(path)
    keep = F.length(name) - F.length(F.substring_index(name, ".", -1)) - F.lit(1)
    return F.when(
        F.contains(name, F.lit(".")), ascii_lower(F.substring(name, F.lit(1), keep))
    )


def is_visible(path) -> Column:
    """No component below the root starts with a dot."""
    path = _col(path)
    return ~(path.startswith(".") | path.contains("/."))


def is_direct_child(path) -> Column:
    return ~_col(path).contains("/")


def path_key(path) -> Column:
    """Sort key giving component-wise path order with plain string comparison.

    A separator must sort below every other character so that ``a/b`` comes
    before ``a-b``.  No file name contains NUL, so replacing the separator by
    NUL orders exactly like comparing the component arrays, while keeping
    Spark's 8-byte string sort prefix.
    """
    return F.replace(_col(path), F.lit("/"), F.lit("\x00"))


def _little_endian_hex(value: Column) -> Column:
    big = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in range(7, -1, -1)])


def asset_hash(root, rel_path, mtime_ns, size) -> Column:
    """Content key of a photo: md5 over its identity tuple.

    Layout: root, NUL, relative path, NUL, mtime as 16 little-endian bytes
    (times before the epoch count as 0), size as 8 little-endian bytes.
    """
    mtime = F.greatest(_col(mtime_ns), F.lit(0).cast("bigint"))
    tail = F.unhex(
        F.concat(_little_endian_hex(mtime), F.lit("0" * 16), _little_endian_hex(_col(size)))
    )
    nul = F.unhex(F.lit("00"))
    return F.md5(
        F.concat(
            F.encode(_col(root), "UTF-8"), nul, F.encode(_col(rel_path), "UTF-8"), nul, tail
        )
    )


def preview_path(hash_col) -> Column:
    return F.concat(F.lit("previews/"), _col(hash_col), F.lit(".jpg"))


def thumb_path(hash_col) -> Column:
    return F.concat(F.lit("thumbs/"), _col(hash_col), F.lit(".jpg"))


def mtime_timestamp(mtime_ns) -> Column:
    """Display timestamp (microseconds, rounded down) of a nanosecond mtime."""
    ns = _col(mtime_ns)
    whole = ns - F.pmod(ns, F.lit(1000))
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))


def timestamp_mtime(ts) -> Column:
    """Signed nanoseconds of a timestamp, saturating at the bigint range."""
    micros = F.unix_micros(_col(ts)).cast("decimal(20,0)") * F.lit(1000)
    top, bottom = 9223372036854775807, -9223372036854775807
    return (
        F.least(F.greatest(micros, F.lit(bottom).cast("decimal(20,0)")), F.lit(top).cast("decimal(20,0)"))
        .cast("bigint")
    )

