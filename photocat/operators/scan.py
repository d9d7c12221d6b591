"""Directory listings to paired photo rows."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.functions import paths as P
from photocat.operators.joins import lookup


def visible_files(listing: DataFrame) -> DataFrame:
    """Drops files with a dot-prefixed component below the root."""
    return listing.where(P.is_visible("rel_path"))


def depth_filter(listing: DataFrame, recursive: bool = False) -> DataFrame:
    """Direct children of the root only, unless ``recursive``."""
    return listing if recursive else listing.where(P.is_direct_child("rel_path"))


def raw_files(listing: DataFrame, raw_exts=P.RAW_EXTENSIONS) -> DataFrame:
    return listing.where(P.file_ext("rel_path").isin(*raw_exts))


def jpeg_files(listing: DataFrame) -> DataFrame:
    return listing.where(P.file_ext("rel_path").isin(*P.JPEG_EXTENSIONS))


# Columns a scan is partitioned by, next to the root.
PAIR_KEYS = ("_dir", "_stem")


def pair_raw_jpeg(
    files: DataFrame, raw_exts=P.RAW_EXTENSIONS, keep_keys: bool = False
) -> DataFrame:
    """RAW rows with the companion JPEG of the same directory and stem.

    Several JPEGs: the smallest path is taken.  Several RAWs of one stem: the
    smallest path gets the JPEG.  JPEGs themselves disappear.  RAWs and JPEGs
    share one shuffle on (root, directory, stem); a file system holds at most
    a few spellings of one stem, so these groups stay small.  ``keep_keys``
    leaves the partitioning columns in the result, for a join that reuses the
    shuffle and, thanks to the window's order, the sort.
    """
    w = (
        W.partitionBy("root", *PAIR_KEYS)
        .orderBy("rel_path")
        .rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    path, raw = F.col("rel_path"), F.col("_raw")
    paired = (
        files.withColumn("_ext", P.file_ext("rel_path"))
        .where(F.col("_ext").isin(*raw_exts, *P.JPEG_EXTENSIONS))
        .withColumns(
            {
                "_raw": F.col("_ext").isin(*raw_exts),
                "_dir": P.parent_dir("rel_path"),
                "_stem": P.lowered_stem("rel_path"),
            }
        )
        .withColumns({"_raw_path": F.when(raw, path), "_jpeg_path": F.when(~raw, path)})
        .withColumns({"_first": F.min("_raw_path").over(w), "_jpeg": F.min("_jpeg_path").over(w)})
        .where("_raw")
        .withColumn("jpeg_rel_path", F.when(path == F.col("_first"), F.col("_jpeg")))
        .drop("_ext", "_raw", "_raw_path", "_jpeg_path", "_first", "_jpeg")
    )
    return paired if keep_keys else paired.drop(*PAIR_KEYS)


def scan(
    listing: DataFrame,
    recursive: bool = False,
    raw_exts=P.RAW_EXTENSIONS,
    roots: DataFrame | None = None,
    keep_keys: bool = False,
) -> DataFrame:
    """The scan: visible files in depth scope, RAW only, companions attached.

    ``roots(root, recursive)`` limits the scan to those roots, each with its
    own depth; without it every root is scanned with ``recursive``.
    """
    files = visible_files(listing.select("root", "rel_path", "mtime_ns", "size"))
    if roots is None:
        files = depth_filter(files, recursive)
    else:
        files = (
            lookup(files, roots, ["root"], "inner")
            .where(F.col("recursive") | P.is_direct_child("rel_path"))
            .drop("recursive")
        )
    return pair_raw_jpeg(files, raw_exts, keep_keys)


def sorted_scan(scanned: DataFrame) -> DataFrame:
    """Rows in path order within each root (range-partitioned global sort)."""
    return scanned.orderBy("root", P.path_key("rel_path"))
