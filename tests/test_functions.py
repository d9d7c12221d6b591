"""Scalar rules on hand-written rows."""

import hashlib
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photocat.functions import display as D
from photocat.functions import exif as E
from photocat.functions import paths as P
from photocat.schema import EXIF_RAW_SCHEMA


def values(spark, data, schema, **columns):
    df = spark.createDataFrame(data, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def headers(spark, *dicts):
    names = EXIF_RAW_SCHEMA.names
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], EXIF_RAW_SCHEMA)


def test_shutter_text(spark):
    cases = {
        (1, 250): "1/250 s", (1, 253): "1/253 s", (1, 1): "1 s", (5, 2): "2.5 s",
        (30, 1): "30 s", (0, 250): None, (1, 0): None, (2, 3): "1/2 s", (99, 100): "1/1 s",
        (4294967295, 2): "2147483647.5 s",
    }
    got = values(spark, list(cases), "n bigint, d bigint", v=E.format_shutter("n", "d"))
    assert [g[0] for g in got] == list(cases.values())


def test_shutter_not_a_number_is_null(spark):
    got = values(spark, [(math.nan,), (0.0,), (math.inf,)], "s double", v=E.format_seconds(F.col("s")))
    assert got == [(None,)] * 3


def test_capture_time(spark):
    cases = {
        "2024:05:01 12:33:44": "2024-05-01 12:33:44", "2024:05:01": "2024-05-01",
        "  unknown stamp ": "unknown stamp", "": "", "20240501": "20240501",
        " 2024:05:01　": "2024-05-01",
    }
    got = values(spark, [(k,) for k in cases], "s string", v=E.format_capture_time("s"))
    assert [g[0] for g in got] == list(cases.values())


def test_header_normalisation(spark):
    got = E.normalize_exif(
        headers(
            spark,
            {"make": " Canon ", "model": "EOS R6", "orientation": 6, "iso_ratings": 400, "iso_speed": 3200},
            {"make": "", "model": "  ", "orientation": 9, "iso_speed": 3200, "fnumber_n": 28, "fnumber_d": 10},
            {"model": "X", "iso_speed": 0, "rei": 100, "apex_aperture_n": 197, "apex_aperture_d": 100},
            {"make": "Y", "fnumber_n": 28, "fnumber_d": 0, "apex_aperture_n": 0, "apex_aperture_d": 1},
            {"focal_n": 105, "focal_d": 1, "lens_model": " ", "lens_name": " Zoom "},
            {"focal_n": 0, "focal_d": 1, "lens_model": "A", "lens_name": "B"},
            {"date_time_original": " ", "create_date": "2024:01:02"},
            {"create_date": "2024:01:02", "exposure_n": 0, "exposure_d": 5, "apex_shutter_n": 3, "apex_shutter_d": 1},
            {"apex_shutter_n": 3, "apex_shutter_d": 1},
            {"apex_shutter_n": 3, "apex_shutter_d": 0, "apex_aperture_n": 4000000000, "apex_aperture_d": 1},
        )
    ).collect()
    assert [r.camera for r in got[:4]] == ["Canon EOS R6", None, "X", "Y"]
    assert [r.orientation for r in got[:3]] == [6, 1, 1]
    assert [r.iso for r in got[:3]] == [400, 3200, None]
    assert [r.aperture for r in got[1:4]] == [2.8, 2.0, None]
    assert [r.focal_mm for r in got[4:6]] == [105.0, None]
    assert [r.lens for r in got[4:6]] == ["Zoom", "A"]
    assert [r.taken_at for r in got[6:8]] == ["", "2024-01-02"]
    assert [r.shutter for r in got[7:]] == [None, "1/8 s", None]
    assert got[9].aperture is None


def test_shutter_apex_as_seconds(spark):
    df = headers(spark, {"apex_shutter_n": 5, "apex_shutter_d": 2})
    assert df.select(E.shutter_of(apex_is_seconds=True)).head()[0] == "2.5 s"


def test_path_parts(spark):
    cases = {
        "IMG_1.CR3": ("IMG_1.CR3", "cr3", "", "img_1"),
        "a/b/É.JPEG": ("É.JPEG", "jpeg", "a/b", "É"),
        "a.b/noext": ("noext", None, "a.b", None),
        "x.tar.NEF": ("x.tar.NEF", "nef", "", "x.tar"),
        "end.": ("end.", "", "", "end"),
    }
    got = values(
        spark, [(k,) for k in cases], "p string",
        name=P.file_name("p"), ext=P.file_ext("p"), dir=P.parent_dir("p"), stem=P.lowered_stem("p"),
    )
    assert got == list(cases.values())


def test_kelvin_sign_is_not_an_ascii_k(spark):
    got = values(spark, [("a.KDC",), ("a.KDC",)], "p string", e=P.file_ext("p").isin(*P.RAW_EXTENSIONS))
    assert got == [(False,), (True,)]


def test_asset_hash_layout(spark):
    cases = [
        ("/photos", "IMG_0001.CR3", 1700000000123456789, 42),
        ("/photos", "é/x.nef", -5, 0),
    ]

    def plain(root, rel, mtime, size):
        data = root.encode() + b"\0" + rel.encode() + b"\0"
        return hashlib.md5(data + max(mtime, 0).to_bytes(16, "little") + size.to_bytes(8, "little")).hexdigest()

    got = values(
        spark, cases, "root string, rel string, mtime bigint, size bigint",
        h=P.asset_hash("root", "rel", "mtime", "size"),
    )
    assert [g[0] for g in got] == [plain(*c) for c in cases]
    assert got[0][0] == "124d36bd1703936eb7ae0158dce222d0"


def test_mtime_codec_keeps_microseconds_and_saturates(spark):
    got = values(
        spark, [(1700000000123456789,), (-1500,), (0,)], "ns bigint",
        back=P.timestamp_mtime(P.mtime_timestamp("ns")),
    )
    assert got == [(1700000000123456000,), (-2000,), (0,)]
    far = spark.range(1).select(
        P.timestamp_mtime(F.lit("9999-01-01").cast("timestamp")),
        P.timestamp_mtime(F.lit("0001-01-01").cast("timestamp")),
    ).head()
    assert tuple(far) == (2**63 - 1, -(2**63 - 1))


NAME = st.text(st.characters(codec="utf-8", exclude_characters="\x00/"), min_size=1, max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(NAME, min_size=1, max_size=4), min_size=20, max_size=60))
def test_path_key_orders_like_component_lists(spark, paths):
    paths = {tuple(p) for p in paths} | {("a", "b"), ("a-b",), ("a",), ("a", "b", "c")}
    df = spark.createDataFrame([("/".join(p),) for p in paths], "p string").orderBy(P.path_key("p"))
    want = sorted(paths, key=lambda p: [c.encode() for c in p])
    assert [r.p for r in df.collect()] == ["/".join(p) for p in want]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e7, allow_nan=False), min_size=200, max_size=400))
def test_one_decimal_rounds_exact_ties_to_even(spark, numbers):
    numbers = numbers + [24.25, 24.75, 0.15, 0.25, 0.35, 0.05, 1.45, 2.45, 100.95, 0.95]
    numbers += [n / 20 for n in range(200)] + [math.nextafter(n / 20, 0) for n in range(200)]
    got = values(spark, [(n,) for n in numbers], "v double", t=D.one_decimal("v"))
    assert [g[0] for g in got] == [f"{n:.1f}" for n in numbers]


def test_trim_number(spark):
    cases = {35.0: "35", 2.8: "2.8", 24.5: "24.5", 7.96: "8", 24.25: "24.2", 8.04: "8"}
    got = values(spark, [(k,) for k in cases], "v double", t=D.trim_number("v"))
    assert [g[0] for g in got] == list(cases.values())


LINE = "rel_path string, camera string, lens string, aperture double, shutter string, iso bigint, focal_mm double, taken_at string"


def test_exif_line(spark):
    data = [
        ("a/IMG_0001.CR3", "Canon EOS R6", None, None, "1/250 s", 400, None, None),
        ("IMG_0001.CR3", None, None, 8.0, None, None, 35.0, None),
        ("IMG_0001.CR3", None, None, 2.8, None, None, 24.5, None),
        ("a/IMG_0001.CR3", None, None, None, None, None, None, None),
        ("a/IMG_0001.CR3", None, None, None, None, None, None, ""),
    ]
    got = values(spark, data, LINE, line=D.exif_line())
    assert [g[0] for g in got] == [
        "Canon EOS R6 · 1/250 s · ISO 400", "f/8 · 35mm", "f/2.8 · 24.5mm", "IMG_0001.CR3", "",
    ]


def test_display_size_and_aspect(spark):
    wide, high = D.display_pixels()
    data = [(6000, 4000, 1, 0), (6000, 4000, 6, 0), (6000, 4000, 6, 1), (6000, 4000, 1, 3), (None, 4000, 1, 0), (0, 5, 1, 0), (5, 0, 1, 0)]
    got = values(
        spark, data, "width bigint, height bigint, orientation int, rot_cw int",
        w=wide, h=high, a=D.display_aspect(),
    )
    assert got == [
        (6000, 4000, 1.5), (4000, 6000, 2 / 3), (6000, 4000, 1.5), (4000, 6000, 2 / 3),
        (None, None, 1.5), (0, 5, 1.5), (5, 0, 1.5),
    ]


def _apply(flag, grid):
    """Upright pixels of a 2x2 grid stored under an orientation flag."""
    (a, b), (c, d) = grid
    return {
        1: ((a, b), (c, d)), 2: ((b, a), (d, c)), 3: ((d, c), (b, a)), 4: ((c, d), (a, b)),
        5: ((a, c), (b, d)), 6: ((c, a), (d, b)), 7: ((d, b), (c, a)), 8: ((b, d), (a, c)),
    }[flag]


def test_effective_orientation_on_a_pixel_matrix(spark):
    data = [(flag, turns) for flag in range(1, 9) for turns in range(4)]
    got = values(spark, data, "orientation int, rot_cw int", flag=D.effective_orientation())
    grid = (("A", "B"), ("C", "D"))
    for (flag, turns), (combined,) in zip(data, got):
        shown = _apply(flag, grid)
        for _ in range(turns):
            shown = _apply(6, shown)
        assert shown == _apply(combined, grid)


def test_turns_wrap(spark):
    data = [(0, -1), (3, 1), (1, 1), (7, -1)]
    assert values(spark, data, "c int, d int", t=D.turned("c", "d")) == [(3,), (0,), (2,), (2,)]


def test_code_names(spark):
    got = values(spark, [(0, 0), (5, 3)], "label int, status int", a=D.label_name(), b=D.status_name())
    assert got == [("unlabeled", "pending"), ("purple", "missing")]


def test_error_text_is_bounded_in_characters(spark):
    got = values(spark, [("é" * 500,)], "m string", v=D.bounded_error("m"))
    assert got == [("é" * 400,)]
