"""Expressions that turn stored codes and numbers into what is displayed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from photocat.functions.paths import _col, file_name
from photocat.schema import DEFAULT_ASPECT, LABELS, MAX_ERROR_CHARS, STATUSES


def _lookup(names: dict, code) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.element_at(F.create_map(*pairs), _col(code))


def label_name(code="label") -> Column:
    return _lookup(LABELS, code)


def status_name(code="status") -> Column:
    return _lookup(STATUSES, code)


def turned(current, delta) -> Column:
    """Quarter turns after adding ``delta``, wrapped into 0..3."""
    return F.pmod(F.pmod(_col(current), F.lit(4)) + _col(delta), F.lit(4)).cast("int")


def swaps_axes(orientation="orientation", rot_cw="rot_cw") -> Column:
    """Whether display transposes the stored pixels."""
    return _col(orientation).between(5, 8) != (F.pmod(_col(rot_cw), F.lit(2)) == 1)


def display_pixels(width="width", height="height", orientation="orientation", rot_cw="rot_cw"):
    """(width, height) columns as displayed; both null unless both are stored."""
    known = _col(width).isNotNull() & _col(height).isNotNull()
    swap = swaps_axes(orientation, rot_cw)
    wide = F.when(known, F.when(swap, _col(height)).otherwise(_col(width)))
    high = F.when(known, F.when(swap, _col(width)).otherwise(_col(height)))
    return wide, high


def display_aspect(width="width", height="height", orientation="orientation", rot_cw="rot_cw"):
    wide, high = display_pixels(width, height, orientation, rot_cw)
    ratio = F.when(wide > 0, F.try_divide(wide.cast("double"), high.cast("double")))
    return F.coalesce(ratio, F.lit(DEFAULT_ASPECT))


def _turn_table() -> list:
    """Composed orientation flag per (flag, turns), flag-major.

    A clockwise quarter turn moves a flag one step along one of two cycles:
    the plain rotations and the mirrored ones.
    """
    step = {}
    for cycle in ((1, 6, 3, 8), (2, 7, 4, 5)):
        for here, there in zip(cycle, cycle[1:] + cycle[:1]):
            step[here] = there
    table = []
    for flag in range(1, 9):
        for _ in range(4):
            table.append(flag)
            flag = step[flag]
    return table


def effective_orientation(orientation="orientation", rot_cw="rot_cw") -> Column:
    """The stored flag composed with the user's clockwise turns, as one flag 1..8."""
    flag = F.when(_col(orientation).between(1, 8), _col(orientation)).otherwise(F.lit(1))
    turns = F.pmod(_col(rot_cw), F.lit(4))
    table = F.array(*[F.lit(v) for v in _turn_table()])
    return F.element_at(table, ((flag - 1) * 4 + turns + 1).cast("int"))


def one_decimal(value) -> Column:
    """Non-negative number with one decimal, exact ties rounded to even.

    ``rest`` is exact, and so is the sign of ``20 * rest - k`` for an odd
    integer ``k`` when taken as ``4 * rest - (k - 16 * rest)``; so a binary
    value just beside a decimal tie is never mistaken for the tie.
    """
    value = _col(value).cast("double")
    whole = F.floor(value)
    rest = value - whole
    tenth = F.floor(rest * 10)
    beyond = rest * 4 - ((tenth * 2 + 1).cast("double") - rest * 16)
    # An odd tenth rounds up on the tie itself, an even one only beyond it.
    up = (beyond > (tenth % 2).cast("double") * F.lit(-1e-300)).cast("int")
    tenths = (whole * 10 + tenth + up).cast("decimal(20,0)")
    return (tenths * F.lit("0.1").cast("decimal(1,1)")).cast("string")


def trim_number(value) -> Column:
    """``35.0`` as ``35``, ``2.8`` as ``2.8``."""
    value = _col(value).cast("double")
    near = F.round(value)
    return F.when(F.abs(value - near) < 0.05, near.cast("bigint").cast("string")).otherwise(
        one_decimal(value)
    )


def exif_line(rel_path="rel_path") -> Column:
    """Camera, lens, aperture, shutter, ISO, focal length and stamp in one line.

    Nulls are skipped; a photo with none of them shows its file name.
    """
    parts = [
        F.col("camera"),
        F.col("lens"),
        F.concat(F.lit("f/"), trim_number("aperture")),
        F.col("shutter"),
        F.concat(F.lit("ISO "), F.col("iso").cast("string")),
        F.concat(trim_number("focal_mm"), F.lit("mm")),
        F.col("taken_at"),
    ]
    return F.when(F.coalesce(*parts).isNull(), file_name(rel_path)).otherwise(
        F.concat_ws(" · ", *parts)
    )


def bounded_error(message) -> Column:
    return F.substring(_col(message), 1, MAX_ERROR_CHARS)
