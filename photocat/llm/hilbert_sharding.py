"""Sharding along a Hilbert curve over several metadata columns.

Each column is quantised to ``2**bits`` levels, the levels are a point, and the
point's place on the Hilbert curve is the sort key.  The sorted rows are cut into
runs of equal length, so each shard covers a compact range of *every* column and
min/max statistics of its files prune on any of them.

Law: ``rows``; shard counts differ by one at most.

Nulls, ties and the like
    A null text has no bytes (size 8, checksum of the empty text); null values of
    a dimension sort first.  Ties on the curve are broken by id, checksum and
    size; rows equal in all of these are interchangeable.  Fewer rows than shards
    leave the last shards empty.  An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import Scratch, numbered, utf8

BITS = 6


def hilbert_table(dims: int) -> list:
    """``[state][bits of the point] -> (next state, digit)`` of the curve in ``dims`` dimensions.

    A state is the entry corner and the direction of a sub-cube.  Within it the
    sub-cubes are visited in Gray-code order, reflected at the entry corner and
    rotated by the direction.
    """
    corners, full = 1 << dims, (1 << dims) - 1

    def rotate(v, by):
        by %= dims
        return ((v << by) | (v >> (dims - by))) & full

    gray = [i ^ (i >> 1) for i in range(corners)]
    digit = {g: i for i, g in enumerate(gray)}

    def entry(i):
        return 0 if i == 0 else gray[2 * ((i - 1) // 2)]

    def trailing_ones(i):
        n = 0
        while i & 1:
            n, i = n + 1, i >> 1
        return n

    def turn(i):
        return 0 if i == 0 else trailing_ones(i - 1) % dims if i % 2 == 0 else trailing_ones(i) % dims

    table = []
    for state in range(corners * dims):
        start, way = divmod(state, dims)
        row = []
        for point in range(corners):
            i = digit[rotate(point ^ start, -(way + 1))]
            after = (start ^ rotate(entry(i), way + 1), (way + turn(i) + 1) % dims)
            row.append((after[0] * dims + after[1], i))
        table.append(row)
    return table


def hilbert_index(levels: list, bits: int) -> Column:
    """Place on the curve of the point whose coordinates are ``levels``, each below ``2**bits``."""
    dims = len(levels)
    table = hilbert_table(dims)
    moves = F.array(*[F.lit(s << dims | d) for row in table for s, d in row])
    corners = 1 << dims

    def step(acc, bit):
        point = F.lit(0)
        for level in levels:
            bit_of = F.call_function("getbit", level.cast("bigint"), bit).cast("int")
            point = point * 2 + bit_of
        move = F.get(moves, acc["state"] * corners + point)
        return F.struct(
            F.shiftright(move, dims).alias("state"),
            (acc["at"] * corners + move.bitwiseAND(corners - 1)).alias("at"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("at"))
    order = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(order, start, step)["at"]


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple = ("source", "lang"),
    bits: int = BITS,
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of ``docs``; ``size`` is the last dimension.

    Only these columns and the dimensions are shuffled, never the text.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    text = utf8(F.col(text_col))
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 8).cast("bigint").alias("_size"),
            F.crc32(text).alias("_crc"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_dim{i}") for i, c in enumerate(dims)],
        ),
        "rows",
    )
    levels = []
    for i in range(len(dims)):
        bounds = _bounds(rows, f"_dim{i}", 1 << bits, scratch)
        cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
        levels.append(_cuts_below(cuts, F.col(f"_dim{i}")))
    # Sizes on a logarithmic scale, two levels to a doubling.
    levels.append(F.least(F.floor(F.log2("_size") * 2).cast("int"), F.lit((1 << bits) - 1)))
    names = [f"_level{i}" for i in range(len(levels))]
    placed = rows.withColumns(dict(zip(names, levels))).withColumn(
        "_at_curve", hilbert_index([F.col(n) for n in names], bits)
    )
    order = [F.col(c).asc() for c in ("_at_curve", "_id", "_crc", "_size")]
    cut = numbered(placed.drop(*names), order, scratch, "sorted")
    total = rows.count()
    shard = F.call_function("div", F.col("_index") * shards, F.lit(max(total, 1)))
    # First position of a shard: the smallest one that the division sends there.
    first = F.call_function("div", F.col("shard") * total + shards - 1, F.lit(shards))
    return (
        cut.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_index") - first)
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_at_curve").alias("curve_index"),
            "shard",
            "slot",
        )
    )


def write_shards(docs: DataFrame, shards: int, path: str, **kinds) -> None:
    """Writes ``docs`` as one folder per shard; each shard's files follow the curve.

    Ids must be unique here, since they lead from the assignment back to the row.
    """
    id_col = kinds.get("id_col", "doc_id")
    at = assign_shards(docs, shards, **kinds).select(
        F.col(id_col).alias("_at_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"))
    placed = packed.join(at, F.col("_id").eqNullSafe(F.col("_at_id")))
    ordered = placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    ordered.select("_doc", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)


def _cuts_below(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda cut: cut <= value))


def _bounds(rows, column, levels, scratch) -> list:
    """At most ``levels - 1`` values that cut the distinct values into runs of equal length."""
    found = numbered(rows.select(column).distinct(), [F.col(column).asc()], scratch, f"of{column}")
    n = found.count()
    if not n:
        return []
    runs = min(levels, n)
    # The first value of each run but the first; a run's number grows by one there.
    run = F.call_function("div", F.col("_index") * runs, F.lit(n))
    before = F.call_function("div", (F.col("_index") - 1) * runs, F.lit(n))
    firsts = found.where((F.col("_index") > 0) & (run != before)).orderBy(column)
    return [r[0] for r in firsts.select(column).collect()]
