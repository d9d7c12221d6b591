"""Trie of conversation prefixes from sorted sequences, without building a trie.

Each distinct sequence of turns is one row; the rows are sorted and numbered, and each
learns how many turns it shares with the row before (its LCP).  The members of a prefix of
``d`` turns are a run of rows: from any of them it reaches left and right as long as all
LCPs are at least ``d``.  So every candidate, that is every row with every one of its
depths, searches its two ends on its own, by binary search over a sparse table of range
minima; candidates with the same left end and depth are one node.

The sorted rows are cut into blocks, and each block has its own sparse table.  What leaves a
block to the left is at most one search per block and depth; these are answered by the
same method over the minima of blocks, then over minima of those, and so on, so no table
grows with the data.  A node that spans blocks is one fragment in each, already summed, and
the fragments are added up.

A turn is represented by the SHA-256 of its role and text, so only 32 bytes of a turn and
its number of words travel.  One conversation is one row of these, as it is one key of the
sort.  The ids that end at a node are hashed as a stream: ids are sorted across tasks,
joined to pieces there, and only pieces meet.

Nulls, ties and the like
    Turns are ordered by turn, nulls first, then by the digest of role and text; repeated rows
    are repeated turns.  Null roles and texts are empty; a null text has no words.  Rows
    without a conversation id belong to none.  A conversation may be left without turns; it ends
    at the root.  An empty table has no conversation and so no node, not even a root.
    Further columns are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import WORD, Scratch, numbered
from photocat.operators.ordering import shifted

# Sorted rows per sparse table.
BLOCK_ROWS = 8192
# Ids that are joined to one piece before pieces of a long list meet.
PIECE_IDS = 100_000
# Parents that may be broadcast, those with the most children.
CROWDED = 1000


def sequences(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turns)``: for each conversation its ordered ``(digest, words)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    ordered = F.sort_array(F.collect_list(turn))
    return (
        turns.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["words"])).alias("turns"))
    )


def with_shared_heads(convs: DataFrame, key: str = "conv_id", every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first turns come from the first conversation of their group of ``every`` ids.

    Conversation c takes the first h turns of c - c % ``every``, h being crc32(c) % ``heads``, and
    goes on with its own turns after its first h.  The remainder has the sign of c, as in SQL.
    """
    h = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = convs.select(F.col(key).alias("_first"), F.slice("turns", 1, max(heads - 1, 1)).alias("_head"))
    own = convs.withColumns({"_h": h, "_base": F.col(key) - F.col(key) % every})
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    joined = own.join(first, F.col("_base") == F.col("_first"), "left")
    return joined.select(key, F.concat(head, rest).alias("turns"))


def trie(
    convs: DataFrame, key: str = "conv_id", block_rows: int = BLOCK_ROWS, piece_ids: int = PIECE_IDS
) -> DataFrame:
    """One row per distinct prefix of ``convs(key, turns)``.

    ``first_row`` and ``last_row`` are the ends of its run among the sorted distinct sequences.
    """
    spark = convs.sparkSession
    scratch = Scratch(spark, "trie")
    rows = _sorted_rows(convs, key, piece_ids, scratch)
    blocks = rows.withColumn("_block", F.floor(F.col("_index") / block_rows))
    pieces = scratch.save(blocks.groupBy("_block").applyInPandas(_fragments, FRAGMENT), "fragments")
    # What begins before its block asks the minima of blocks, then the rows of the block found.
    open_ = scratch.save(pieces.where("left IS NULL").select(F.col("block").alias("at"), F.col("depth").alias("d")), "open")
    values = rows.select(F.col("_index").alias("at"), F.col("_lcp").alias("low"))
    minima = values.groupBy(F.floor(F.col("at") / block_rows).alias("at")).agg(F.min("low").alias("low"))
    ends = _look_inside(values, _left_of(minima, open_, block_rows, scratch), block_rows, scratch, 0)
    ends = scratch.save(ends.select(F.col("at").alias("block"), "d", F.col("left").alias("_left")), "ends")
    # Fragments of one node have one left end.  Of each block and depth only one is open.
    placed = (
        pieces.join(ends, (pieces.block == ends.block) & (pieces.depth == ends.d), "left")
        .drop(ends.block)
        .withColumn("first_row", F.coalesce("left", "_left"))
        .drop("d", "_left")
    )
    upper = ends.select(F.col("block").alias("_b"), F.col("d").alias("_d"), F.col("_left").alias("_up"))
    placed = placed.join(upper, (F.col("up_open") == F.col("_b")) & (F.col("depth") - 1 == F.col("_d")), "left")
    nodes = placed.groupBy("first_row", "depth").agg(
        F.max("last").alias("last_row"),
        F.min("conv").alias(key),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
        F.max("ends").alias("ends_sha256"),
        F.max(F.coalesce("up", "_up")).alias("_parent"),
    )
    return _with_parents(scratch.save(nodes, "nodes"), key).select(
        key,
        F.col("depth").cast("bigint").alias("depth"),
        f"parent_{key}",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "first_row",
        "last_row",
    )


def _sorted_rows(convs: DataFrame, key: str, piece_ids: int, scratch: Scratch) -> DataFrame:
    """Distinct sequences in order: ``_index``, ``_len``, ``_lcp`` with the row before, ``_next`` with the one after."""
    digests = F.transform("turns", lambda t: t["digest"])
    members = scratch.save(
        convs.select(
            F.col(key).cast("bigint").alias("_conv"),
            F.sha2(F.array_join(F.transform(digests, F.hex), "").cast("binary"), 256).alias("_key"),
            digests.alias("_turns"),
            F.transform("turns", lambda t: t["words"]).alias("_words"),
        ),
        "members",
    )
    distinct = members.groupBy("_key").agg(
        F.min("_conv").alias("_conv"),
        F.count("*").alias("_n"),
        F.any_value("_turns").alias("_turns"),
        F.any_value("_words").alias("_words"),
    )
    sorted_ = numbered(
        distinct.join(_ends(members.select("_key", "_conv"), piece_ids), "_key"), [F.col("_turns").asc()], scratch, "sorted"
    )
    near = shifted(sorted_, [], "_index", {"_before": ("_turns", 1), "_after": ("_turns", -1)}, 1)

    def shared(other):
        same = F.zip_with("_turns", other, lambda a, b: a.eqNullSafe(b))
        at = F.array_position(same, False).cast("int")
        count = F.when(at > 0, at - 1).otherwise(F.least(F.size("_turns"), F.size(other)))
        return F.when(F.col(other).isNull(), -1).otherwise(count)

    running = F.aggregate(
        "_words",
        F.array(F.lit(0).cast("bigint")),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    rows = near.select(
        "_index", "_conv", "_n", F.size("_turns").alias("_len"), shared("_before").alias("_lcp"),
        shared("_after").alias("_next"), running.alias("_run"), "_ends",
    )
    return scratch.save(rows, "rows")


def _ends(members: DataFrame, piece_ids: int) -> DataFrame:
    """``(_key, _ends)``: SHA-256 of the ids of a sequence in ascending order, joined by commas."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        key, ids = None, []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(ids) >= piece_ids:
                    if ids:
                        yield key, ids[0], ",".join(map(str, ids))
                    key, ids = k, []
                ids.append(i)
        if ids:
            yield key, ids[0], ",".join(map(str, ids))

    def digests(batches):
        key, state = None, None
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    yield key, state.hexdigest()
                key, state = k, hashlib.sha256(text.encode())
        if state:
            yield key, state.hexdigest()

    def packed(rows, names):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 100 + len(row[-1])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))

    joined = (
        members.repartitionByRange(parts, "_key", "_conv")
        .sortWithinPartitions("_key", "_conv")
        .mapInArrow(lambda batches: packed(pieces(batches), ["_key", "_at", "_ids"]), "_key string, _at bigint, _ids string")
    )
    return (
        joined.repartition(parts, "_key")
        .sortWithinPartitions("_key", "_at")
        .mapInArrow(lambda batches: packed(digests(batches), ["_key", "_ends"]), "_key string, _ends string")
    )


def sparse_table(values: np.ndarray) -> list:
    """Level k holds the minimum of every 2**k neighbours."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def reach_left(levels: list, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last position up to ``at`` whose value is below ``depth``; -1 if there is none."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        start = at - (1 << k) + 1
        able = start >= 0
        # The range of 2**k values that ends here is skipped if none is below.
        skip = able & (levels[k][np.where(able, start, 0)] >= depth)
        at[skip] -= 1 << k
    return at


def reach_right(levels: list, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first position from ``at`` whose value is below ``depth``; the length if there is none."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        able = at < len(levels[k])
        skip = able & (levels[k][np.where(able, at, 0)] >= depth)
        at[skip] += 1 << k
    return at


def range_min(levels: list, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum from ``first`` to ``last``, both included."""
    k = np.log2(last - first + 1).astype(np.int64)
    k = np.where((1 << k) > last - first + 1, k - 1, k)
    out = np.empty(len(first), levels[0].dtype)
    for level in np.unique(k):
        here = k == level
        end = last[here] - (1 << int(level)) + 1
        out[here] = np.minimum(levels[level][first[here]], levels[level][end])
    return out


FRAGMENT = (
    "block bigint, left bigint, depth int, last bigint, conv bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved bigint, ends string, up bigint, up_open bigint"
)


def _fragments(pdf: pd.DataFrame) -> pd.DataFrame:
    """The part of every node that lies in one block.

    ``left`` is null if the node begins in an earlier block.  Where a node begins, ``up`` is the
    left end of its parent, or ``up_open`` the block, if the parent begins before it.
    """
    pdf = pdf.sort_values("_index")
    base, block = int(pdf["_index"].iloc[0]), int(pdf["_block"].iloc[0])
    length, lcp = pdf["_len"].to_numpy(np.int64), pdf["_lcp"].to_numpy(np.int64)
    m = len(pdf)
    lcps, convs = sparse_table(lcp), sparse_table(pdf["_conv"].to_numpy(np.int64))
    offset = np.concatenate(([0], np.cumsum(length + 1)))
    run = np.concatenate(pdf["_run"].to_list()).astype(np.int64)
    # Every row with every one of its depths searches both ends.
    row = np.repeat(np.arange(m), length + 1)
    depth = np.arange(len(row)) - offset[row]
    left = reach_left(lcps, row, depth)
    right = reach_right(lcps, row + 1, depth) - 1
    # One candidate for each node: its first row here.
    one = row == np.maximum(left, 0)
    row, depth, left, right = row[one], depth[one], left[one], right[one]
    begins = left >= 0

    def total(values):
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[right + 1] - sums[row]

    n = pdf["_n"].to_numpy(np.int64)
    whole = run[offset[1:] - 1]
    # Words of the turns that a row adds to the rows before it; a node's first row adds all from its depth on.
    added = whole - run[offset[:-1] + np.maximum(lcp, 0)]
    above = run[offset[row] + np.maximum(depth - 1, 0)]
    new = total(added) + np.where(begins, whole[row] - above - added[row], 0)
    saved = total(n * whole) - total(n) * above - new
    # Children begin where the LCP is the node's depth, and at its first row if that goes on.
    order = np.sort(lcp * (m + 1) + np.arange(m))
    inner = np.searchsorted(order, depth * (m + 1) + right, "right") - np.searchsorted(order, depth * (m + 1) + row, "right")
    goes_on = np.where(begins, length[row] > depth, lcp[row] == depth)
    up = reach_left(lcps, row, depth - 1)
    ends = pdf["_ends"].to_numpy(object)
    inside, outside = begins & (depth > 0) & (up >= 0), begins & (depth > 0) & (up < 0)
    return pd.DataFrame(
        {
            "block": block,
            "left": pd.array(np.where(begins, row + base, 0), "Int64").copy(),
            "depth": depth.astype(np.int32),
            "last": right + base,
            "conv": range_min(convs, row, right),
            "n_convs": total(n),
            "n_children": inner + goes_on,
            "n_leaves": total((length != pdf["_next"].to_numpy(np.int64)).astype(np.int64)),
            "saved": saved,
            "ends": np.where(begins & (length[row] == depth), ends[row], None),
            "up": pd.array(np.where(inside, up + base, 0), "Int64"),
            "up_open": pd.array(np.where(outside, block, 0), "Int64"),
        }
    ).assign(
        left=lambda d: d["left"].mask(~begins),
        up=lambda d: d["up"].mask(~inside),
        up_open=lambda d: d["up_open"].mask(~outside),
    )


LEFT = "at bigint, d int, left bigint"


def _left_of(values, queries, block_rows, scratch, level=1) -> DataFrame:
    """For ``queries(at, d)`` the last of ``values(at, low)`` before ``at`` with low < d, as ``left``.

    There always is one, as the first of all values is -1.
    """
    group = F.floor(F.col("at") / block_rows)
    values = scratch.save(values, f"lows{level}")
    both = values.select("at", "low", F.lit(None).cast("int").alias("d")).union(
        queries.select("at", F.lit(None).cast("int"), "d")
    )
    tried = both.withColumn("group", group).groupBy("group").applyInPandas(_within, "group bigint, " + LEFT)
    tried = scratch.save(tried, f"tried{level}")
    done = tried.where("left IS NOT NULL").select("at", "d", "left")
    rest = tried.where("left IS NULL").select(F.col("group").alias("at"), "d").distinct()
    rest = scratch.save(rest, f"open{level}")
    if rest.limit(1).count() == 0:
        return done
    # The answer is in a group before, which the minima of groups tell.
    minima = values.groupBy(group.alias("at")).agg(F.min("low").alias("low"))
    found = _left_of(minima, rest, block_rows, scratch, level + 1)
    answer = _look_inside(values, found, block_rows, scratch, level)
    answer = answer.select(F.col("at").alias("group"), "d", "left")
    far = tried.where("left IS NULL").drop("left").join(answer, ["group", "d"]).select("at", "d", "left")
    return done.union(far)


def _look_inside(values, found, block_rows, scratch, level) -> DataFrame:
    """The same for ``found``, whose ``left`` says in which group of values the answer is."""
    found = scratch.save(found, f"found{level}")
    none = F.lit(None)
    asked = found.select(
        F.col("left").alias("group"), none.cast("bigint").alias("at"), none.cast("int").alias("low"),
        F.col("at").alias("query"), "d",
    )
    held = values.select(
        F.floor(F.col("at") / block_rows).alias("group"), "at", "low", none.cast("bigint").alias("query"),
        none.cast("int").alias("d"),
    )
    # Only groups that are asked are looked into.
    held = held.join(found.select(F.col("left").alias("group")).distinct(), "group", "left_semi")
    return held.union(asked).groupBy("group").applyInPandas(_last_below, LEFT)


def _last_below(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each query the last of the group's values that is below its depth."""
    held = pdf[pdf["query"].isna()].sort_values("at")
    asked = pdf[pdf["query"].notna()]
    depth = asked["d"].to_numpy(np.int64)
    found = reach_left(sparse_table(held["low"].to_numpy(np.int64)), np.full(len(asked), len(held) - 1), depth)
    return pd.DataFrame(
        {"at": asked["query"].to_numpy(np.int64), "d": depth.astype(np.int32), "left": held["at"].to_numpy(np.int64)[found]}
    )


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Queries of one group of values: the last value before them below their depth, null if it is not here."""
    held = pdf[pdf["d"].isna()].sort_values("at")
    asked = pdf[pdf["d"].notna()]
    places, depth = held["at"].to_numpy(np.int64), asked["d"].to_numpy(np.int64)
    before = np.searchsorted(places, asked["at"].to_numpy(np.int64)) - 1
    found = reach_left(sparse_table(held["low"].to_numpy(np.int64)), before, depth)
    left = pd.array(places[np.maximum(found, 0)], "Int64")
    left[found < 0] = pd.NA
    return pd.DataFrame({"group": pdf["group"].iloc[0], "at": asked["at"], "d": depth.astype(np.int32), "left": left})


def _with_parents(nodes: DataFrame, key: str) -> DataFrame:
    """Adds the id of each node's parent.

    Parents with very many children, of which there are few, are broadcast; the others are joined.
    """
    many = max(nodes.count() // CROWDED, 100)
    parents = nodes.where("n_children > 0").select(
        F.col("first_row").alias("_parent"), (F.col("depth") + 1).alias("depth"), F.col(key).alias(f"parent_{key}"),
        "n_children",
    )
    # All nodes together have fewer children than there are nodes, so at most CROWDED have so many.
    crowded = F.broadcast(parents.where(F.col("n_children") > many).drop("n_children"))
    few = parents.where(F.col("n_children") <= many).drop("n_children")
    on = ["_parent", "depth"]
    root = nodes.where("depth = 0").withColumn(f"parent_{key}", F.lit(None).cast("bigint"))
    below = nodes.where("depth > 0")
    columns = [*nodes.columns, f"parent_{key}"]
    return (
        root.select(columns)
        .union(below.join(crowded, on).select(columns))
        .union(below.join(crowded.select(on), on, "left_anti").join(few, on).select(columns))
    )
