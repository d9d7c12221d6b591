"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of characters.  Equal blocks get
the same integer: blocks are sorted and numbered.  Then pairs of neighbouring
numbers are sorted and numbered in turn, level by level, until each text is one
number.  Numbers of different blocks, or of different pairs, never coincide, so
two texts share an identity exactly when they are equal; no digest decides it.

Blocks are spread by a hash and sorted as full texts among those that share it,
so block texts cross the network once, and only pairs of integers after that.
A block with very many copies is split over salts of bounded size, each salt
numbers its own rows, and one row per salt and distinct block settles the common
number.

Nulls, ties and the like
    A null text counts as empty; all empty texts are one group.  The row with the
    largest id stays; rows with equal id and text are one group too, of which
    the row smallest by its other columns stays.  A null id sorts below all
    others.  An empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.llm.common import MAX_LOOKUP_ROWS, Scratch

BLOCK_CHARS = 4096
# Rows of one block hash that are sorted together.
SALT_ROWS = 1000
# Names are (partition << 33) + row; the level is kept above them.
LEVEL_SHIFT = 55


def text_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, identity, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    level = _block_names(docs, id_col, text_col, block_chars, salt_rows, scratch)
    done, step = [], 0
    while True:
        done.append(
            level.where("_n = 1").select(
                "_id",
                "_sha",
                F.shiftleft(F.lit(step).cast("bigint"), LEVEL_SHIFT).bitwiseOR(F.col("_name")).alias("identity"),
                "_m",
            )
        )
        if not level.where("_n > 1").limit(1).count():
            break
        step += 1
        level = _pair_names(level.where("_n > 1"), step, scratch)
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    named = scratch.save(named.groupBy("_id", "_sha", "identity").agg(F.sum("_m").alias("_m")), "named")
    groups = scratch.save(
        named.groupBy("identity").agg(F.max("_id").alias("keep_id"), F.sum("_m").alias("group_size")),
        "groups",
    )
    return named.join(groups, "identity").select(
        F.col("_id").alias(id_col),
        "identity",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_copy"),
        F.col("_sha").alias("text_sha256"),
    ).select(
        id_col,
        "identity",
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = text_groups(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")
    )
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(
        F.struct("*").alias("_doc"),
        F.col(id_col).alias("_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"),
        F.to_json(F.struct(F.col(text_col).isNull(), *others)).alias("_rest"),
    )
    stay = packed.join(
        kept, (F.col("_sha") == F.col("_keep_sha")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi"
    )
    same = W.partitionBy("_sha", "_id").orderBy("_rest")
    return stay.withColumn("_row", F.row_number().over(same)).where("_row = 1").select("_doc.*")


def _block_names(docs, id_col, text_col, block_chars, salt_rows, scratch) -> DataFrame:
    """Level 0: ``(_id, _sha, _n, _m, _pos, _name)`` for each block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = (
        docs.select(
            F.col(id_col).alias("_id"),
            F.sha2(text, 256).alias("_sha"),
            F.when(text == "", F.array(F.lit("")))
            .otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
            .alias("_blocks"),
        )
        .select("_id", "_sha", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_pos", "_block"))
        .withColumn("_h", F.xxhash64("_block"))
    )
    crowded = scratch.save(
        blocks.groupBy("_h").agg(F.count("*").alias("_rows")).where(F.col("_rows") > salt_rows)
        .select("_h", F.ceil(F.col("_rows") / salt_rows).cast("int").alias("_salts")),
        "crowded",
    )
    salts = crowded.groupBy().agg(F.count("*"), F.coalesce(F.sum("_salts"), F.lit(0))).head()
    if salts[0]:
        small = salts[1] <= MAX_LOOKUP_ROWS
        blocks = blocks.join(F.broadcast(crowded) if small else crowded, "_h", "left").withColumn(
            "_salt", F.coalesce(F.pmod(F.xxhash64("_id", "_sha", "_pos"), F.col("_salts")), F.lit(0))
        )
    else:
        blocks = blocks.withColumns({"_salts": F.lit(None).cast("int"), "_salt": F.lit(0)})
    together = W.partitionBy("_h", "_salt").orderBy("_block")
    ranked = blocks.withColumns(
        {"_rank": F.dense_rank().over(together), "_last": F.lag("_block").over(together)}
    ).select(
        "_id", "_sha", "_n", "_pos", "_h", F.col("_salt").cast("bigint").alias("_salt"), "_rank",
        F.when(
            F.col("_salts").isNotNull() & ~F.col("_block").eqNullSafe(F.col("_last")), F.col("_block")
        ).alias("_text"),
    )
    ranked = scratch.save(ranked, "ranked")
    leaves = ranked.drop("_text")
    if salts[0]:
        shared = (
            ranked.where("_text IS NOT NULL")
            .select("_h", "_salt", "_rank", F.dense_rank().over(W.partitionBy("_h").orderBy("_text")).alias("_common"))
        )
        leaves = leaves.join(F.broadcast(shared) if small else shared, ["_h", "_salt", "_rank"], "left").withColumn(
            "_rank", F.coalesce("_common", "_rank")
        )
    leaves = leaves.select("_id", "_sha", "_n", F.lit(1).cast("bigint").alias("_m"), "_pos", "_h", "_rank")
    return _named(leaves, ["_h", "_rank"], 0, scratch)


def _pair_names(level, step, scratch) -> DataFrame:
    """The next level: neighbouring names joined to pairs, and pairs named."""
    even = F.col("_pos") % 2 == 0
    pairs = level.groupBy("_id", "_sha", F.floor(F.col("_pos") / 2).cast("int").alias("_at")).agg(
        F.ceil(F.max("_n") / 2).cast("int").alias("_n"),
        F.sum(F.when(even, F.col("_m"))).alias("_m"),
        F.max(F.when(even, F.col("_name"))).alias("_left"),
        F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(-1)).alias("_right"),
    )
    pairs = scratch.save(pairs.withColumnRenamed("_at", "_pos"), f"pairs{step}")
    return _named(pairs, ["_left", "_right"], step, scratch)


def _named(rows, key, step, scratch) -> DataFrame:
    """Replaces ``key`` by its number in the sort of all distinct keys."""
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    names = scratch.save(
        rows.select(*key)
        .distinct()
        .repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .withColumn("_name", F.monotonically_increasing_id()),
        f"names{step}",
    )
    return scratch.save(rows.join(names, key).drop(*key), f"level{step}")
