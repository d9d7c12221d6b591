"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold documents.  A token budget enters
at the root and is divided at every node by the weights of its children.  A child can
take no more than its subtree holds, times the allowed epochs; what it leaves is
divided among its siblings.  As the limit of a node is the sum over its subtree, a
shortage reaches the siblings of an ancestor only when all siblings are full.

A leaf's share buys whole epochs first.  The rest buys a prefix of the next epoch, whose
order is a seeded shuffle of the leaf's documents: the documents before the point
where the tokens exceed the rest.

Budgets are integers; a division rounds down, so a node may leave fewer tokens unspent
than it has children.

Nulls, ties and the like
    Null level values count as empty strings, null texts have no tokens.  A document
    without tokens is taken when its place lies within the prefix.  Rows of equal id
    and text share their copies as evenly as possible.  Weights are positive integers;
    values that are not listed have weight one.  An empty table, or a budget of
    nothing, selects nothing that has tokens.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.llm.common import MAX_LOOKUP_ROWS, WORD, Scratch, numbered

LEVELS = ("domain", "lang", "source")
WIDE = "decimal(38,0)"


def word_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def leaf_tree(source_col: str = "source", lang_col: str = "lang", domain_chars: int = 4) -> dict:
    """The levels of ``documents``: a domain is the beginning of the source name."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return {
        "domain": F.substring(source, 1, domain_chars),
        "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "source": source,
    }


def budgets(sizes: DataFrame, budget: int, weights: dict, epochs: int, scratch: Scratch) -> DataFrame:
    """``sizes(domain, lang, source, size)`` with ``leaf_budget``; all work is on one row per node."""
    for level, of in weights.items():
        if level not in LEVELS or any(w < 1 or w != int(w) for w in of.values()):
            raise ValueError("weights are positive integers by level")
    given = sizes.sparkSession.range(1).select(F.lit(budget).cast("bigint").alias("_given"))
    for depth, level in enumerate(LEVELS):
        parents, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = sizes.groupBy(*path).agg((F.sum("size") * epochs).alias("_cap"))
        nodes = nodes.join(given, parents) if parents else nodes.join(F.broadcast(given))
        weight = F.lit(1).cast("bigint")
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, F.lit(w).cast("bigint")).otherwise(weight)
        nodes = nodes.select(*path, "_cap", "_given", weight.alias("_weight"))
        given = _divide(nodes, parents, path, scratch)
    return sizes.join(given, list(LEVELS)).withColumnRenamed("_given", "leaf_budget")


def _divide(nodes, parents, path, scratch) -> DataFrame:
    """Fills children that cannot take their share, until the others divide what is left."""
    level = path[-1]
    nodes = scratch.save(nodes.withColumn("_full", F.lit(False)), f"{level}0")
    step = 0
    while True:
        left = nodes.groupBy(*parents).agg(
            (F.max("_given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0))).alias("_left"),
            F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_weight"))), F.lit(0)).alias("_weights"),
        )
        now = nodes.join(left, parents) if parents else nodes.join(F.broadcast(left))
        share = F.col("_left").cast(WIDE) * F.col("_weight").cast(WIDE)
        filled = ~F.col("_full") & (F.col("_cap").cast(WIDE) * F.col("_weights").cast(WIDE) <= share)
        step += 1
        nodes = scratch.save(
            now.withColumns({"_new": filled, "_share": F.when(
                F.col("_full") | filled, F.col("_cap")
            ).otherwise(F.expr("cast(_left as decimal(38,0)) * _weight div _weights"))}),
            f"{level}{step}",
        )
        if not nodes.where("_new").limit(1).count():
            return nodes.select(*path, F.col("_share").cast("bigint").alias("_given"))
        nodes = nodes.select(*path, "_cap", "_given", "_weight", (F.col("_full") | F.col("_new")).alias("_full"))


def mix(
    docs: DataFrame,
    share: float,
    weights: dict,
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree: dict | None = None,
) -> DataFrame:
    """Selected rows: id, levels, n_tokens, leaf_budget, copies; ``share`` is of all tokens."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        word_tokens(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
        *[column.alias(name) for name, column in (tree or leaf_tree()).items()],
    )
    rows = scratch.save(rows, "rows")
    sizes = scratch.save(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("size")), "sizes")
    leaves, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    bought = scratch.save(budgets(sizes, int(total * share), weights, epochs, scratch), "bought").select(
        *LEVELS,
        "leaf_budget",
        F.when(F.col("size") > 0, F.expr("leaf_budget div size")).otherwise(0).alias("_epochs"),
        F.when(F.col("size") > 0, F.expr("leaf_budget % size")).otherwise(0).alias("_rest"),
    )
    if leaves <= MAX_LOOKUP_ROWS:
        bought = F.broadcast(bought)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    placed = numbered(
        rows.join(bought, list(LEVELS)).withColumn("_order", order),
        [F.col(c).asc() for c in (*LEVELS, "_order", "_text")],
        scratch,
        "sorted",
        weight="n_tokens",
    )
    placed = scratch.save(placed.drop("_index", "_order"), "placed")
    start = placed.groupBy(*LEVELS).agg(F.min("_before").alias("_start"))
    if leaves <= MAX_LOOKUP_ROWS:
        start = F.broadcast(start)
    within = F.col("_before") - F.col("_start") + F.col("n_tokens") <= F.col("_rest")
    copies = F.col("_epochs") + F.when(within & (F.col("_epochs") < epochs), 1).otherwise(0)
    return (
        placed.join(start, list(LEVELS))
        .withColumn("copies", copies.cast("int"))
        .where("copies > 0")
        .select(F.col("_id").alias(id_col), *LEVELS, "n_tokens", "leaf_budget", "copies", F.col("_text").alias("text_hash"))
    )


def select_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, once per copy."""
    taken = mix(docs, id_col=id_col, text_col=text_col, **kinds).groupBy(
        F.col(id_col).alias("_taken_id"), F.col("text_hash").alias("_taken_text")
    ).agg(F.sum("copies").alias("_copies"))
    packed = docs.select(
        F.struct("*").alias("_doc"),
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    )
    joined = packed.join(
        taken, F.col("_id").eqNullSafe(F.col("_taken_id")) & (F.col("_text") == F.col("_taken_text"))
    )
    same = W.partitionBy("_taken_id", "_taken_text")
    shared = joined.withColumns(
        {"_row": F.row_number().over(same.orderBy(F.to_json("_doc"))) - 1, "_rows": F.count("*").over(same)}
    )
    own = F.expr("cast(_copies div _rows as int)") + F.when(F.col("_row") < F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return shared.withColumn("_own", own).where("_own > 0").select(
        "_doc", F.explode(F.sequence(F.lit(1), "_own")).alias("_copy")
    ).select("_doc.*")
