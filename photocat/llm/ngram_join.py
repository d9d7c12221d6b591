"""Size-aware heavy-light Jaccard join over sets of word shingles.

Light sets (at most ``boundary`` shingles) enumerate fixed-size subsets: two sets of
sizes a <= b reach the threshold exactly when they share o(a, b) shingles, so each
emits its subsets of that size under the key (a, b, subset), and meeting in a key
*is* the link; nothing is verified.

Heavy sets scan inverted lists, in two steps.  Lists of the shingles of all sets would
move every shingle of the corpus, so first only sets that may have a partner are found:
a set is split by hash into K parts, and where two linked sets differ in at most d
shingles, at least K - d parts agree in full.  A set may leave out its K - d - 1 fullest
parts, which are those of common passages, and linked sets still meet in one.  Then
the shingles of the sets that met are counted, and each set scans the lists of its
rarest ones: two sets that need an overlap o share one of the a - o + 1 and b - o + 1
rarest.  What the lists suggest is verified on the full sets.

The boundary is the largest size up to which enumerating costs no more keys than the
lists, counting the shingles that verification has to move (``light_limit``).

A list of m sets is not expanded into m^2 pairs.  Before the scan, every set is tested
against the most central set of one of its parts, and what is linked by then needs no
test any more: a list is scanned only for pairs of different components, from the
sets outside of its largest component.  Shingles that no other set holds bound the
overlap with any other set and rule out more pairs.  No link between components is
lost, whatever the size of a list, and equal sets take part once.

Nulls, ties and the like
    A null or empty text, or one without words, has size 0, links with nothing and
    is its own component; with a null id the component is null.  Equal sets of
    at least one shingle are linked.  Rows with the same id are each returned.
    An empty table gives an empty result.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photocat.llm.common import MAX_LOOKUP_ROWS, Scratch, components
from photocat.llm.shingles import BASE, mix, shingle_set

# Sizes of a class of heavy sets span this factor; small sets need finer classes.
CLASS_STEP, FINE_STEP, FINE_BELOW = 1.5, 1.2, 60
# Roles of rows: about the set of an input row; key of a subset on its smaller or equal
# side, and on its larger side; from PART on key of a part, plus the class.
SET, LOW, HIGH, PART = 0, 1, 2, 10
OUT_ROWS = 100_000
# Keys are matched in so many turns; Spark frees what one turn shuffled before the next.
KEY_TURNS = 4


class Threshold:
    """Jaccard >= num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.boundary = light_limit(self)
        # The smallest size that may be linked with a heavy set starts the classes.
        self.lows = [self.smallest(self.boundary + 1)]

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def smallest(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def class_of(self, n: int) -> int:
        while self.lows[-1] <= n:
            last = self.lows[-1]
            step = FINE_STEP if last < FINE_BELOW else CLASS_STEP
            self.lows.append(max(last + 1, int(last * step)))
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def parts(self, c: int) -> tuple:
        """(K, small, agreeing) for pairs whose smaller set is of class ``c``.

        Of K parts each set may leave out up to ``small`` of its smallest, and two
        linked sets still agree in at least ``agreeing`` parts that both list.
        """
        self.class_of(self.lows[c])
        top = self.lows[c + 1] - 1
        d = (self.den - self.num) * (top + self.largest(top)) // (self.den + self.num)
        spare = 2 + d // 4
        return d + 1 + spare, spare // 2, 1 + spare - spare // 2


def light_cost(t: Threshold, n: int) -> int:
    return sum(comb(n, t.overlap(n, b)) for b in range(t.smallest(n), t.largest(n) + 1))


def light_limit(t: Threshold) -> int:
    n = 1
    while True:
        differing = (t.den - t.num) * (n + t.largest(n)) // (t.den + t.num)
        if light_cost(t, n + 1) > (differing + 1) + (n + 1):
            return n
        n += 1


def light_keys(tokens: np.ndarray, t: Threshold):
    """(keys, roles) of a light set."""
    n, keys, roles = len(tokens), [], []
    mixed = mix(tokens * BASE)
    for other in range(max(1, t.smallest(n)), min(t.boundary, t.largest(n)) + 1):
        low, high = min(n, other), max(n, other)
        kept = t.overlap(low, high)
        subsets = np.array(list(combinations(range(n), kept)))
        sums = mixed[subsets].sum(axis=1, dtype=np.uint64)
        keys.append(mix(sums * BASE + np.uint64(low << 20 | high << 1 | 1)))
        roles.append(np.full(len(subsets), LOW if n == low else HIGH, np.int16))
    return keys, roles


def part_keys(tokens: np.ndarray, t: Threshold):
    """(keys, roles) of the parts of a set, for pairs in which it is the smaller or the larger set.

    Small parts say little.  Which sizes a set leaves out depends on how many it has
    of them; of two linked sets the one that leaves out more decides for a part
    that agrees, so no more than ``small`` of these are lost.
    """
    n = len(tokens)
    keys, roles = [], []
    for c in range(t.class_of(max(t.smallest(n), t.lows[0])), t.class_of(n) + 1):
        k, small, _ = t.parts(c)
        at = (mix(tokens ^ BASE) % np.uint64(k)).astype(np.int64)
        sizes = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        sums = np.zeros(k, np.uint64)
        present = np.flatnonzero(sizes)
        first = np.concatenate(([0], np.cumsum(sizes[present])[:-1]))
        sums[present] = np.add.reduceat(mix(tokens[order] * BASE), first)
        least = int(np.searchsorted(np.cumsum(np.bincount(sizes)), small, "right"))
        stay = np.flatnonzero(sizes >= least)
        tag = (stay.astype(np.uint64) << np.uint64(20)) | np.uint64(c << 1)
        keys.append(mix(sums[stay] * BASE + mix(tag + sizes[stay].astype(np.uint64) * BASE)))
        roles.append(np.full(len(stay), PART + c, np.int16))
    return keys, roles


def identity(tokens: np.ndarray) -> np.uint64:
    return mix(tokens * BASE).sum(dtype=np.uint64) ^ np.uint64(len(tokens))


def _key_rows(k, num, den):
    """One row per text about its set, and the rows of its keys."""

    def rows(batches):
        t = Threshold(num, den)
        names = ["_key", "_sid", "_role", "_check", "_id"]
        for batch in batches:
            keys, roles, sids, checks, ids, held = [], [], [], [], [], 0

            def out():
                present = np.concatenate(roles)
                lone = np.zeros(len(present), np.uint64)
                lone[present == SET] = checks
                at = np.full(len(present), -1, np.int64)
                at[present == SET] = ids
                take = pa.array(at, mask=at < 0)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(sids).view(np.int64)),
                        pa.array(present),
                        pa.array(lone.view(np.int64), mask=present != SET),
                        batch.column(0).take(take),
                    ],
                    names=names,
                )

            for at, text in enumerate(batch.column(1)):
                tokens = shingle_set(text.as_py(), k)
                n = len(tokens)
                new_keys, new_roles = light_keys(tokens, t) if 0 < n <= t.boundary else ([], [])
                if n >= t.lows[0]:
                    more_keys, more_roles = part_keys(tokens, t)
                    new_keys += more_keys
                    new_roles += more_roles
                sid = identity(tokens) if n else np.uint64(0)
                keys += [np.array([n], np.uint64), *new_keys]
                roles += [np.array([SET], np.int16), *new_roles]
                checks.append(mix(tokens ^ BASE).sum(dtype=np.uint64))
                ids.append(at)
                added = 1 + sum(map(len, new_keys))
                sids.append(np.full(added, sid))
                held += added
                if held >= OUT_ROWS:
                    yield out()
                    keys, roles, sids, checks, ids, held = [], [], [], [], [], 0
            if held:
                yield out()

    return rows


def _token_rows(k):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [shingle_set(x.as_py(), k) for x in batch.column(0).slice(at, 200)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([identity(s) for s in found], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(values)),
                    ],
                    names=["_sid", "_tokens"],
                )

    return rows


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "ngram", free_shuffles=True)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()
    t = Threshold(num, den)
    rows = scratch.save(
        texts.mapInArrow(
            _key_rows(k, num, den),
            f"_key bigint, _sid bigint, _role smallint, _check bigint, _id {id_type}",
        ),
        "rows",
    )
    sets = scratch.save(
        rows.where(F.col("_role") == SET).select("_id", F.col("_key").alias("_n"), "_sid", "_check"), "sets"
    )
    # One row per distinct set; a second checksum guards the 64-bit identity.
    distinct = scratch.save(
        sets.where("_n > 0").groupBy("_sid").agg(
            F.min("_id").alias("_first"), F.min("_check").alias("_low"), F.max("_check").alias("_high")
        ).select(
            "_sid",
            F.when(F.col("_low") == F.col("_high"), F.col("_first"))
            .otherwise(F.raise_error(F.lit("two different sets share an identity")))
            .alias("_first"),
        ),
        "distinct",
    )
    largest = sets.agg(F.coalesce(F.max("_n"), F.lit(0))).head()[0]
    keys = rows.where(F.col("_role") != SET).select("_key", "_sid", "_role")
    edges = _links(texts, keys, distinct, k, t, largest, scratch)
    label = components(edges, scratch, "whole")
    # Components are named by sets so far; name them by the smallest id instead.
    named = scratch.save(
        distinct.join(label.withColumnRenamed("node", "_sid"), "_sid", "left").select(
            "_sid", "_first", F.coalesce("component", "_sid").alias("_comp")
        ),
        "named",
    )
    least = named.groupBy("_comp").agg(F.min("_first").alias("_least"))
    group = scratch.save(named.join(least, "_comp").select("_sid", "_least"), "group")
    return sets.join(group, "_sid", "left").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_least")).alias("component_id"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns; rows without words all stay.

    The smallest id stays, a null id only if there is no other.  Rows are told apart by id and text, so
    rows that share an id, or have none, are decided one by one.  Of rows with equal id and text the
    one stays that is smallest by its other columns.
    """
    scratch = Scratch(docs.sparkSession, "keep", free_shuffles=True)
    missing = F.col(id_col).isNull()
    text_hash = F.coalesce(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(0))
    row = F.struct(missing.alias("missing"), F.col(id_col).alias("id"), text_hash.alias("text"))
    keyed = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    groups = jaccard_groups(keyed, "_row", "_text", **kinds)
    groups = scratch.save(groups.where(F.col("n_shingles") > 0).select("_row", "component_id"), "groups")
    gone = groups.where(~F.col("_row").eqNullSafe(F.col("component_id"))).select(F.col("_row").alias("_gone")).distinct()
    packed = docs.select(F.struct("*").alias("_doc"), row.alias("_row"))
    stay = packed.join(gone, F.col("_row").eqNullSafe(F.col("_gone")), "left_anti")
    twice = groups.groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_row").alias("_twice"))
    twice = scratch.save(twice, "twice")
    if twice.limit(1).count() == 0:
        return stay.select("_doc.*")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    again = W.partitionBy("_row").orderBy(F.to_json(F.struct(F.lit(0), *[F.col("_doc")[c].alias(c) for c in others])))
    same = F.col("_row").eqNullSafe(F.col("_twice"))
    one = stay.join(twice, same, "left_semi").withColumn("_place", F.row_number().over(again)).where("_place = 1")
    return stay.join(twice, same, "left_anti").select("_doc.*").union(one.select("_doc.*"))


def _links(texts, keys, distinct, k, t, largest, scratch) -> DataFrame:
    """Edges between distinct sets that connect whatever is linked."""
    met = _met(keys, scratch)
    scratch.drop("rows")
    real = scratch.save(
        met.groupBy("_key").agg(
            F.count("*").alias("_fill"), F.min(F.when(F.col("_role") == LOW, F.col("_sid"))).alias("_small")
        ).where("_fill > 1"),
        "real",
    )
    # Light: every set of a key is linked with the key's smaller sets.
    light = (
        met.where(F.col("_role") < PART)
        .join(real.where("_small IS NOT NULL").select("_key", "_small"), "_key")
        .where("_sid != _small")
        .select(F.col("_sid").alias("a"), F.col("_small").alias("b"))
        .distinct()
    )
    light = scratch.save(light, "light")
    # Heavy: a set leaves out its fullest lists, as many as agreement allows.
    top = t.class_of(max(largest, t.lows[0]))
    agreeing = F.array(*[F.lit(t.parts(c)[2]) for c in range(top + 1)])
    fullest = W.partitionBy("_sid", "_role").orderBy(F.desc("_fill"), F.desc("_key"))
    members = scratch.save(
        met.where(F.col("_role") >= PART)
        .join(real.select("_key", "_fill"), "_key")
        .withColumn("_at", F.row_number().over(fullest))
        .where(F.col("_at") >= F.get(agreeing, F.col("_role") - PART))
        .select("_key", "_sid"),
        "members",
    )
    scratch.drop("met", "real")
    if members.limit(1).count() == 0:
        return light
    tokens = _tokens(texts, distinct, members, k, scratch)
    counted = _counted(tokens, scratch)
    sizes = _capacities(tokens, counted, t, scratch)
    members = scratch.save(members.join(sizes, "_sid"), "able")
    scratch.drop("members")
    # The most central set of a list: the one whose lists are the fullest.
    fill = members.groupBy("_key").agg(F.count("*").alias("_fill"))
    central = scratch.save(
        members.join(fill, "_key").groupBy("_sid").agg(F.sum("_fill").alias("_score")), "central"
    )
    best = members.join(central, "_sid").groupBy("_key").agg(
        F.max_by(
            F.struct(F.col("_sid").alias("_pivot"), F.col("_n").alias("_pivot_n"), F.col("_cap").alias("_pivot_cap")),
            F.struct("_score", "_sid"),
        ).alias("_best")
    )
    asked = (
        members.join(best.select("_key", "_best.*"), "_key")
        .where((F.col("_sid") != F.col("_pivot")) & _possible(t, "_n", "_cap", "_pivot_n", "_pivot_cap"))
        .groupBy("_sid", "_pivot")
        .agg(F.count("*").alias("_shared"))
    )
    asked = asked.groupBy("_sid").agg(F.max_by("_pivot", F.struct("_shared", "_pivot")).alias("_pivot"))
    central_links = scratch.save(_verified(asked, tokens, t), "links0")
    label = components(central_links, scratch, "central")
    known = sizes.join(label.withColumnRenamed("node", "_sid"), "_sid", "left").select(
        "_sid", "_n", "_cap", F.coalesce("component", "_sid").alias("_comp")
    )
    asked = _scanned(tokens, counted, scratch.save(known, "known"), t, scratch)
    list_links = scratch.save(_verified(asked, tokens, t), "links1")
    return light.union(central_links).union(list_links)


def _met(keys, scratch) -> DataFrame:
    """The distinct rows of all keys that several rows have.

    Every row is shuffled twice for this, which is the most that the join has on disk at
    one time; so a part of the keys takes its turn after the other.
    """
    for turn in range(KEY_TURNS):
        some = keys.where(F.pmod("_key", F.lit(KEY_TURNS)) == turn)
        crowded = some.groupBy("_key").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_key")
        # Copies of a set fall together before the second aggregation finds real meetings.
        once = some.join(crowded, "_key").groupBy("_key", "_sid", "_role").agg(F.lit(1).alias("_one"))
        schema = scratch.save(once, f"met/{turn}").schema
    paths = [scratch.path(f"met/{turn}") for turn in range(KEY_TURNS)]
    return scratch.spark.read.schema(schema).parquet(*paths).drop("_one")


def _scanned(tokens, counted, known, t, scratch) -> DataFrame:
    """Pairs of different components that the lists of rare shingles suggest."""
    rarest = W.partitionBy("_sid").orderBy("_holders", "_token")
    lists = (
        tokens.join(known, "_sid")
        .select("_sid", "_n", "_cap", "_comp", F.explode("_tokens").alias("_token"))
        .join(counted.where("_holders > 1").select("_token", "_holders"), "_token")
        # Shingles of no other set come first in the order and need no list.
        .withColumn("_rank", F.row_number().over(rarest) + F.col("_n") - F.col("_cap"))
        .where(F.col("_rank") <= F.col("_n") - _div(F.col("_n") * t.num + (t.den - 1), t.den) + 1)
        .select("_token", "_sid", "_n", "_comp", "_rank")
    )
    lists = scratch.save(lists, "lists")
    main = (
        lists.groupBy("_token", "_comp")
        .agg(F.count("*").alias("_size"))
        .groupBy("_token")
        .agg(
            F.max_by("_comp", F.struct("_size", "_comp")).alias("_main"),
            (F.sum("_size") - F.max("_size")).alias("_out"),
        )
        .where("_out > 0")
    )
    outer = lists.join(main.select("_token", "_main"), "_token").where("_comp != _main").drop("_main")
    outer = scratch.save(outer.withColumnsRenamed({c: f"_outer{c}" for c in outer.columns}), "outer")
    need = _need(t, "_n", "_outer_n")
    return (
        lists.join(
            outer,
            (F.col("_token") == F.col("_outer_token"))
            & (F.col("_comp") != F.col("_outer_comp"))
            & (F.col("_rank") + need <= F.col("_n") + 1)
            & (F.col("_outer_rank") + need <= F.col("_outer_n") + 1),
        )
        .select(F.least("_sid", "_outer_sid").alias("_sid"), F.greatest("_sid", "_outer_sid").alias("_pivot"))
        .distinct()
    )


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _need(t, n, other_n) -> Column:
    """The overlap that sets of these sizes need."""
    return _div((F.col(n) + F.col(other_n)) * t.num + (t.num + t.den - 1), t.num + t.den)


def _possible(t, n, cap, other_n, other_cap) -> Column:
    """The overlap that two sets need is no more than each can have with any other set."""
    return _need(t, n, other_n) <= F.least(F.col(cap), F.col(other_cap))


def _counted(tokens, scratch) -> DataFrame:
    """In how many of the listed sets a shingle is, and one of them."""
    return scratch.save(
        tokens.select("_sid", F.explode("_tokens").alias("_token"))
        .groupBy("_token")
        .agg(F.count("*").alias("_holders"), F.min("_sid").alias("_sid")),
        "counted",
    )


def _capacities(tokens, counted, t, scratch) -> DataFrame:
    """``(_sid, _n, _cap)``: size, and how many shingles some other listed set holds too.

    Sets that cannot reach the threshold with any other are left out.
    """
    lone = counted.where("_holders = 1").groupBy("_sid").agg(F.count("*").alias("_lone"))
    sizes = tokens.select("_sid", F.size("_tokens").cast("bigint").alias("_n")).join(lone, "_sid", "left")
    able = sizes.select("_sid", "_n", (F.col("_n") - F.coalesce("_lone", F.lit(0))).alias("_cap"))
    return scratch.save(able.where(F.col("_cap") * t.den >= F.col("_n") * t.num), "capacities")


def _tokens(texts, distinct, members, k, scratch) -> DataFrame:
    """Full sets of all members, from the text of one row each."""
    wanted = scratch.save(
        distinct.join(members.select("_sid").distinct(), "_sid").select("_sid", F.col("_first").alias("_id")),
        "wanted",
    )
    n, nulls = wanted.agg(F.count("*"), F.count_if(F.col("_id").isNull())).head()
    ids = wanted.select("_id").distinct()
    rows = texts.join(F.broadcast(ids) if n <= MAX_LOOKUP_ROWS else ids, "_id", "left_semi")
    if nulls:
        rows = rows.union(texts.where("_id IS NULL"))
    # Rows may share an id, so the set decides whether a row was meant.
    made = rows.select("_text").mapInArrow(_token_rows(k), "_sid bigint, _tokens array<bigint>")
    made = scratch.save(made.dropDuplicates(["_sid"]), "tokens")
    return made.join(wanted.select("_sid"), "_sid", "left_semi") if nulls else made


def _verified(asked, tokens, t) -> DataFrame:
    """``asked(_sid, _pivot)`` that reach the threshold, as edges."""
    left = tokens.select("_sid", F.col("_tokens").alias("_a"))
    right = tokens.select(F.col("_sid").alias("_pivot"), F.col("_tokens").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return (
        asked.join(right, "_pivot")
        .join(left, "_sid")
        .where(both.cast("bigint") * t.den >= union.cast("bigint") * t.num)
        .select(F.col("_sid").alias("a"), F.col("_pivot").alias("b"))
    )
