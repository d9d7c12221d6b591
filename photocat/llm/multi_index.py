"""Near-dedup of embeddings with an inverted multi-index.

Vectors are scaled to length one and cut into two halves.  Each half has a codebook
of its own, and the pairs of code words are the cells of a product grid.  A vector
is stored in the cell of its nearest code words.  To search, the cells are visited
in the order of the sum of the two squared distances (multi-sequence traversal:
a heap over the two sorted lists of code words) until the target recall is met;
what they hold is verified by cosine in double precision.

How far a traversal goes is learnt on a bounded sample: from vectors at the threshold
distance, made by turning sampled ones at random, and from linked vectors within the
sample.  The radius is the quantile of their distances in the grid that gives the
target recall for both.  A traversal
ends at the first cell beyond that radius, so its length follows the data, and no
cell is cut off by a count.

A link is counted for both of its vectors, also if only one traversal finds it: the stored
vector is credited along with the asking one unless its own traversal reaches the asking
vector's cell, where it is credited by itself.

Equal vectors (after scaling, bit for bit) are one class; links of its members among
each other and with other classes are counted by multiplicity, never expanded.
Near classes in a full cell are compared block by block.

Nulls, ties and the like
    A vector that is null, empty, zero, or holds null or non-finite components, links
    with nothing.  Vectors of different dimensions are never compared.  A vector id
    that is null counts as a row; its component is the smallest id reached, or null.
    Rows of equal id and vector are rows of their own.  An empty table gives an
    empty result.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import Scratch, components, in_sample

# Vectors that the codebooks and the radius are fitted on, at most.
SAMPLE_ROWS = 20_000
TARGET_RECALL = 0.999
# Sampled vectors whose links within the sample are looked up.
FIT_QUERIES = 2_000
# Code words of one half, at most; the grid, whose counts are broadcast, has the square of that.
MAX_WORDS = 512
# Square root of the rows to one code word.  An entry in one more cell costs as much as hundreds of
# products of vectors, so cells are held large: the fewer are visited.
ROWS_ROOT = 24
# Vectors of one cell that one block holds.
BLOCK = 2048
OUT_ROWS = 2_000


class Grid:
    """Two codebooks, and the radius a traversal goes beyond its best cell."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        words = min(max(4, int(rows**0.5 / ROWS_ROOT)), MAX_WORDS, len(sample))
        self.books = [_codebook(h, words, rng) for h in self.halves(sample)]
        self.words = words
        turned = _turned(sample, cosine, rng)
        away, own = self._away(sample), self.own_words(turned)
        at = np.arange(len(sample))
        needed = [away[0][at, own[0]] + away[1][at, own[1]]]
        # Linked vectors of the sample itself: dense groups lie closer than the threshold.
        own = self.own_words(sample)
        for start in range(0, min(len(sample), FIT_QUERIES), 100):
            some = slice(start, start + 100)
            ask, hold = np.nonzero(sample[some] @ sample.T >= cosine)
            other = hold != ask + start
            ask, hold = ask[other], hold[other]
            needed.append(away[0][some][ask, own[0][hold]] + away[1][some][ask, own[1][hold]])
        found = [n for n in (needed[0], np.concatenate(needed[1:])) if len(n)]
        self.radius = max(float(np.quantile(n, recall)) for n in found)
        self.radius += 1e-9  # for rounding

    def _away(self, x: np.ndarray) -> list:
        """Squared distances to the words beyond that of the nearest word."""
        return [d - d.min(1)[:, None] for d in self.distances(x)]

    def own_words(self, x: np.ndarray) -> list:
        return [d.argmin(1) for d in self.distances(x)]

    def halves(self, x: np.ndarray) -> tuple:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> list:
        """Squared distances to the words of each half, short of a constant per vector."""
        return [(b * b).sum(1) - 2 * h @ b.T for h, b in zip(self.halves(x), self.books)]

    def own_cells(self, distances: list) -> np.ndarray:
        first, second = (d.argmin(1) for d in distances)
        return first * self.words + second

    def reached(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the traversal from each of ``x`` (columns) visits each of ``cells`` (rows)."""
        first, second = self._away(x)
        return (first[:, cells // self.words] + second[:, cells % self.words]).T <= self.radius

    def visited(self, first: np.ndarray, second: np.ndarray) -> list:
        """Cells from the nearest on, up to the radius beyond the nearest."""
        a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
        near = first[a] - first[a[0]], second[b] - second[b[0]]
        heap, cells = [(0.0, 0, 0)], []
        while heap:
            sum_, i, j = heapq.heappop(heap)
            if sum_ > self.radius:
                break
            cells.append(int(a[i]) * self.words + int(b[j]))
            # Each cell has one way in: along the second list, and along the first at its start.
            if j + 1 < len(b):
                heapq.heappush(heap, (near[0][i] + near[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (near[0][i + 1] + near[1][0], i + 1, 0))
        return cells


def _codebook(points: np.ndarray, words: int, rng, rounds: int = 10) -> np.ndarray:
    """k-means; a word without points stays where it is."""
    book = points[rng.choice(len(points), words, replace=False)]
    for _ in range(rounds):
        own = ((book * book).sum(1) - 2 * points @ book.T).argmin(1)
        n = np.bincount(own, minlength=words)
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def _turned(x: np.ndarray, cosine: float, rng) -> np.ndarray:
    """Vectors whose cosine with those of ``x`` is ``cosine``, in random directions."""
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    length = np.linalg.norm(side, axis=1)[:, None]
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-12)
    return cosine * x + np.sqrt(1 - cosine**2) * side


def _scaled(vectors) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.stack(vectors).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # so that no square overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _unpack(column, kind) -> np.ndarray:
    return _scaled([np.frombuffer(v, kind) for v in column])


def _pack(kind):
    """Vectors as bytes; those that link with nothing become null."""

    def packed(v):
        if v is None or len(v) == 0 or v.null_count:
            return None
        x = v.to_numpy(zero_copy_only=False).astype(kind)
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    def rows(batches):
        for batch in batches:
            vectors = [packed(v.values) if v.is_valid else None for v in batch.column(1)]
            dims = [None if v is None else len(v) // np.dtype(kind).itemsize for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
                names=["_id", "_dim", "_vec"],
            )

    return rows


def _entries(grid: Grid, kind, with_vectors: bool):
    """A vector's own cell (side 0) and the cells that its search visits (side 1)."""
    names = ["_cell", "_side", "_cid", "_rows"] + ["_home", "_vec"] * with_vectors

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                distances = grid.distances(_unpack([v.as_py() for v in part.column(2)], kind))
                own = grid.own_cells(distances)
                cells, sides, at = [], [], []
                for i, (first, second) in enumerate(zip(*distances)):
                    found = grid.visited(first, second)
                    cells += [int(own[i]), *found]
                    sides += [0] + [1] * len(found)
                    at += [i] * (len(found) + 1)
                for cut in range(0, len(at), OUT_ROWS):
                    take = pa.array(at[cut : cut + OUT_ROWS], pa.int32())
                    columns = [
                        pa.array(cells[cut : cut + OUT_ROWS], pa.int32()),
                        pa.array(sides[cut : cut + OUT_ROWS], pa.int32()),
                        part.column(0).take(take),
                        part.column(1).take(take),
                    ]
                    if with_vectors:
                        columns += [pa.array(own, pa.int32()).take(take), part.column(2).take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def _compare(grid, cosine, kind):
    """Links between the searching and the stored vectors of one pair of blocks.

    Gives each vector its number of links there (the stored one those that its own search
    does not meet) and the smallest vector that it is
    connected with inside the pair of blocks, so a block of any density gives no
    more rows than it has vectors.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"_a": [], "_b": [], "_links": []}).astype("int64")
        side = pdf["_side"].to_numpy()
        if side.all() or not side.any():
            return out
        cid, rows = pdf["_cid"].to_numpy(), pdf["_rows"].to_numpy()
        x = _unpack(pdf["_vec"], kind)
        asks, holds = np.flatnonzero(side), np.flatnonzero(side == 0)
        linked = (x[asks] @ x[holds].T >= cosine) & (cid[asks][:, None] != cid[holds][None, :])
        if not linked.any():
            return out
        nodes, at = np.unique(cid, return_inverse=True)
        ask, hold = at[asks], at[holds]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, ask, linked @ rows[holds])
        some = linked.any(0)
        unmet = linked[:, some] & ~grid.reached(x[holds[some]], pdf["_home"].to_numpy()[asks])
        np.add.at(links, hold[some], unmet.T @ rows[asks])
        label, before = np.arange(len(nodes)), None
        while before is None or (label != before).any():
            before = label.copy()
            np.minimum.at(label, ask, np.where(linked, label[hold][None, :], len(nodes)).min(1))
            np.minimum.at(label, hold, np.where(linked, label[ask][:, None], len(nodes)).min(0))
        stay = (links > 0) | (label != np.arange(len(nodes)))
        return pd.DataFrame({"_a": nodes[stay], "_b": nodes[label[stay]], "_links": links[stay]})

    return compare


def near_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cosine: float = 0.95,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "multi_index")
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    id_type = source.schema["_id"].dataType.simpleString()
    rows = scratch.save(source.mapInArrow(_pack(kind), f"_id {id_type}, _dim int, _vec binary"), "rows")
    classes = scratch.save(
        rows.where("_vec IS NOT NULL")
        .groupBy("_dim", "_vec")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_cid", F.monotonically_increasing_id()),
        "classes",
    )
    found = None
    for dim, n in sorted(classes.groupBy("_dim").count().collect()):
        one = _search(classes.where(F.col("_dim") == dim), n, kind, cosine, recall, scratch, f"found{dim}")
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(
            F.col("_id").alias(id_col),
            F.lit(0).cast("bigint").alias("n_links"),
            F.col("_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    links = found.groupBy(F.col("_a").alias("_cid")).agg(F.sum("_links").alias("_links"))
    label = components(found.where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), scratch, "near")
    named = scratch.save(
        classes.select("_cid", "_dim", "_vec", "_first", "_rows")
        .join(links, "_cid", "left")
        .join(label.withColumnRenamed("node", "_cid"), "_cid", "left")
        .select(
            "_dim",
            "_vec",
            "_first",
            (F.col("_rows") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"),
            F.coalesce("component", "_cid").alias("_comp"),
        ),
        "named",
    )
    least = named.groupBy("_comp").agg(F.min("_first").alias("_least"))
    known = scratch.save(named.join(least, "_comp").select("_dim", "_vec", "_links", "_least"), "known")
    lone = F.col("_vec").isNull()
    component = F.when(lone, F.col("_id")).otherwise(F.col("_least"))
    return rows.join(known, ["_dim", "_vec"], "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _search(classes, n, kind, cosine, recall, scratch, name) -> DataFrame:
    """``(_a, _b, _links)``: partial link counts and connecting edges of vectors of one dimension."""
    order = F.xxhash64("_vec")
    some = classes.where(in_sample(order, SAMPLE_ROWS, n)).select("_vec")
    sample = some.orderBy(order, "_vec").limit(SAMPLE_ROWS).collect()
    grid = Grid(_unpack([r[0] for r in sample], kind), n, cosine, recall)
    stored = classes.select("_cid", "_rows", "_vec")
    # One row per cell at most, so no more than MAX_WORDS squared.
    cells = (
        stored.mapInArrow(_entries(grid, kind, False), "_cell int, _side int, _cid bigint, _rows bigint")
        .groupBy("_cell")
        .agg(F.count_if(F.col("_side") == 0).alias("_held"), F.count_if(F.col("_side") == 1).alias("_asked"))
        .where("_held > 0 AND _asked > 0")
        .select("_cell", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("_held", "_asked")])
    )
    cells = scratch.save(cells, f"{name}_cells")
    entries = stored.mapInArrow(
        _entries(grid, kind, True), "_cell int, _side int, _cid bigint, _rows bigint, _home int, _vec binary"
    ).join(F.broadcast(cells), "_cell")
    held = F.col("_side") == 0
    own = F.pmod(F.xxhash64("_cid"), F.when(held, F.col("_held")).otherwise(F.col("_asked"))).cast("int")
    other = F.when(held, F.col("_asked")).otherwise(F.col("_held"))
    blocks = entries.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1)))
    pairs = blocks.select(
        "_cell",
        F.when(held, F.col("_own")).otherwise(F.col("_other")).alias("_hold_block"),
        F.when(held, F.col("_other")).otherwise(F.col("_own")).alias("_ask_block"),
        "_side",
        "_cid",
        "_rows",
        "_home",
        "_vec",
    )
    found = pairs.groupBy("_cell", "_hold_block", "_ask_block").applyInPandas(
        _compare(grid, cosine, kind), "_a bigint, _b bigint, _links bigint"
    )
    return scratch.save(found, name)
