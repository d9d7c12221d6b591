"""SentencePiece encoding with N-best segmentation, and decoding.

All ways to cut a text into vocabulary pieces form a lattice; a way's score is the sum
of its pieces' scores.  A forward Viterbi pass gives the best score of every prefix.
Read backwards from the end, that is the exact remaining score, so an A* search that
starts at the end pops complete ways in the order of their scores.

Pieces never span the border between a word and the white space before the next, nor a
line break, so the lattice of a text is a chain of small ones.  Distinct segments of a
batch are solved together: one numpy pass forward, one backward, which also gives the
gap between the best and the second way.  The N best ways of a text change only its
N - 1 segments of smallest gap; A* lists the ways of those, and a second best-first
search combines them.

Characters without a piece are written as byte pieces; in the lattice such a character
costs as much as the rarest piece and ten more.

Nulls, ties and the like
    A null text gives null ids; an empty text gives no ids, score 0 and one way.  Of
    ways of equal score the one with longer last pieces comes first (in the best
    way), otherwise the one that changes the earlier segment.  A text with fewer than
    N ways gives all it has.  Decoding restores every text exactly, except that
    U+2581, which the format uses for a space, comes back as a space.  Rows are
    independent.  An empty table gives an empty result.
"""

import heapq
import re
from array import array
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photocat.llm.shingles import mix

MARK = "▁"
NBEST = 3
# Segments up to this length are solved together; longer ones one by one.
WIDE = 32
# Segments solved together are of similar length: arrays are as high as the longest one.
BANDS = (5, 7, 9, 11, 14, 20, WIDE)
# Distinct segments a task remembers, and texts it splits at once.
MEMORY, TEXTS, TOGETHER = 400_000, 200, 4_000
# A table of this many bits tells most strings apart from the pieces of their length.
SIEVE = 18
UNKNOWN_MALUS = 10.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(model_path: str) -> list:
    """(piece, score, kind) of every id; kinds are ``piece``, ``byte`` and ``other``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kinds = ((model.is_byte, "byte"), (model.is_control, "other"), (model.is_unknown, "other"), (model.is_unused, "other"))
    return [
        (model.id_to_piece(i), model.get_score(i), next((kind for test, kind in kinds if test(i)), "piece"))
        for i in range(model.vocab_size())
    ]


class Pieces:
    """The vocabulary, ready for looking up substrings, one by one or many at once."""

    def __init__(self, pieces: list):
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        self.ids = {p: i for p, _, i in normal}
        self.scores = np.array([s for _, s, _ in pieces])
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown = min((s for _, s, _ in normal if s > -1e8), default=0.0) - UNKNOWN_MALUS
        self.raw = [
            bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "other" else p.encode()
            for p, _, kind in pieces
        ]
        # By length: sorted hashes of the pieces, their ids, and which leading bits of a hash occur.
        self.tables = []
        for size in range(1, self.longest + 1):
            found = [(p, i) for p, _, i in normal if len(p) == size]
            points = np.array([[ord(c) for c in p] for p, _ in found], np.uint64).reshape(-1, size)
            hashes = np.zeros(len(found), np.uint64)
            for k in range(size):
                hashes = mix(hashes * _STEP + points[:, k] + np.uint64(1))
            order = hashes.argsort()
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[hashes >> np.uint64(64 - SIEVE)] = True
            self.tables.append((hashes[order], np.array([i for _, i in found], np.int64)[order], sieve))
        joined = "".join(p for p in self.ids if len(p) > 1)
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        stop = "" if inner else MARK
        run = f"{MARK}*[^{stop}{alone}]+|{MARK}+" if stop else f"[^{alone}]+" if alone else "(?s:.+)"
        self.segments = re.compile(f"{run}|[{alone}]" if alone else run)

    def split(self, text: str) -> list:
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else []

    def spelled(self, char: str) -> list:
        """Byte pieces of a character without a piece (id 0 where the vocabulary has none)."""
        return [self.bytes_at.get(b, 0) for b in char.encode("utf-8", "replace")]

    def raw_bytes(self, ids) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def readable(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self.readable(self.raw_bytes(ids))


def edges_of(segment: str, vocabulary: Pieces) -> list:
    """By end position: (start, score, ids) of every piece that ends there."""
    out = [[]]
    for end in range(1, len(segment) + 1):
        here = []
        for start in range(max(0, end - vocabulary.longest), end):
            i = vocabulary.ids.get(segment[start:end])
            if i is not None:
                here.append((start, float(vocabulary.scores[i]), [i]))
        if not here or here[-1][0] != end - 1:
            here.append((end - 1, vocabulary.unknown, vocabulary.spelled(segment[end - 1])))
        out.append(here)
    return out


def nbest_ways(segment: str, vocabulary: Pieces, n: int) -> list:
    """The ``n`` best (score, ids) of a segment, by A* from its end."""
    edges = edges_of(segment, vocabulary)
    best = [0.0] + [-np.inf] * len(segment)
    for end in range(1, len(segment) + 1):
        best[end] = max(best[start] + score for start, score, _ in edges[end])
    heap, pushed, found = [(-best[-1], 0, len(segment), 0.0, ())], 0, []
    while heap and len(found) < n:
        _, _, at, done, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                piece, path = path
                ids += piece
            found.append((done, ids))
            continue
        for start, score, ids in edges[at]:
            pushed += 1
            total = done + score
            heapq.heappush(heap, (-(best[start] + total), pushed, start, total, (ids, path)))
    return found


def best_ways(segments: list, vocabulary: Pieces) -> tuple:
    """(scores, gaps to the second ways, ids) of segments of at most ``WIDE`` characters.

    All arrays have one row per position and one column per segment.
    """
    width, n = max(map(len, segments)), len(segments)
    sizes = np.array([len(s) for s in segments])
    flat = np.frombuffer("".join(segments).encode("utf-32-le", "replace"), np.uint32)
    points = np.zeros((n, width), np.uint64)
    points[np.arange(width)[None, :] < sizes[:, None]] = flat
    points = np.ascontiguousarray(points.T)
    lengths = []
    scores = np.full((min(vocabulary.longest, width), width, n), -np.inf)
    pieces = np.full(scores.shape, -1, np.int32)
    running = np.zeros((width, n), np.uint64)
    for size in range(1, len(scores) + 1):
        starts = width - size + 1
        running = mix(running[:starts] * _STEP + points[size - 1 :] + np.uint64(1))
        hashes, of, sieve = vocabulary.tables[size - 1]
        inside = np.arange(starts)[:, None] + size <= sizes[None, :]
        score, hit = scores[size - 1], ()
        if len(hashes):
            likely = np.flatnonzero(inside & sieve[running >> np.uint64(64 - SIEVE)])
            wanted = running.ravel()[likely]
            at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            hit = hashes[at] == wanted
            likely, found = likely[hit], of[at[hit]]
            pieces[size - 1].ravel()[likely] = found
            score.ravel()[likely] = vocabulary.scores[found]
        if size == 1:
            score[inside & (pieces[0] < 0)] = vocabulary.unknown
        if size == 1 or len(hit) and hit.any():
            lengths.append(size)
    # Every character has an edge of its own, so each prefix of a segment is reached.
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0
    step = np.zeros((width + 1, n), np.int8)
    for end in range(1, width + 1):
        for size in lengths:
            if size > end:
                break
            total = forward[end - size] + scores[size - 1, end - size]
            better = total >= forward[end]
            np.copyto(forward[end], total, where=better)
            np.copyto(step[end], size, where=better)
    columns = np.arange(n)
    backward = np.full((width + 1, n), -np.inf)
    backward[sizes, columns] = 0
    for start in range(width - 1, -1, -1):
        for size in lengths:
            if start + size <= width:
                np.maximum(backward[start], scores[size - 1, start] + backward[start + size], out=backward[start])
    # Walk all segments back from their ends at once, noting the pieces on the way.
    used = np.zeros(scores.shape, bool)
    left, at, walked = columns, sizes.copy(), []
    while len(left):
        size_of = step[at, left].astype(np.int64)
        at = at - size_of
        used[size_of - 1, at, left] = True
        walked.append((left, at, pieces[size_of - 1, at, left]))
        more = at > 0
        left, at = left[more], at[more]
    second = np.full(n, -np.inf)
    for size in lengths:
        starts = width - size + 1
        through = forward[:starts] + scores[size - 1, :starts] + backward[size:]
        through[used[size - 1, :starts]] = -np.inf
        np.maximum(second, through.max(0), out=second)
    best = forward[sizes, columns]
    return best.tolist(), (best - second).tolist(), _in_order(segments, vocabulary, *map(np.concatenate, zip(*walked)))


def _in_order(segments: list, vocabulary: Pieces, column, start, piece) -> list:
    """Ids of each segment from its pieces' columns and starts; -1 is a character to be spelled."""
    order = np.lexsort((start, column))
    ends = np.cumsum(np.bincount(column, minlength=len(segments))).tolist()
    flat = piece[order].tolist()
    ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
    for c in np.unique(column[piece < 0]).tolist():
        places = start[order][ends[c] - len(ids[c]) : ends[c]].tolist()
        spelled = ([i] if i >= 0 else vocabulary.spelled(segments[c][at]) for i, at in zip(ids[c], places))
        ids[c] = list(chain.from_iterable(spelled))
    return ids


class Encoder:
    """Encodes texts and remembers segments it has met."""

    def __init__(self, pieces: list, n: int = NBEST):
        self.vocabulary, self.n = Pieces(pieces), n
        self._forget()

    def _forget(self):
        self.at, self.ways = {}, {}
        # All ids in a row; ends of each segment's, its bytes as decoded from them.
        self.ids, self.ends, self.raw = array("i"), array("q", [0]), []
        self.scores, self.gaps = array("d"), array("d")

    def _remember(self, segments, scores, gaps, ids):
        self.at.update(zip(segments, range(len(self.raw), len(self.raw) + len(segments))))
        self.ends.extend(accumulate(map(len, ids), initial=self.ends.pop()))
        self.ids.extend(chain.from_iterable(ids))
        self.raw.extend(map(self.vocabulary.raw_bytes, ids))
        self.scores.extend(scores)
        self.gaps.extend(gaps)

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        """Ids of the segments with these numbers, one after the other."""
        ends = np.frombuffer(self.ends, np.int64)
        first, sizes = ends[at], ends[at + 1] - ends[at]
        shift = first - np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.frombuffer(self.ids, np.int32)[np.repeat(shift, sizes) + np.arange(sizes.sum())]

    def learn(self, texts: list) -> list:
        """Segments of each text; afterwards all of them are known."""
        if len(self.at) > MEMORY:
            self._forget()
        parts = [self.vocabulary.split(t) if t is not None else None for t in texts]
        new = [s for s in set().union(*[p for p in parts if p]) if s not in self.at]
        bands = [[] for _ in BANDS]
        for segment in new:
            if len(segment) <= WIDE:
                bands[bisect_left(BANDS, len(segment))].append(segment)
        for band in bands:
            for at in range(0, len(band), TOGETHER):
                some = band[at : at + TOGETHER]
                self._remember(some, *best_ways(some, self.vocabulary))
        for segment in new:
            if len(segment) > WIDE:
                ways = nbest_ways(segment, self.vocabulary, max(self.n, 2))
                gap = ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf
                self._remember([segment], [ways[0][0]], [gap], [ways[0][1]])
        return parts

    def encode(self, segments: list) -> tuple:
        """(ids, best score, [(score, [(segment, ids)])] of the ways after the best, decoded text)."""
        numbers = list(map(self.at.__getitem__, segments))
        if not numbers:
            return np.empty(0, np.int32), 0.0, [], ""
        at = np.array(numbers)
        ids = self.ids_of(at)
        text = self.vocabulary.readable(b"".join(map(self.raw.__getitem__, numbers)))
        score = float(np.frombuffer(self.scores)[at].sum())
        gaps = np.frombuffer(self.gaps)[at]
        near = np.arange(len(gaps))
        if len(gaps) > self.n - 1:
            limit = np.partition(gaps, self.n - 2)[self.n - 2] if self.n > 1 else -1.0
            near = np.flatnonzero(gaps <= limit)
            near = near[np.argsort(gaps[near], kind="stable")[: self.n - 1]]
        near = sorted(near[np.isfinite(gaps[near])].tolist())
        ways = [self._ways(segments[i]) for i in near]
        others = []
        for loss, choice in _combined([[w[0][0] - v for v, _ in w] for w in ways], self.n)[1:]:
            changes = [(near[k], ways[k][c][1]) for k, c in enumerate(choice) if c]
            others.append((score - loss, changes))
        return ids, score, others, text

    def _ways(self, segment: str) -> list:
        if segment not in self.ways:
            self.ways[segment] = nbest_ways(segment, self.vocabulary, self.n)
        return self.ways[segment]


def _combined(losses: list, n: int) -> list:
    """The ``n`` smallest sums of one loss from each list, with the choice made in each."""
    start = (0,) * len(losses)
    heap, seen, out = [(0.0, [-c for c in start], start)], {start}, []
    while heap and len(out) < n:
        loss, _, choice = heapq.heappop(heap)
        out.append((loss, choice))
        for k, options in enumerate(losses):
            if choice[k] + 1 < len(options):
                after = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                if after not in seen:
                    seen.add(after)
                    total = sum(options[c] for options, c in zip(losses, after))
                    heapq.heappush(heap, (total, [-c for c in after], after))
    return out


WAY = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "changes",
            T.ArrayType(
                T.StructType(
                    [T.StructField("segment", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
                )
            ),
        ),
    ]
)
_WAY_ARROW = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("changes", pa.list_(pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", n: int = NBEST, columns: list | None = None
) -> DataFrame:
    """``columns`` (all by default) with ``ids``, ``score``, ``other_ways`` and ``restored`` of the text.

    ``other_ways`` holds the ways after the best one as changes of single segments;
    ``restored`` tells whether decoding ``ids`` gave the text back.
    """
    names = docs.columns if columns is None else columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"), F.col(text_col).alias("_text"))
    shared = _shared_pieces(docs.sparkSession, model_path)

    def rows(batches):
        encoder = Encoder(shared.value, n)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [t.as_py() for t in part.column(1)]
                ids, scores, others, restored = [], [], [], []
                for text, segments in zip(texts, encoder.learn(texts)):
                    found = (None,) * 4 if segments is None else encoder.encode(segments)
                    ids.append(found[0])
                    scores.append(found[1])
                    others.append(
                        found[2]
                        and [
                            {"score": s, "changes": [{"segment": k, "ids": v} for k, v in changes]}
                            for s, changes in found[2]
                        ]
                        if found[2] is not None
                        else None
                    )
                    restored.append(found[3] == text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(scores, pa.float64()),
                        pa.array(others, _WAY_ARROW),
                        pa.array(restored, pa.bool_()),
                    ],
                    names=["_kept", "_ids", "_score", "_ways", "_restored"],
                )

    schema = (
        T.StructType([kept.schema["_kept"]])
        .add("_ids", T.ArrayType(T.IntegerType()))
        .add("_score", "double")
        .add("_ways", T.ArrayType(WAY))
        .add("_restored", "boolean")
    )
    return kept.mapInArrow(rows, schema).select(
        "_kept.*",
        F.col("_ids").alias("ids"),
        F.col("_score").alias("score"),
        F.col("_ways").alias("other_ways"),
        F.col("_restored").alias("restored"),
    )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns with the text of ``ids_col`` as ``decoded``."""
    kept = encoded.select(F.struct("*").alias("_kept"), F.col(ids_col).alias("_ids"))
    shared = _shared_pieces(encoded.sparkSession, model_path)

    def rows(batches):
        vocabulary = Pieces(shared.value)
        for batch in batches:
            texts = [None if v is None else vocabulary.decode(v) for v in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_kept", "_text"])

    out = kept.mapInArrow(rows, T.StructType([kept.schema["_kept"]]).add("_text", "string"))
    return out.select("_kept.*", F.col("_text").alias("decoded"))


def _shared_pieces(spark: SparkSession, model_path: str):
    return spark.sparkContext.broadcast(read_pieces(model_path))
