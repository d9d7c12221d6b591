"""Alignment of two tokenizers over a corpus, with a fast path for tokens both have.

A text is encoded by a byte-level BPE (A) and by a SentencePiece model (B), both over one
space and the text.  Byte offsets where tokens of both end cut the tokens into groups, and the
last tokens of a group are linked.  How often an id pair is linked in the whole corpus is its
count.

Most groups are one A token and one B token of equal bytes.  An array of the length of A's
vocabulary holds for every A id the B id of the same bytes; such groups are counted in a
vector of that length, one a task, and looked up in the summed vector.  In any other group the last
tokens differ in bytes, so its pair is never one of the array.  Only these irregular pairs are
shuffled, summed per task before: the few most frequent ones are looked up in an array as well,
the rest by a join in which no key is frequent.

Tokens never reach from a character that is not white space into one that is, in either
vocabulary.  So a text is cut there, and what a piece of text becomes is computed once for
each different one that a task holds.  Where a vocabulary or text does not allow that, whole texts
are encoded.

Nulls, ties and the like
    A null or empty text, and one whose tokens do not spell one space and the text (as with
    U+2581 in it), has no tokens: all its numbers are 0 and its groups are empty.  Strings of
    special tokens are plain text.  Of two B ids of equal bytes the piece goes before the byte
    fallback.  A B id with several most frequent partners counts all of them as best.
    Repeated rows count each time.  An empty table gives an empty result.
"""

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photocat.llm.common import Scratch

# Pieces of text a task remembers, and as many that it has not met since; longer ones it forgets at once.
REMEMBERED, LONGEST = 200_000, 64
# Characters whose pieces of text are encoded together.
TOGETHER = 1 << 21
# Irregular pairs that are looked up in an array: those above this share of all, so no more than this.
FREQUENT = 65_536
# Irregular pairs a task sums before it hands them on.
HELD_PAIRS = 1_000_000
LIST_ROWS = 100_000
# White space to Python but not to the pattern of byte-level BPE, and what pieces write for a space.
NOT_CUT = "\x1c\x1d\x1e\x1f▁"
PIECE_OF_TEXT = re.compile(r"\s*\S+|\s+")
# Fixed value: the pattern that byte-level BPE cuts texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERN_CODE = ("ByteLevel", True)


def byte_characters() -> dict:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in [*((b, b) for b in shown), *((256 + i, b) for i, b in enumerate(hidden))]}


class ByteLevel:
    """A's encoder: ids of a text, and the bytes of every id."""

    def __init__(self, config: str):
        parsed = json.loads(config)
        special = {t["id"] for t in parsed["added_tokens"] if t["special"]}
        byte_of = byte_characters()
        vocabulary = {t: i for t, i in parsed["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special]))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in parsed["model"]["merges"]]
        made = [vocabulary[m] for m in merges]
        before = parsed["pre_tokenizer"]
        plain = (before["type"], before.get("use_regex")) == PATTERN_CODE and not before.get("add_prefix_space")
        # Merges in the order of ids are ranks, which another library applies several times faster.
        if plain and not parsed.get("normalizer") and made == sorted(made) and len(set(made)) == len(made):
            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            model = tokenizers.Tokenizer.from_str(config)
            model.encode_special_tokens = True
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids


class Pieces:
    """B's encoder: ids of a text after one space, and the bytes of every id."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.is_byte = [self.model.is_byte(i) for i in range(n)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode()
            for p, b in zip(pieces, self.is_byte, strict=True)
        ]
        self.space = self.model.piece_to_id("▁")
        # White space that some token takes together with what is before it; texts with it are not cut.
        self.fused = {c for p in pieces for c in re.findall(r"(?<=\S)\s", p.replace("▁", " "))}
        self.separable = " " not in self.fused and self.model.encode("a ")[1:] == [self.space]

    def encode(self, text: str) -> list:
        return self.model.encode(text)

    def encode_parts(self, parts: list) -> list:
        """Ids of each part of a text, None where they are not known from the part alone."""
        out = []
        # The model puts one space first, which is the part's own or has to be a token of its own.
        found = self.model.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        for part, ids in zip(parts, found, strict=True):
            if part == " ":
                out.append([self.space])
            elif part[0] == " ":
                out.append(ids)
            else:
                out.append(ids[1:] if ids[:1] == [self.space] else None)
        return out


class Aligner:
    def __init__(self, config: str, proto: bytes):
        self.a, self.b = ByteLevel(config), Pieces(proto)
        self.a_len = [len(x) for x in self.a.bytes]
        self.b_len = [len(x) for x in self.b.bytes]
        known = {}
        for i, found in enumerate(self.b.bytes):
            if found and (found not in known or self.b.is_byte[known[found]]):
                known[found] = i
        self.same = np.array([known.get(x, -1) if x else -1 for x in self.a.bytes], np.int64)
        self.partner = self.same.tolist()
        self.b_size = len(self.b.bytes)
        self.not_cut = re.compile(f"[{re.escape(NOT_CUT + ''.join(sorted(self.b.fused)))}]")
        self.parts: dict = {}
        self.older: dict = {}
        self.ids = list(range(max(len(self.a.bytes), self.b_size)))

    def grouped(self, a_ids: list, b_ids: list) -> tuple:
        """(n_a, n_b, n_groups, groups, ids of regular groups, pairs of irregular groups)."""
        a_len, b_len, partner = self.a_len, self.b_len, self.partner
        out, fast, odd = [], [], []
        a_from = b_from = b_at = ahead = 0  # bytes of B tokens beyond those of A tokens
        for a_at, a in enumerate(a_ids, 1):
            ahead -= a_len[a]
            while ahead < 0:
                b = b_ids[b_at]
                ahead += b_len[b]
                b_at += 1
            if ahead:
                continue
            if a_at - a_from == 1 and b_at - b_from == 1:
                out.append(f"{a}|{b}")
                if partner[a] == b:
                    fast.append(a)
                else:
                    odd.append(a * self.b_size + b)
            else:
                left, right = a_ids[a_from:a_at], b_ids[b_from:b_at]
                out.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                odd.append(a * self.b_size + b)
            a_from, b_from = a_at, b_at
        return len(a_ids), len(b_ids), len(out), ";".join(out), fast, odd

    def learn(self, parts: set) -> dict:
        """``grouped`` of every part, None where the part alone does not tell."""
        known, older, missing, long = self.parts, self.older, [], {}
        for part in parts:
            if part not in known:
                found = older.get(part)
                if found is None:
                    missing.append(part)
                else:
                    known[part] = found
        ids = self.ids  # one object for each id, however many parts hold it
        for part, b_ids in zip(missing, self.b.encode_parts(missing), strict=True):
            a_ids = self.a.encode(part)
            found = None
            if b_ids and self._spell(a_ids, b_ids, part.encode()):
                n_a, n_b, n_groups, groups, fast, odd = self.grouped(a_ids, b_ids)
                found = n_a, n_b, n_groups, groups, tuple([ids[a] for a in fast]), tuple(odd)
            (known if len(part) <= LONGEST else long)[part] = found
        if len(known) >= REMEMBERED:
            self.older, self.parts = known, {}
        return known | long if long else known

    def _spell(self, a_ids, b_ids, data) -> bool:
        a, b = self.a.bytes, self.b.bytes
        return b"".join([a[i] for i in a_ids]) == data and b"".join([b[i] for i in b_ids]) == data

    def whole(self, text: str):
        """``grouped`` of a text that is not cut, None if its tokens do not spell it."""
        a_ids, b_ids = self.a.encode(" " + text), self.b.encode(text)
        return self.grouped(a_ids, b_ids) if self._spell(a_ids, b_ids, (" " + text).encode()) else None

    def align(self, texts: list) -> list:
        """``grouped`` of each text, None for texts without tokens."""
        cut = [
            PIECE_OF_TEXT.findall(" " + t) if t and self.b.separable and not self.not_cut.search(t) else None
            for t in texts
        ]
        known = self.learn(set(chain.from_iterable(parts for parts in cut if parts)))
        out = []
        for text, parts in zip(texts, cut, strict=True):
            found = [known[p] for p in parts] if parts else [None]
            if None in found:
                out.append(self.whole(text) if text else None)
                continue
            n_a, n_b, n_groups, groups, fast, odd = zip(*found, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), chain(*fast), chain(*odd)))
        return out


@lru_cache(maxsize=1)
def _aligner(config: str, proto: bytes) -> Aligner:
    """One a worker process."""
    return Aligner(config, proto)


DOCUMENT, VECTOR, PAIRS = 0, 1, 2
_LISTS = "_fast array<int>, _fast_n array<bigint>, _odd array<bigint>, _odd_n array<bigint>"


def _encoded(shared, with_groups):
    """A row per text, and the sums of the task: one vector, and lists of irregular pairs."""

    def rows(batches):
        aligner = _aligner(*shared.value)
        vector = np.zeros(len(aligner.same), np.int64)
        codes, counts, held = [], [], 0
        kept_type = None

        def summed():
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def totals(role, fast, odd):
            n = len(fast) or len(odd)
            return pa.RecordBatch.from_pydict(
                {
                    "_role": pa.array([role] * n, pa.int8()),
                    "_kept": pa.nulls(n, kept_type),
                    **{c: pa.array([0] * n, pa.int64()) for c in ("n_a", "n_b", "n_groups")},
                    "groups_sha256": pa.array([""] * n),
                    "groups": pa.array([None] * n, pa.string()),
                    "_fast": pa.array([f[0] for f in fast] or [[]] * n, pa.list_(pa.int32())),
                    "_fast_n": pa.array([f[1] for f in fast] or [[]] * n, pa.list_(pa.int64())),
                    "_odd": pa.array([o[0] for o in odd] or [[]] * n, pa.list_(pa.int64())),
                    "_odd_n": pa.array([o[1] for o in odd] or [[]] * n, pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            kept_type = batch.column(0).type
            numbers, shas, texts, lists = [], [], [], []
            for found in chain.from_iterable(map(aligner.align, _slices(batch.column(1).to_pylist()))):
                n_a, n_b, n_groups, groups, fast, odd = found or (0, 0, 0, "", (), ())
                fast, fast_n = np.unique(np.fromiter(fast, np.int32), return_counts=True)
                odd, odd_n = np.unique(np.fromiter(odd, np.int64), return_counts=True)
                vector[fast] += fast_n
                if len(odd):
                    codes.append(odd)
                    counts.append(odd_n)
                    held += len(odd)
                numbers.append((n_a, n_b, n_groups))
                shas.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                texts.append(groups if with_groups else None)
                lists.append((fast, fast_n, odd, odd_n))
            n_a, n_b, n_groups = np.array(numbers, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(shas), DOCUMENT, np.int8)),
                    batch.column(0),
                    *map(pa.array, (n_a, n_b, n_groups)),
                    pa.array(shas),
                    pa.array(texts, pa.string()),
                    *[_list_array([x[i] for x in lists], kind) for i, kind in enumerate((np.int32, *[np.int64] * 3))],
                ],
                names=["_role", "_kept", "n_a", "n_b", "n_groups", "groups_sha256", "groups",
                       "_fast", "_fast_n", "_odd", "_odd_n"],
            )
            if held > HELD_PAIRS:
                found, n = summed()
                codes, counts, held = [found], [n], len(found)
                if held > HELD_PAIRS // 2:
                    yield totals(PAIRS, [], _cut(found, n))
                    codes, counts, held = [], [], 0
        used = np.flatnonzero(vector)
        if len(used):
            yield totals(VECTOR, _cut(used, vector[used]), [])
        if codes:
            yield totals(PAIRS, [], _cut(*summed()))

    return rows


def _slices(texts: list):
    """``texts`` in runs of about ``TOGETHER`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(values, counts):
    return [(values[i : i + LIST_ROWS], counts[i : i + LIST_ROWS]) for i in range(0, len(values), LIST_ROWS)]


def _list_array(arrays, kind):
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)
    return pa.ListArray.from_arrays(ends, pa.array(values))


def align(
    docs: DataFrame, byte_level: str, pieces: str, columns: list, text_col: str = "text", with_groups: bool = False
) -> tuple:
    """(documents, pairs) for the tokenizer files at ``byte_level`` (A) and ``pieces`` (B).

    ``documents`` has ``columns`` of each row with n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256, and the ``groups`` themselves on demand.  ``pairs`` is ``(a_id, b_id, n)``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    with open(byte_level, encoding="utf-8") as a_file, open(pieces, "rb") as b_file:
        files = a_file.read(), b_file.read()
    shared = spark.sparkContext.broadcast(files)
    aligner = _aligner(*files)
    same, b_size = aligner.same, aligner.b_size
    kept = docs.select(F.struct(*columns).alias("_kept"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_role", T.ByteType()), T.StructField("_kept", kept.schema["_kept"].dataType)])
    for name in ("n_a", "n_b", "n_groups"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("groups", "string")
    lists = T._parse_datatype_string(_LISTS)
    encoded = kept.mapInArrow(_encoded(shared, with_groups), T.StructType([*schema, *lists]))
    encoded = scratch.save(encoded.withColumn("_row", F.monotonically_increasing_id()), "encoded")
    # Regular groups: no more rows than A has ids.
    regular = _exploded(encoded.where(F.col("_role") == VECTOR), "_fast").groupBy("_key").agg(F.sum("_n").alias("n"))
    fast = np.zeros(len(same), np.int64)
    for key, n in regular.collect():
        fast[key] = n
    odd = _exploded(encoded.where(F.col("_role") == PAIRS), "_odd").groupBy("_key").agg(F.sum("_n").alias("n"))
    odd = scratch.save(odd, "odd")
    # The highest count of each B id: no more rows than B has ids.
    best = np.zeros(b_size, np.int64)
    np.maximum.at(best, same[same >= 0], fast[same >= 0])
    for b, n in odd.groupBy((F.col("_key") % b_size).alias("b")).agg(F.max("n")).collect():
        best[b] = max(best[b], n)
    total = odd.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    least = total // FREQUENT
    frequent = sorted(tuple(r) for r in odd.where(F.col("n") > least).collect())
    keys = np.array([k for k, _ in frequent], np.int64)
    counts = np.array([n for _, n in frequent], np.int64)
    tables = spark.sparkContext.broadcast((fast, same, best, keys, counts, b_size))
    known = encoded.where(F.col("_role") == DOCUMENT)
    scored = known.select("_row", "_fast", "_fast_n", "_odd", "_odd_n").mapInArrow(
        _scored(tables), "_row bigint, _best bigint, _sum bigint, _odd array<bigint>, _odd_n array<bigint>"
    )
    scored = scratch.save(scored, "scored")
    highest = spark.createDataFrame([(b, int(n)) for b, n in enumerate(best) if n], "_b bigint, _top bigint")
    rare = odd.where(F.col("n") <= least).withColumn("_b", F.col("_key") % b_size).join(F.broadcast(highest), "_b")
    rest = (
        _exploded(scored, "_odd", "_row")
        .join(rare, "_key")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("n") == F.col("_top"), F.col("_n")).otherwise(0)).alias("_best"),
            F.sum(F.col("n") * F.col("_n")).alias("_sum"),
        )
    )
    sums = scored.select("_row", "_best", "_sum").union(rest).groupBy("_row").agg(
        F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum")
    )
    documents = known.join(sums, "_row").select(
        "_kept.*", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256",
        *(["groups"] if with_groups else []),
    )
    pairs = odd.select(
        F.call_function("div", F.col("_key"), F.lit(b_size)).alias("a_id"), (F.col("_key") % b_size).alias("b_id"), "n"
    )
    made = [(int(a), int(same[a]), int(fast[a])) for a in np.flatnonzero(fast)]
    return documents, pairs.union(spark.createDataFrame(made, "a_id bigint, b_id bigint, n bigint"))


def _exploded(rows: DataFrame, name: str, *others) -> DataFrame:
    """``(others, _key, _n)`` of the two lists ``name`` and ``name``_n."""
    both = F.arrays_zip(F.col(name).alias("k"), F.col(f"{name}_n").alias("n"))
    return rows.select(*others, F.inline(both).alias("_key", "_n"))


def _scored(tables):
    """What the arrays tell about each text, and the irregular pairs that they do not hold."""

    def rows(batches):
        fast, same, best, keys, counts, b_size = tables.value
        is_best = (fast == best[same]) & (same >= 0)
        frequent_best = counts == best[keys % b_size]
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = batch.num_rows

            def flat(name):
                return column[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64)

            def owner(name):
                return np.repeat(np.arange(n), column[name].value_lengths().to_numpy(zero_copy_only=False))

            def per_row(at, values):
                out = np.zeros(n, np.int64)
                np.add.at(out, at, values)
                return out

            ids, times, at = flat("_fast"), flat("_fast_n"), owner("_fast")
            n_best, total = per_row(at, times * is_best[ids]), per_row(at, times * fast[ids])
            odd, times, at = flat("_odd"), flat("_odd_n"), owner("_odd")
            place = np.minimum(np.searchsorted(keys, odd), max(len(keys) - 1, 0))
            held = keys[place] == odd if len(keys) else np.zeros(len(odd), bool)
            place = place[held]
            n_best += per_row(at[held], times[held] * frequent_best[place])
            total += per_row(at[held], times[held] * counts[place])
            ends = np.concatenate(([0], np.cumsum(np.bincount(at[~held], minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    column["_row"], pa.array(n_best), pa.array(total),
                    pa.ListArray.from_arrays(ends, pa.array(odd[~held])),
                    pa.ListArray.from_arrays(ends, pa.array(times[~held])),
                ],
                names=["_row", "_best", "_sum", "_odd", "_odd_n"],
            )

    return rows
