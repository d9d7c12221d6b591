"""The trie against a plain trie of lists, with sparse tables of every size, and odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_support import SF

from photocat.llm import prefix_trie as P
from photocat.llm.queries import QUERIES

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, every=20, heads=4):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        convs.setdefault(conv, []).append(((turn is not None, turn or 0), digest, words))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = convs.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]  # as SQL, towards 0
    members, words, kids, leaves, saved = {}, {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            path = tuple(k for k, _ in turns[:d])
            members.setdefault(path, []).append(c)
            words[path] = turns[d - 1][1] if d else 0
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(members[path]) - 1) * words[path] + sum(saved[k] for k in below)
    out = []
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(built[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append(
            (min(found), len(path), up, len(found), len(kids.get(path, [])), leaves[path], saved[path],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def nodes(turns, **how):
    got = P.trie(P.with_shared_heads(P.sequences(turns)), **how)
    assert got.columns[-2:] == ["first_row", "last_row"]
    return sorted((tuple(r)[:8] for r in got.collect()), key=str)


def branching(seed, n=120, longest=6):
    """Conversations that share beginnings often, with copies, gaps in ids and repeated turns."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randint(0, 70), rng.randint(-30, 400)])
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b c", "", None])))
    return rows


def test_searches_over_the_sparse_table():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 9, 50):
        values = rng.integers(-1, 5, n)
        levels = P.sparse_table(values)
        at, depth = (v.ravel() for v in np.meshgrid(np.arange(-1, n), np.arange(-1, 7)))
        left = [max((j for j in range(a + 1) if values[j] < d), default=-1) for a, d in zip(at, depth, strict=True)]
        right = [min((j for j in range(a, n) if values[j] < d), default=n) for a, d in zip(at + 1, depth, strict=True)]
        assert P.reach_left(levels, at, depth).tolist() == left
        assert P.reach_right(levels, at + 1, depth).tolist() == right
        first = rng.integers(0, n, 30)
        last = np.array([rng.integers(f, n) for f in first])
        assert P.range_min(levels, first, last).tolist() == [values[f : g + 1].min() for f, g in zip(first, last, strict=True)]


@pytest.mark.parametrize("block_rows", [2, 5, 8192])
def test_equals_a_plain_trie(spark, block_rows):
    rows = branching(block_rows)
    got = nodes(spark.createDataFrame(rows, COLUMNS).repartition(3), block_rows=block_rows, piece_ids=3)
    assert got == brute(rows)


def test_hot_beginnings_and_copies(spark):
    """A third of all conversations is one text, a third has one first turn."""
    rows = [(i * 20 + 1, t, "user", f"same {t}") for i in range(100) for t in range(3)]
    rows += [(i * 20 + 3, t, "user", f"same {t}" if t == 0 else f"own {i} {t}") for i in range(100) for t in range(3)]
    rows += [(i * 20 + 5, t, "user", f"other {i} {t}") for i in range(100) for t in range(2)]
    got = nodes(spark.createDataFrame(rows, COLUMNS), block_rows=7, piece_ids=9)
    assert got == brute(rows)


def test_crowded_parents_are_found_both_ways(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWDED", 10**9)
    rows = [(i * 20, t, "user", f"{'first' if t == 0 else i} {t}") for i in range(150) for t in range(2)]
    assert nodes(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_odd_tables(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "null turn"), (1, 0, None, None), (1, 0, "", ""),
        (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 5, "user", ""), (21, 0, "u", "ser"), (22, 0, "us", "er"),
        (20, 0, "user", "base"), (-3, 1, "user", "negative"), (40, 1, "user", " ".join(["long"] * 50_000)),
    ]
    extra = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], COLUMNS + ", _index int, _key string")
    assert nodes(extra) == brute(rows)
    assert nodes(spark.createDataFrame([], COLUMNS)) == []
    one = [(7, 0, "user", "only")]
    assert nodes(spark.createDataFrame(one, COLUMNS)) == brute(one)


def test_turnless_conversations_end_at_the_root(spark):
    # No conversation 20 gives a head, and the only turn lies in the part that is replaced.
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    got = nodes(spark.createDataFrame([(conv, 0, "user", "x")], COLUMNS))
    assert got == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_intervals_are_runs_of_sorted_rows(spark):
    turns = spark.createDataFrame(branching(4), COLUMNS)
    got = P.trie(P.with_shared_heads(P.sequences(turns)), block_rows=4).collect()
    distinct = sum(r.ends_sha256 != hashlib.sha256(b"").hexdigest() for r in got)
    root = next(r for r in got if r.depth == 0)
    assert (root.first_row, root.last_row) == (0, distinct - 1)
    for r in got:
        inside = [c for c in got if c.first_row >= r.first_row and c.last_row <= r.last_row and c.depth == r.depth + 1]
        assert len(inside) == r.n_children


def test_whole_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op13_lcp_range_trie"](spark, SF).collect()), key=str)
    assert got == brute([tuple(r) for r in turns])
