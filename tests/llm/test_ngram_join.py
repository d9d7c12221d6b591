import os
import random
import re
import time

import numpy as np
import pytest

from photocat.llm import ngram_join as J
from photocat.llm.common import FREE_SHUFFLES, Scratch, components
from photocat.llm.shingles import shingle_set, word_hashes


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def brute(rows, k, num, den):
    """Sorted (id, set size, component)."""
    sets = []
    for i, text in rows:
        w = words_of(text)
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()))
    group = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for a, (i, x) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if group[b] == group[a] and sets[b][0] is not None]
        out.append((i, len(x), i if not x else min(ids, default=None)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.75:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[: max(1, len(words) - rng.randrange(1, 6))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 6, 9, 13, 18, 30, 60, 150, 300]))]
            if rng.random() < 0.5:
                words += line
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, num):
    rows = near_copies(num)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(J.jaccard_groups(df, k=k, num=num)) == brute(rows, k, num, 100)


def test_chain_of_similar_texts(spark):
    """Neighbours are linked, ends are not: lists need more than their first pivot."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 200 - 3 * i], *[f"x{j}" for j in range(3 * i)]])) for i in range(40)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(J.jaccard_groups(df, k=4, num=85)) == brute(rows, 4, 85, 100)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(J.jaccard_groups(odd_docs)) == brute(rows, 5, 80, 100)
    kept = J.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 10, 2, 3, 4, 5, 6, 8, 9]


def test_each_component_keeps_one_row_whatever_the_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a + " end", " ".join(f"x{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    rows = [
        (1, a, "p"), (5, near, "p"), (5, other, "p"), (None, third, "q"), (None, third + " z", "q"), (7, "", "e"), (7, "", "e"),
        (9, "same row", "s"), (9, "same row", "s"), (9, "same row", "r"), (None, near, "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    kept = [tuple(r) for r in J.keep_one_each(docs).collect()]
    assert sorted(r for r in kept if r[0] is not None) == [(1, a, "p"), (5, other, "p"), (7, "", "e"), (7, "", "e"), (9, "same row", "r")]
    assert [r[1] in (third, third + " z") for r in kept if r[0] is None] == [True]


def shuffle_files(spark):
    """Bytes of each shuffle file that Spark holds on this machine."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    paths = [f"{d}/{f}" for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")]
    return {path: os.path.getsize(path) for path in paths if os.path.exists(path)}


def test_shuffles_go_with_the_table_they_were_for(spark, monkeypatch):
    df = spark.createDataFrame(near_copies(7), "doc_id bigint, text string").repartition(3)
    before, left, save = set(shuffle_files(spark)), {}, Scratch.save

    def measured(self, frame, name):
        table = save(self, frame, name)
        deadline = time.time() + 10  # Spark deletes them in the background
        while True:
            left[name] = sum(n for path, n in shuffle_files(spark).items() if path not in before)
            if left[name] < 5_000 or time.time() > deadline:
                return table
            time.sleep(0.1)

    monkeypatch.setattr(Scratch, "save", measured)
    assert J.keep_one_each(df).count() > 0
    assert len(left) > 20 and max(left.values()) < 5_000, left
    assert spark.conf.get(FREE_SHUFFLES, "false") == "false"


def test_keys_are_met_in_turns(spark):
    """Each turn moves its own part of the keys, and together they miss and repeat none."""
    rng = random.Random(5)
    rows = [(rng.randrange(-400, 400), rng.randrange(50), rng.choice([J.LOW, J.HIGH, J.PART])) for _ in range(900)]
    rows += [(1000, 7, J.PART), (1001, 7, J.PART), (1001, 7, J.PART)] + [(2002, i, J.PART) for i in range(3000)]
    held = {key for key, _, _ in rows if sum(key == other for other, _, _ in rows) > 1}
    scratch = Scratch(spark, "test")
    met = J._met(spark.createDataFrame(rows, "_key bigint, _sid bigint, _role smallint"), scratch)
    assert sorted(map(tuple, met.collect())) == sorted({r for r in rows if r[0] in held})
    turns = [{r[0] % J.KEY_TURNS for r in spark.read.parquet(scratch.path(f"met/{i}")).collect()} for i in range(J.KEY_TURNS)]
    assert turns == [{i} for i in range(J.KEY_TURNS)]


def test_empty(no_docs):
    assert J.jaccard_groups(no_docs).count() == 0
    assert J.keep_one_each(no_docs).count() == 0


def test_sets():
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0
    assert len(shingle_set("a b", 4)) == 1
    assert np.array_equal(shingle_set("A b\tC d e", 4), shingle_set("a B c D e", 4))
    long = " ".join(f"w{i}" for i in range(500_000))
    assert len(word_hashes(long)) == len(np.unique(word_hashes(long))) == 500_000
    assert len(word_hashes("y" * 3_000_000 + " z")) == 2


def test_parts_of_linked_sets_agree():
    """Of two sets at the threshold enough common parts are listed on both sides."""
    rng = np.random.default_rng(1)
    t = J.Threshold(85, 100)
    for n in (13, 20, 45, 100, 333, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a[: t.overlap(len(a), len(a))]
            extra = np.unique(rng.integers(0, 2**63, len(a) - len(b)).astype(np.uint64))
            b = np.union1d(b, extra)
            common = [set(x.tolist()) & set(y.tolist()) for x, y in zip(*(J.part_keys(s, t)[0] for s in (a, b)))]
            low = t.class_of(max(t.smallest(len(a)), t.lows[0]))
            need = t.parts(t.class_of(len(a)))[2]
            assert len(common[t.class_of(len(a)) - low]) >= need


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (700, 700)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test"), "t").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 700: 700}
