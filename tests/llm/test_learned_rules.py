"""Statistics against brute force, the list against a plain reading of it, and odd tables."""

import random
import re

import duckdb
import numpy as np
import pytest
from llm_support import SF

from photocat.llm import learned_rules as L
from photocat.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    runs = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
    )


def odd_texts():
    rng = random.Random(3)
    texts = ["", " \n\t", "a", "a a a a a a", "a b c d e a b c d e", "x\n\nx\n x\nx", "é é #*$%&|<>\x0b\x1cü", "𝒳 𝒴\r\n𝒳 𝒴"]
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    return texts


def test_statistics_equal_brute_force():
    for text in [None, *odd_texts()]:
        assert L.counts_of(text)[:5] == brute(text), repr(text)


def test_repeated_words_of_other_windows():
    for window in (1, 2, 3, 4, 7):
        rng = np.random.default_rng(window)
        ids = rng.integers(0, 3, 40)
        runs = [tuple(ids[i : i + window]) for i in range(len(ids) - window + 1)]
        covered = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(window)}
        assert L.repeated_words(ids, window) == len(covered)


def planted(n=3000, seed=2):
    """Features at random; label 0 where symbols are many, or where lines repeat in long texts."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(L.FEATURES)))
    at = {name: i for i, name in enumerate(L.FEATURES)}
    bad = (x[:, at["symbols_per_word"]] > 0.8) | ((x[:, at["dup_line_share"]] > 0.7) & (x[:, at["n_words"]] > 0.5))
    return x, np.where(bad, 0, 1).tolist(), rng.random(n) < 0.33


def test_covering_finds_planted_rules_and_default_is_the_frequent_label():
    x, labels, prunes = planted()
    found = L.learn(x, labels, prunes)
    assert found.default == 1 and {r.label for r in found.rules} == {0}
    assert np.mean([a == b for a, b in zip(found.predict(x), labels, strict=True)]) > 0.98
    assert any({c.feature for c in r.conditions} == {"dup_line_share", "n_words"} for r in found.rules)


def test_noise_ends_in_few_rules():
    x, labels, prunes = planted()
    rng = np.random.default_rng(9)
    assert L.learn(x, rng.integers(0, 2, len(x)).tolist(), prunes).rules == ()


def test_pruning_drops_conditions_that_do_not_help():
    x, labels, _ = planted()
    y = np.array(labels) == 0
    good = L.Condition("symbols_per_word", True, 0.8)
    useless = L.Condition("digit_share", True, 0.9)
    assert L.prune_rule([good, useless], x, y) == [good]


def test_thresholds_read_well_and_part_the_values():
    assert L.between(0.0, 1.0) == 0.3 and L.between(3.0, 10.0) == 5.0
    rng = np.random.default_rng(1)
    for low, gap in rng.random((200, 2)):
        assert low <= L.between(low, low + gap * 1e-3) < low + gap * 1e-3


def test_expression_equals_the_list_read_in_order(spark):
    rng = random.Random(5)
    rows = [tuple(rng.choice([0, rng.randint(0, 50)]) for _ in L.COUNTS) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in L.COUNTS))
    rules = L.DecisionList(
        (
            L.Rule((L.Condition("symbols_per_word", True, 0.5), L.Condition("n_words", False, 30)), 0),
            L.Rule((L.Condition("chars_per_word", False, 1.5),), 1),
            L.Rule((L.Condition("symbols_per_word", True, 0.1),), 0),
        ),
        1,
    )
    features = [make().alias(n) for n, make in L.FEATURES.items()]
    got = df.select(rules.column().alias("v"), *features).collect()
    assert [r["v"] for r in got] == rules.predict(np.array([r[1:] for r in got]))
    assert len({r["v"] for r in got}) == 2


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_odd_tables(spark, odd_docs, no_docs):
    labels = labelled(spark, [(1, 1, 0), (2, 0, 0), (2, 1, 0), (6, 1, 0), (None, 0, 0), (10, None, 0), (99, 0, 0)])
    got = L.judge(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    texts = {(r.doc_id, brute(r.text)) for r in odd_docs.collect()}
    assert {(r.doc_id, tuple(r[c] for c in L.COUNTS[:5])) for r in got} == texts
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    empty = L.judge(no_docs, labels)
    assert empty.count() == 0 and "kept" in empty.columns
    unlearnt = L.judge(odd_docs, labelled(spark, [])).collect()
    assert all(r.kept == (not r.base_failed) and r.verdict is None for r in unlearnt)
    assert all(r.kept == (not r.base_failed) for r in L.judge(odd_docs, labelled(spark, [(1, 1, 0)])).collect())


def test_labels_of_another_type(spark):
    rng = random.Random(8)
    words = lambda mark: " ".join(f"w{rng.randint(0, 10**6)}{mark}" for _ in range(rng.randint(15, 40)))
    bad = [(i, words("##")) for i in range(60)]
    good = [(i, words("")) for i in range(60, 160)]
    docs = spark.createDataFrame(bad + good, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id < 60, 'junk', 'fine') AS grade")
    got = L.judge(docs, labels, label_col="grade", good="fine", least=0.5).collect()
    assert {r.doc_id for r in got if r.verdict == "junk"} == set(range(60))


def test_whole_table(spark):
    got = QUERIES["op11_learned_rules"](spark, SF).collect()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(
        (i, *brute(t)) for i, t in docs
    )
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    judged = [(label[r.doc_id], r.kept) for r in got if r.doc_id in label and not r.base_failed]
    assert sum(bool(a) == b for a, b in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_least_precision_is_a_parameter(least):
    x, labels, prunes = planted()
    rng = np.random.default_rng(4)
    noisy = [v if rng.random() < 0.85 else 1 - v for v in labels]
    assert bool(L.learn(x, noisy, prunes, least).rules) == (least == 0.0)
