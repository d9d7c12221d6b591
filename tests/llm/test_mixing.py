import hashlib
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from photocat.llm import source_mixing as X
from photocat.llm.common import Scratch


def divide(given, children):
    """Plain water filling: ``children`` are (name, cap, weight)."""
    full = {}
    while True:
        left = given - sum(full.values())
        rest = [c for c in children if c[0] not in full]
        total = sum(w for _, _, w in rest)
        new = {n: cap for n, cap, w in rest if cap * total <= left * w}
        if not new:
            return full | {n: int(Fraction(left * w, total)) for n, _, w in rest}
        full |= new


def tree_budgets(sizes, budget, weights, epochs):
    out = {("", ""): budget}
    given = {(): budget}
    for depth, level in enumerate(X.LEVELS):
        below = {}
        for parent, amount in given.items():
            caps = {}
            for path, size in sizes.items():
                if path[:depth] == parent:
                    caps[path[: depth + 1]] = caps.get(path[: depth + 1], 0) + size * epochs
            of = weights.get(level, {})
            below |= divide(amount, [(p, cap, of.get(p[-1], 1)) for p, cap in sorted(caps.items())])
        given = below
    return given


LEAF = st.tuples(st.sampled_from("ab"), st.sampled_from(["en", "de"]), st.sampled_from("xyz"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(LEAF, st.integers(0, 50), min_size=1), st.integers(0, 200), st.integers(1, 3))
def test_budgets(spark, sizes, budget, epochs):
    weights = {"domain": {"a": 3}, "lang": {"de": 2}, "source": {"x": 5}}
    df = spark.createDataFrame([(*p, s) for p, s in sizes.items()], "domain string, lang string, source string, size bigint")
    got = X.budgets(df, budget, weights, epochs, Scratch(spark, "test")).collect()
    expected = tree_budgets(sizes, budget, weights, epochs)
    assert {(r.domain, r.lang, r.source): r.leaf_budget for r in got} == expected


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("a", "en", "x", 10), ("a", "en", "y", 1000), ("b", "en", "z", 1000)]
    df = spark.createDataFrame(rows, "domain string, lang string, source string, size bigint")
    got = X.budgets(df, 400, {}, 1, Scratch(spark, "test")).collect()
    assert {r.source: r.leaf_budget for r in got} == {"x": 10, "y": 190, "z": 200}


def test_prefix_and_epochs(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "src0") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    total = sum(i % 7 + 1 for i in range(40))
    for share, epochs in ((0.4, 1), (1.7, 2), (5.0, 3)):
        budget = min(int(total * share), total * epochs)
        full, rest = divmod(budget, total)
        expected, used = {i: full for i in range(40)}, 0
        order = sorted(range(40), key=lambda i: hashlib.md5(f"9:{full}:{i}".encode()).hexdigest())
        for i in order:
            used += i % 7 + 1
            if used > rest:
                break
            expected[i] += 1
        got = {r.doc_id: r.copies for r in X.mix(df, share, {}, epochs, seed=9).collect()}
        assert got == {i: c for i, c in expected.items() if c}
        taken = X.select_rows(df, share=share, weights={}, epochs=epochs, seed=9)
        assert taken.count() == sum(expected.values()) and taken.columns == df.columns


def test_odd_rows(odd_docs, no_docs):
    everything = X.select_rows(odd_docs, share=1.0, weights={}, epochs=1)
    assert everything.columns == odd_docs.columns
    assert everything.where("text <> ''").count() == odd_docs.where("text <> ''").count()
    nothing = X.mix(odd_docs, 0.0, {}, 1)
    assert all(r.n_tokens == 0 for r in nothing.collect())
    twice = X.select_rows(odd_docs, share=2.0, weights={}, epochs=2).where(r"text rlike '\\S'")
    assert twice.count() == 2 * odd_docs.where(r"text rlike '\\S'").count()
    assert X.mix(no_docs, 0.5, {}, 1).count() == 0
    with pytest.raises(ValueError):
        X.mix(odd_docs, 0.5, {"lang": {"en": 0}}).count()
