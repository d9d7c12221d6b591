"""Order-dependent operators against brute force, in both size regimes."""

import random
import re

import pytest
from support import rows
from pyspark.sql import functions as F

from photocat.operators import assets, ordering, selection, stats, views
from photocat.operators.joins import lookup
from photocat.session import stage


def hot_groups(n=400, seed=5):
    """(root, id, name, status): one root holds most rows."""
    rng = random.Random(seed)
    names = rng.sample(range(10 * n), n)
    return [
        (rng.choice(["/hot", "/hot", "/hot", "/b", "/c"]), i, f"N{names[i]:06d}", rng.choice([0, 1, 1, 1, 1, 1, 1, 2]))
        for i in range(n)
    ]


@pytest.fixture(params=["windowed", "ranged"])
def regime(request):
    if request.param == "ranged":
        request.getfixturevalue("tiny_limits")
    return request.param


def ranked(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_views_on_a_hot_root(spark, regime):
    data = hot_groups()
    df = spark.createDataFrame(data, "root string, id bigint, name string, status int")
    view = ordering.rank_rows(df, ["root"], [F.col("name")], total="total").cache()
    groups = ranked(data)
    want = [(g, r[1], i, len(rs)) for g, rs in groups.items() for i, r in enumerate(rs)]
    assert rows(view, "root", "id", "pos", "total") == sorted(want)

    near, advance, errors = [], [], []
    for g, rs in groups.items():
        ids, bad = [r[1] for r in rs], [r[3] == 2 for r in rs]
        for i in range(len(ids)):
            around = [p for d in (1, 2, 3) for p in (i - d, i + d) if 0 <= p < len(ids)]
            near.append((ids[i], tuple(ids[p] for p in around)))
            advance.append((ids[i], ids[min(i + 1, len(ids) - 1)]))
            after = [p % len(ids) for p in range(i + 1, i + 1 + len(ids)) if bad[p % len(ids)]]
            errors.append((ids[i], ids[after[0]] if after else None))
    got = [(r.id, tuple(r.neighbors)) for r in views.neighbors(view).collect()]
    assert sorted(got) == sorted(near)
    assert rows(views.advance_target(view), "id", "target_id") == sorted(advance)
    assert rows(views.next_error(view), "id", "next_error_id") == sorted(errors)

    cursors = [("/hot", 1, 5, 60), ("/hot", 2, 60, 5), ("/b", 3, 0, 0), ("/c", 4, 2, 10_000)]
    picked = selection.range_select(
        view, spark.createDataFrame(cursors, "root string, session int, anchor bigint, clicked bigint")
    )
    want = [
        (s, groups[g][p][1]) for g, s, a, b in cursors for p in range(min(a, b), min(max(a, b) + 1, len(groups[g])))
    ]
    assert rows(picked, "session", "id") == sorted(want)


def test_next_error_without_errors_is_null(spark, regime):
    df = spark.createDataFrame([("/r", i, i, 1) for i in range(40)], "root string, id bigint, pos bigint, status int")
    assert {r[1] for r in rows(views.next_error(df), "id", "next_error_id")} == {None}


def test_next_error_alone_points_at_itself(spark, regime):
    df = spark.createDataFrame([("/r", i, i, 2 if i == 21 else 1) for i in range(40)], "root string, id bigint, pos bigint, status int")
    assert {r[1] for r in rows(views.next_error(df), "id", "next_error_id")} == {21}


def evict(slots, budget):
    total, out = sum(s[2] for s in slots), []
    if total <= budget:
        return out
    for slot in sorted(slots, key=lambda s: (s[3], s[0], s[1] != "thumb")):
        if total <= budget * 3 // 4:
            break
        total -= slot[2]
        out.append(slot[:2])
    return out


@pytest.mark.parametrize("budget", [0, 999, 60_000, 10**9])
def test_lru_evict_matches_a_loop(spark, regime, budget):
    rng = random.Random(budget)
    slots = [(i // 2, ("preview", "thumb")[i % 2], rng.randrange(1, 1000), rng.randrange(30)) for i in range(300)]
    df = spark.createDataFrame(slots, "id bigint, kind string, bytes bigint, last_used bigint")
    assert rows(assets.lru_evict(df, budget), "id", "kind") == sorted(evict(slots, budget))
    tiers = [s for k in ("preview", "thumb") for s in evict([x for x in slots if x[1] == k], budget)]
    assert rows(assets.lru_evict(df, budget, ["kind"]), "id", "kind") == sorted(tiers)


def test_lru_evict_of_null_tiers_equal_times_and_extra_columns(spark, regime):
    slots = [(i, "thumb", 10, (None, 7, 7, 7, -(10**15))[i % 5], None if i % 2 else "t", i) for i in range(100)]
    df = spark.createDataFrame(
        slots, "id bigint, kind string, bytes bigint, last_used bigint, tier string, _tier bigint"
    ).withColumnRenamed("_tier", "total")
    got = assets.lru_evict(df, 400, ["tier"])
    assert got.columns == df.columns
    want = []
    for tier in (None, "t"):
        mine = [s for s in slots if s[4] == tier]
        mine.sort(key=lambda s: (s[3] is not None, s[3] or 0, s[0]))
        want += [(s[0],) for s in mine[:20]]
    assert rows(got, "id") == sorted(want)
    assert assets.lru_evict(df.limit(0), 400).count() == 0
    assert assets.lru_evict(df.where("last_used = 7"), 400).count() == 30


def test_progress_never_rewinds(spark, regime):
    rng = random.Random(1)
    ticks = [(rng.choice("aab"), i, rng.randrange(i + 5)) for i in range(200)]
    best, want = {}, []
    for job, event, done in ticks:
        best[job] = max(best.get(job, done), done)
        want.append((job, event, best[job]))
    df = spark.createDataFrame(ticks, "job string, event_id bigint, done bigint")
    assert rows(stats.progress_monotonic(df), "job", "event_id", "shown") == sorted(want)


def test_ranking_needs_no_rows(spark, regime):
    df = spark.createDataFrame([], "root string, name string")
    assert rows(ordering.rank_rows(df, ["root"], [F.col("name")])) == []
    assert rows(ordering.rank_rows(df, [], [F.col("name")])) == []


def test_lookup_keeps_every_row_of_a_hot_key(spark, regime):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i bigint")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3)], "k string, v bigint")
    values = {"hot": 1, "k0": 2, "k9": 3}
    want = [(i, values.get("hot" if i % 3 else f"k{i}")) for i in range(300)]
    assert rows(lookup(big, small, ["k"]), "i", "v") == sorted(want)
    assert lookup(big, small, ["k"], "left_semi").count() == sum(v is not None for _, v in want)
    assert lookup(big, small, ["k"], "left_anti").count() == sum(v is None for _, v in want)


@pytest.mark.parametrize("hot", [True, False])
def test_lookup_broadcasts_no_table_that_only_looks_small(spark, tiny_limits, hot):
    """A few KB of Parquet, which Spark by itself would broadcast."""
    small = stage(spark.range(50_000).selectExpr("id AS k", "repeat('x', 500) AS v"), "small")
    big = stage(spark.range(200).selectExpr("id AS k", "id AS i"), "big")
    found = lookup(big, small, ["k"], hot=hot)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("length(v) = 500").count() == 200


def test_ranges_do_not_grow_without_bound(spark, tiny_limits, monkeypatch):
    """Spark samples the keys of every range to the driver."""
    spark.conf.set("photocat.rangeRows", "1")
    plans = []
    monkeypatch.setattr(ordering, "stage", lambda df, _: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    ordering.rank_rows(spark.range(5_000).selectExpr("id % 3 AS g", "id"), ["g"], [F.col("id")])
    assert re.findall(r"rangepartitioning.*, (\d+)\)", plans[0]) == ["1000"]


def test_a_long_block_table_is_not_broadcast(spark, tiny_limits):
    ticks = stage(spark.range(20_000).selectExpr("'j' AS job", "id AS event_id", "id % 7 AS done"), "ticks")
    shown = stats.progress_monotonic(ticks)
    assert "BroadcastHashJoin" not in shown._jdf.queryExecution().executedPlan().toString()
    assert shown.where("shown = least(event_id, 6)").count() == 20_000


def test_names_preview(spark):
    data = [("a", i, f"n{i}") for i in range(6)] + [("b", i, f"m{i}") for i in range(4)] + [("c", 0, "x")]
    df = spark.createDataFrame(data, "root string, ordinal bigint, name string")
    assert dict(rows(stats.names_preview(df, ["root"]))) == {
        "a": "n0, n1, n2, n3, … and 2 more", "b": "m0, m1, m2, m3", "c": "x",
    }


def accounting(starts, events, cancels=()):
    """Events one by one, as the pipeline sees them."""
    out = {s[:2]: [0, 0, 0] for s in starts}
    marks = [(at, j, g) for j, g, at in starts] + [(at, j, None) for j, at in cancels]
    for event, job, generation, kind in sorted(events):
        active = [g for at, j, g in sorted(marks, key=lambda m: m[0]) if j == job and at <= event]
        if not active or active[-1] != generation:
            slot = 2
        else:
            slot = 0 if kind == "Ingested" else 1
        if (job, generation) in out:
            out[job, generation][slot] += 1
    return out


BATCHES = "job string, generation bigint, started_event_id bigint, enqueued bigint"
LOG = "event_id bigint, job string, generation bigint, kind string"


def ingest_run(seed):
    rng = random.Random(seed)
    starts = [(j, g, g * 20 + k) for k, j in enumerate("ab") for g in range(1, 12)]
    events = [
        (e, rng.choice("aaab"), max(0, e // 20 - (rng.random() < 0.2)), rng.choice(["Ingested", "Failed"]))
        for e in range(20, 260)
    ]
    return starts, events


def test_batch_accounting_matches_a_loop(spark, regime):
    starts, events = ingest_run(3)
    want = accounting(starts, events)
    batches = spark.createDataFrame([(j, g, at, sum(want[j, g]) + g % 2) for j, g, at in starts], BATCHES)
    got = stats.batch_accounting(spark.createDataFrame(events, LOG), batches)
    assert rows(got, "job", "generation", "ingested", "failed", "dropped", "finished") == sorted(
        (j, g, *n, g % 2 == 0) for (j, g), n in want.items()
    )


def test_a_cancelled_batch_is_finished_and_later_ones_run(spark, regime):
    starts, events = ingest_run(5)
    # While generations 3 and 7 of a run; twice in generation 5; before the first start; at the start of 9.
    cancels = [("a", 69), ("a", 147), ("a", 105), ("a", 111), ("a", 2), ("b", 181), ("c", 50)]
    ended = {("a", 3), ("a", 5), ("a", 7)}
    want = accounting(starts, events, [c for c in cancels if c != ("b", 181)])
    batches = spark.createDataFrame([(j, g, at, sum(want[j, g]) + 3) for j, g, at in starts], BATCHES)
    stops = spark.createDataFrame(cancels, "job string, event_id bigint")
    log = spark.createDataFrame(events, LOG)
    got = stats.batch_accounting(log, batches, stops)
    for r in got.collect():
        n = want[r.job, r.generation]
        over = (r.job, r.generation) in ended
        assert (r.ingested, r.failed, r.dropped, r.finished) == (n[0], n[1], n[2] + 3 * over, over)
    none = stats.batch_accounting(log, batches, stops.limit(0))
    assert rows(none) == rows(stats.batch_accounting(log, batches))


def test_next_error_computes_its_view_once(spark):
    data = [("r", i, i, 2 if i == 3 else 1) for i in range(6)]
    plan = views.next_error(spark.createDataFrame(data, "root string, id bigint, pos bigint, status int"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in text and "LogicalRDD" not in text and "LocalRelation" not in text
