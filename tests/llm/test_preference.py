from photocat.llm import preference_pairs as R

TURN = "pair_id bigint, turn bigint, role string, text string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TURN)


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    spans = []
    for side in (chosen, rejected):
        found, at = [], 0
        for role, text in side[n:]:
            begin = at + len(f"<|im_start|>{role or ''}\n")
            end = begin + len(f"{text or ''}<|im_end|>")
            if role == "assistant":
                found.append((begin, end))
            at = end + 1
        spans.append(found)
    return n, render(chosen[:n]), render(chosen[n:]), spans[0], render(rejected[n:]), spans[1]


def result(r):
    spans = lambda v: [(s.start, s.end) for s in v]
    return r.n_common, r.prompt, r.chosen, spans(r.chosen_spans), r.rejected, spans(r.rejected_spans)


CASES = {
    1: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "cé𝄞")]),
    2: ([("user", "a")], [("user", "a"), ("assistant", "b")]),
    3: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
    4: ([("system", None), (None, "b")], [("system", None), (None, "c"), ("assistant", "d")]),
    5: ([("user", "x")], [("user", "y")]),
    6: ([("assistant", "word " * 20_000), ("user", "q")], [("assistant", "word " * 20_000), ("user", None)]),
}


def test_pairs(spark):
    sides = [[(i, t, *turn) for i, c in CASES.items() for t, turn in enumerate(c[s])] for s in (0, 1)]
    # Lone sides and rows without a pair are left out.
    left = frame(spark, [*sides[0], (9, 0, "user", "z"), (None, 0, "user", "z")])
    right = frame(spark, [*sides[1], (None, 0, "user", "z")])
    got = {r.pair_id: result(r) for r in R.format_pairs(left, right).collect()}
    assert got == {i: brute(*c) for i, c in CASES.items()}


def test_repeated_turns_and_gaps(spark):
    left = frame(spark, [(1, 7, "user", "a"), (1, 7, "user", "a"), (1, None, "system", "s")])
    right = frame(spark, [(1, 1, "user", "a"), (1, None, "system", "s")])
    (r,) = R.format_pairs(left, right).collect()
    turns = [("system", "s"), ("user", "a"), ("user", "a")]
    assert result(r) == brute(turns, turns[:2])


def test_from_neighbours(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "thanks"),
        (2, 0, "user", "only"), (3, 0, "assistant", "c"), (None, 0, "assistant", "n"),
    ]
    got = {r.conv_id: result(r) for r in R.pairs_from_neighbours(frame(spark, rows).withColumnRenamed("pair_id", "conv_id")).collect()}
    assert got == {
        1: brute([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]),
        3: brute([("assistant", "c")], [("assistant", "b")]),
    }


def test_empty(spark):
    none = frame(spark, [])
    assert R.format_pairs(none, none).count() == 0
    assert R.pairs_from_neighbours(none, "pair_id").count() == 0
