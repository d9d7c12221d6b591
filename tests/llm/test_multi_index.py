import numpy as np

from photocat.llm import multi_index as M

SCHEMA = "vec_id bigint, embedding array<float>, label int, component_id int"


def brute(rows, cosine=0.95):
    """Sorted (id, links, component)."""
    ok = []
    for i, v in rows:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        ok.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]):
                x, y = ok[a] / np.linalg.norm(ok[a]), ok[b] / np.linalg.norm(ok[b])
                linked[a, b] = np.array_equal(ok[a], ok[b]) or x @ y >= cosine
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked[a, b] and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[b][0] for b in range(n) if group[b] == g and rows[b][0] is not None), default=None) for g in group}
    return sorted(((rows[a][0], int(linked[a].sum()), least[group[a]]) for a in range(n)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id").collect()), key=repr)


def clustered(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 4, dim))
    rows = []
    for i in range(n):
        v = centers[rng.integers(len(centers))] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(c)) for c in v]))
    return rows


def test_against_brute_force(spark):
    rows = clustered(4)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got, expected = found(M.near_groups(df)), brute(rows)
    links = [(g[1], e[1]) for g, e in zip(got, expected)]
    assert all(g <= e for g, e in links)
    assert sum(g for g, _ in links) >= 0.99 * sum(e for _, e in links)
    assert sum(g[2] == e[2] for g, e in zip(got, expected)) >= 0.99 * len(rows)


def test_dense_cell_is_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = rng.normal(size=8)
    rows = [(i, [float(np.float32(c)) for c in center + rng.normal(size=8) * 1e-3]) for i in range(90)]
    monkeypatch.setattr(M, "BLOCK", 7)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = M.near_groups(df).collect()
    assert {r.component_id for r in got} == {0}
    assert max(r.n_links for r in got) <= 89 and sum(r.n_links for r in got) >= 0.99 * 90 * 89


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [
        (5, one), (3, one), (3, one), (9, [2.0, 4.0, 6.0]), (None, one), (10, [-1.0, -2.0, -3.0]),
        (11, None), (12, []), (13, [0.0, 0.0, 0.0]), (14, [1.0, None, 3.0]), (15, [nan, 1.0, 1.0]),
        (16, [inf, 1.0, 1.0]), (17, [1.0]), (18, [5.0]), (19, [1e38, 2e38, 3e38]), (20, [1.0, 2.0, 3.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    assert found(M.near_groups(df)) == brute(rows)


def test_empty_and_invalid_only(spark):
    assert M.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, 0, 0), (1, None, 0, 0)], SCHEMA)
    assert found(M.near_groups(df)) == [(1, 0, 1), (1, 0, 1)]


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    x = M._scaled(list(rng.normal(size=(300, 12))))
    grid = M.Grid(x, 4000, 0.95, 0.99)
    first, second = (d[7] for d in grid.distances(x))
    cells = grid.visited(first, second)
    cost = [first[c // grid.words] + second[c % grid.words] for c in cells]
    assert cost == sorted(cost) and len(set(cells)) == len(cells)
    every = (first[:, None] + second[None, :]) - first.min() - second.min()
    assert len(cells) == (every <= grid.radius).sum()


def test_links_count_for_both_sides_and_recall_of_a_small_sample(spark, monkeypatch):
    """Pairs apart in one shared direction, where the two traversals of a link often differ."""
    monkeypatch.setattr(M, "SAMPLE_ROWS", 400)
    monkeypatch.setattr(M, "FIT_QUERIES", 100)
    monkeypatch.setattr(M, "ROWS_ROOT", 4)  # a fine grid, in which traversals end early
    rng = np.random.default_rng(8)
    n, dim = 4000, 32
    base = rng.normal(size=(n // 2, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    way = rng.normal(size=dim)
    side = way - (base @ way)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.stack([base, 0.9505 * base + np.sqrt(1 - 0.9505**2) * side], 1).reshape(n, dim).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)
    got = sorted(found(M.near_groups(df)))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    links = np.array([g[1] for g in got])
    assert (links <= linked.sum(1)).all()
    assert links.sum() >= 0.97 * linked.sum()
    alone = (linked.sum(1) == 1).reshape(-1, 2).all(1)
    assert alone.sum() > 1900
    assert (links.reshape(-1, 2)[alone, 0] == links.reshape(-1, 2)[alone, 1]).all()
