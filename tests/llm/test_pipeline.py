"""The pipeline against plain Python, stage by stage, and the registered queries."""

import hashlib
import os

import duckdb
import pytest
from llm_support import SF
from test_mixing import tree_budgets
from test_ngram_join import brute as similar

import corpus_pipeline as P
from photocat.llm import language_id, piece_lattice
from photocat.llm.queries import PIECES, QUERIES, SQL
from photocat.llm.source_mixing import LEVELS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_join", "source_mixing", "pieces"]
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is P.run
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == 13


def test_run_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(docs)
    kept = {}
    for i, r in rows.items():
        lang, score = model.predict(r.text)
        if lang != "und" and score >= P.LEAST_SCORE:
            kept[i] = r
    last = {}
    for i, r in sorted(kept.items()):
        last[r.text] = i
    kept = {i: kept[i] for i in last.values()}
    kept = {i: kept[i] for i, _, c in similar([(i, r.text) for i, r in kept.items()], 5, 80, 100) if i == c}
    sizes, path_of, tokens = {}, {}, {}
    for i, r in kept.items():
        path_of[i], tokens[i] = (r.source[:4], r.lang, r.source), len(r.text.split())
        sizes[path_of[i]] = sizes.get(path_of[i], 0) + tokens[i]
    budget = int(sum(sizes.values()) * P.MIX_SHARE)
    budgets = tree_budgets(sizes, budget, P.MIX, 1)
    assert all(len(p) == len(LEVELS) for p in budgets)
    mixed = set()
    for path, amount in budgets.items():
        full, rest = divmod(amount, sizes[path]) if sizes[path] else (0, 0)
        members = [i for i in kept if path_of[i] == path]
        if full:
            mixed.update(members)
            continue
        used = 0
        for i in sorted(members, key=lambda i: hashlib.md5(f"{P.MIX_SEED}:{full}:{i}".encode()).hexdigest()):
            used += tokens[i]
            if used > rest:
                break
            mixed.add(i)
    encoder = piece_lattice.Encoder(piece_lattice.read_pieces(PIECES))
    got = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(mixed)
    for r in got:
        (segments,) = encoder.learn([rows[r.doc_id].text])
        ids, score, _, _ = encoder.encode(segments)
        assert (r.ids, r.score) == (ids.tolist(), score)
        assert encoder.vocabulary.decode(r.ids) == rows[r.doc_id].text


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert name == "pieces" or out.columns == start.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (start is not no_docs)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SF, table)}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == expected
