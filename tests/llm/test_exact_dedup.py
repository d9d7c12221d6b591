import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from photocat.llm import exact_dedup as D


def brute(rows):
    """Sorted (id, keep, size, kept, digest), one of equal (id, text) rows being kept."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen = seen or kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def found(df):
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    # Small blocks and salts force several levels and split groups.
    for block, salt in ((4096, 1000), (7, 2)):
        assert found(D.text_groups(odd_docs, block_chars=block, salt_rows=salt)) == brute(rows)


def test_empty(no_docs):
    assert D.text_groups(no_docs).count() == 0
    assert D.drop_copies(no_docs).columns == no_docs.columns


def test_drop_copies_keeps_columns(odd_docs):
    kept = D.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd_docs.collect()})


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.text("ab\n é𝄞", max_size=9)), max_size=30))
def test_any_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(D.text_groups(df, block_chars=2, salt_rows=3)) == brute(rows)
    names = {}
    for r in D.text_groups(df, block_chars=2).select("text_sha256", "identity").collect():
        assert names.setdefault(r.identity, r.text_sha256) == r.text_sha256
    assert len(set(names.values())) == len(names)
