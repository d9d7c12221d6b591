import zlib
from collections import Counter

import pytest

from photocat.llm import hilbert_sharding as H


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_curve_visits_every_cell_in_steps_of_one(spark, dims, bits):
    side = 1 << bits
    cells = spark.range(side**dims)
    for d in range(dims):
        cells = cells.withColumn(f"x{d}", (cells.id / side**d).cast("int") % side)
    index = H.hilbert_index([cells[f"x{d}"] for d in range(dims)], bits)
    path = sorted((r.at, [r[f"x{d}"] for d in range(dims)]) for r in cells.withColumn("at", index).collect())
    assert [at for at, _ in path] == list(range(side**dims))
    for (_, a), (_, b) in zip(path, path[1:]):
        assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def check(df, shards, rows):
    got = df.collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts.get(s, 0)))
    expected = sorted(((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == expected
    # Runs of the curve: shards do not overlap.
    ends = [(min(v), max(v)) for v in ([r.curve_index for r in got if r.shard == s] for s in range(shards)) if v]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_shards(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    for shards in (1, 4, 24):
        check(H.assign_shards(odd_docs, shards), shards, rows)


def test_empty(no_docs):
    assert H.assign_shards(no_docs, 24).count() == 0


def test_written_shards(spark, odd_docs, tmp_path):
    docs = odd_docs.dropDuplicates(["doc_id"])
    H.write_shards(docs, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.shard for r in back.collect()} == {0, 1, 2}
