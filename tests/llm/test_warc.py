import base64
import hashlib

import pytest

from photocat.llm import warc_archive as A


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, header int")


ODD = [
    (1, "http://a/1", "<p>same</p>", "k", 1),
    (0, "http://a/0", "<p>same</p>", "k", 1),
    (2, None, None, None, None),
    (3, "http://a/3\r\nX: y", "", "k", 1),
    (4, "http://a/4", "é" * 50_000, "k", 1),
    (5, "http://a/5", "<p>same</p>", "k", 1),
    (None, "http://a/n", "<p>same</p>", "k", 1),
]


def test_round_trip(spark, tmp_path):
    A.write_archive(rows_of(spark, ODD), str(tmp_path / "w"))
    got = A.read_records(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(ODD)
    by = {r.record: r for r in got}
    for i, url, html, *_ in ODD:
        data = (html or "").encode()
        r = by[i]
        assert bytes(r.payload) == data and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(j for j, _, h, *_ in ODD if j is not None and (h or "").encode() == data)
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        head, _, body = bytes(r.record_bytes).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert body == (data if i == first else b"") + b"\r\n\r\n"
        assert b"\nX: y" not in head
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 3


def test_smaller_payloads_are_responses(spark, tmp_path):
    A.write_archive(rows_of(spark, ODD), str(tmp_path / "w"), min_bytes=1000)
    assert {r.record_type for r in A.read_records(spark, str(tmp_path / "w")).collect()} == {"response"}


def test_empty(spark, tmp_path):
    A.write_archive(rows_of(spark, []), str(tmp_path / "w"))
    assert A.read_records(spark, str(tmp_path / "w")).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    A.write_archive(rows_of(spark, ODD[:2]), str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w" / "payloads")).collect()
    bad = spark.createDataFrame([(r.key, bytearray(b"other")) for r in stored], "key string, payload binary")
    bad.write.mode("append").parquet(str(tmp_path / "v" / "payloads"))
    spark.read.parquet(str(tmp_path / "w" / "headers")).write.parquet(str(tmp_path / "v" / "headers"))
    with pytest.raises(Exception, match="does not match"):
        A.read_records(spark, str(tmp_path / "v")).collect()
