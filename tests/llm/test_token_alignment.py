"""Alignment against brute force over token bytes, parts against whole texts, and odd tables."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from llm_support import SF

from photocat.llm import token_alignment as A
from photocat.llm.queries import BYTE_LEVEL, PIECES, QUERIES

with open(BYTE_LEVEL, encoding="utf-8") as f:
    CONFIG = f.read()
with open(PIECES, "rb") as f:
    PROTO = f.read()


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(CONFIG, PROTO)


class Brute:
    """Every token occurrence with its byte range, straight from the two libraries."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_str(CONFIG)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.a_bytes = {i: bytes(of.get(c, 0) for c in t) for t, i in json.loads(CONFIG)["model"]["vocab"].items()}

    def b_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        data = (" " + text).encode()
        if b"".join(self.a_bytes[i] for i in a) != data or b"".join(map(self.b_bytes, b)) != data:
            return []

        def ends(ids, of):
            at, out = 0, []
            for i in ids:
                at += len(of(i))
                out.append(at)
            return out

        a_ends, b_ends = ends(a, self.a_bytes.get), ends(b, self.b_bytes)
        held = [(e, 0, i) for i, e in zip(a, a_ends, strict=True)] + [(e, 1, i) for i, e in zip(b, b_ends, strict=True)]
        common, out, group = set(a_ends) & set(b_ends), [], ([], [])
        for end, side, i in sorted(held, key=lambda t: t[:2]):
            group[side].append(i)
            if side and end in common:
                out.append(group)
                group = ([], [])
        return out


def brute(rows):
    """The contract's columns for ``(id, text)`` rows."""
    make = Brute()
    docs = [(i, make.groups(t)) for i, t in rows]
    count = Counter((a[-1], b[-1]) for _, groups in docs for a, b in groups)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, groups in docs:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
             sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "")
        )
    return sorted(out, key=str), count


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\n  b\tc", "x▁y", "\x1c a\x1d", "if (a);\r\n}\r\n", "tab\t\ttab ",
    "<|endoftext|> and </s> <unk>", "日本語 テキスト", "naïve café ﬁ ™", "😀😀 👩‍👩‍👧", "a b c　d\x85e", "\x00 zero", "é",
    "don't I'll they've", "1234 5,678.90", "====----", " ".join(["w"] * 3000), "y" * 5000, "​‍ a﻿",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", "Tion", "ß", "ß ", " ", "  ", "\n", "\n ", "\t", "é", "'s", "12", "_", "\x1f", "\r", "日", "▁", ",", "zq", "Ω"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_parts_give_what_whole_texts_give(aligner):
    texts = ODD + random_texts(800, 1)
    for text, got in zip(texts, aligner.align(texts), strict=True):
        want = aligner.whole(text) if text else None
        assert (got is None) == (want is None), repr(text)
        if got:
            assert (*got[:4], list(got[4]), list(got[5])) == want, repr(text)


def test_identity_array_holds_equal_bytes_only(aligner):
    for a, b in enumerate(aligner.partner):
        assert b == -1 or aligner.a.bytes[a] == aligner.b.bytes[b]
    held = set(aligner.b.bytes)
    assert all(b >= 0 for a, b in enumerate(aligner.partner) if aligner.a.bytes[a] and aligner.a.bytes[a] in held)


def test_other_library_gives_the_same_ids(aligner):
    model = tokenizers.Tokenizer.from_str(CONFIG)
    model.encode_special_tokens = True
    for text in [t for t in ODD if t] + random_texts(500, 2):
        assert aligner.a.encode(" " + text) == model.encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_a_model_whose_ids_are_no_ranks_uses_the_other_library():
    config = json.loads(CONFIG)
    config["model"]["merges"] = config["model"]["merges"][::-1]
    assert A.ByteLevel(json.dumps(config)).encode.__name__ == "<lambda>"


def test_few_remembered_parts(aligner, monkeypatch):
    texts = random_texts(200, 3) + ["y" * 100 + " b"]
    want = [(r and (*r[:4], list(r[4]), list(r[5]))) for r in aligner.align(texts)]
    monkeypatch.setattr(A, "REMEMBERED", 3)
    small = A.Aligner(CONFIG, PROTO)
    got = [(r and (*r[:4], list(r[4]), list(r[5]))) for at in range(0, len(texts), 7) for r in small.align(texts[at : at + 7])]
    assert got == want and len(small.parts) < 100


@pytest.mark.parametrize("frequent", [1, 40, 65_536])
def test_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(A, "FREQUENT", frequent)
    texts = ODD + random_texts(150, 4) + ["same text of all"] * 60
    rows = [(i % 190, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    documents, pairs = A.align(docs, BYTE_LEVEL, PIECES, ["doc_id"], with_groups=True)
    want, count = brute(rows)
    got = documents.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == want
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == count
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)


def test_odd_tables(spark, odd_docs, no_docs):
    clashing = odd_docs.withColumnsRenamed({"_id": "_row", "_doc": "_odd"})
    documents, _ = A.align(clashing, BYTE_LEVEL, PIECES, ["doc_id", "_row", "_odd"])
    want, _ = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in documents.collect()), key=str) == want
    documents, pairs = A.align(no_docs, BYTE_LEVEL, PIECES, ["doc_id"])
    assert documents.count() == 0 and pairs.count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    documents, _ = A.align(nulls, BYTE_LEVEL, PIECES, ["doc_id"])
    assert sorted(tuple(r) for r in documents.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_identity_alignment"](spark, SF)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in docs])[0]
