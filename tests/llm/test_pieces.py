import itertools
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photocat.llm import piece_lattice as P
from photocat.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pieces():
    return P.read_pieces(PIECES)


@pytest.fixture(scope="module")
def vocabulary(pieces):
    return P.Pieces(pieces)


def all_ways(segment, vocabulary):
    edges, out = P.edges_of(segment, vocabulary), []

    def walk(at, score, ids):
        if at == 0:
            out.append((score, ids))
        for start, s, i in edges[at] if at else []:
            walk(start, score + s, i + ids)

    walk(len(segment), 0.0, [])
    return sorted(out, key=lambda w: -w[0])


@settings(max_examples=60, deadline=None)
@given(st.text("the ranoé\n𝄞▁", min_size=1, max_size=9))
def test_search_lists_the_best_ways(vocabulary, text):
    for segment in vocabulary.split(text):
        every = all_ways(segment, vocabulary)
        some = P.nbest_ways(segment, vocabulary, 5)
        assert [s for s, _ in some] == pytest.approx([s for s, _ in every[:5]])
        assert all(w in every for w in some)
        score, gap, ids = (v[0] for v in P.best_ways([segment, "▁a"], vocabulary))
        assert score == pytest.approx(every[0][0]) and (score, ids) in [(pytest.approx(s), i) for s, i in every]
        assert gap == (pytest.approx(every[0][0] - every[1][0]) if len(every) > 1 else float("inf"))


@settings(max_examples=25, deadline=None)
@given(st.text("the an\n", max_size=14), st.integers(1, 5))
def test_texts_against_brute_force(pieces, text, n):
    encoder = P.Encoder(pieces, n)
    (segments,) = encoder.learn([text])
    ids, score, others, _ = encoder.encode(segments)
    ways = [all_ways(s, encoder.vocabulary)[:n] for s in segments]
    best = sorted((sum(w[0] for w in c) for c in itertools.product(*ways)), reverse=True)[:n]
    assert [score, *[s for s, _ in others]] == pytest.approx(best)
    assert encoder.vocabulary.decode(ids) == text
    # Each further way is a segmentation of the text as well, with the score it claims.
    for claimed, changes in others:
        parts = [encoder.ids_of(np.array([encoder.at[s]])).tolist() for s in segments]
        for at, new in changes:
            parts[at] = new
        assert encoder.vocabulary.decode([i for p in parts for i in p]) == text


def test_border_between_segments(vocabulary):
    """No piece spans a border, so segments are independent."""
    for piece in vocabulary.ids:
        inner = piece.lstrip("▁")
        assert "▁" not in inner and ("\n" not in piece or len(piece) == 1)


def test_odd_rows(spark, odd_docs, no_docs):
    out = P.encode(odd_docs, PIECES)
    assert out.columns == [*odd_docs.columns, "ids", "score", "other_ways", "restored"]
    got = out.collect()
    assert len(got) == odd_docs.count() and all(r.restored for r in got)
    assert [r.ids for r in got if r.text is None] == [None]
    assert [(r.ids, r.score, r.other_ways) for r in got if r.text == ""] == [([], 0.0, [])]
    back = P.decode(out, PIECES).collect()
    assert all(r.decoded == r.text for r in back)
    assert P.encode(no_docs, PIECES).count() == 0


def test_long_segment(pieces):
    encoder = P.Encoder(pieces)
    text = "é𝄞x" * 2000
    (segments,) = encoder.learn([text])
    ids, _, others, decoded = encoder.encode(segments)
    assert encoder.vocabulary.decode(ids) == decoded == text and len(others) == 1
