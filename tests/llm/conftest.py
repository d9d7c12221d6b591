import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from photocat.session import build_session  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"the{i % 997} word{i % 313}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog", "en", "src1", 34),
        (2, "the cat sat on the mat and the dog", "en", "src0", 34),
        (2, "the cat sat on the mat and the dog", "en", "src0", 34),
        (3, "", "en", "src0", 0),
        (4, None, "en", "src0", None),
        (5, "   \n\t", None, "src1", 5),
        (6, long, "en", None, len(long)),
        (7, long + " end", "en", "src1", len(long) + 4),
        (8, "el perro de la casa y los gatos que no se ven", "es", "src2", 45),
        (None, "el perro de la casa y los gatos que no se ven", "es", "src2", 45),
        (9, "!!! 123 ???", "de", "src2", 11),
        (10, "der Hund und die Katze sind nicht in dem Haus", "de", "src3", 45),
        (2, "the other text of a repeated id goes on and on here", "en", "src3", 52),
    ]
    extra = [(*r, i, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOCS + ", _id int, _doc string").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
