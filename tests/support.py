"""What the test modules share; a name of its own, as there is more than one ``conftest``."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df, *columns):
    """Rows as sorted tuples."""
    found = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))
