"""Every registered query against its SQL, and the large-data paths once more."""

import os

import duckdb
import pytest
from support import SF

from checks.compare import TABLES, compare
from checks.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for table in TABLES:
        found.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SF, table)}.parquet'")
    return found


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, name, SF)
    assert result.startswith("ok ") and "types" not in result, result


LARGE = """ordered_view position_of_total neighbors advance_target next_error range_select lru_evict lru_evict_shared
progress_monotonic sort_taken_at prioritize path_order apply_sync scan_diff missing_photos export_plan_clashing
batch_accounting export_scope for_root""".split()


@pytest.mark.parametrize("name", LARGE)
def test_large_data_path_matches_sql(spark, con, tiny_limits, name):
    result, _ = compare(spark, con, name, SF)
    assert result.startswith("ok "), result


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "root" and df.count() == 7
