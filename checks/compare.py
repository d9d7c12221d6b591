"""Runs registered queries in Spark and DuckDB and compares the rows.

``python -m checks.compare SF_DIR [name ...]``
"""

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from checks.queries import QUERIES, SQL
from photocat.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame()
    for name in sorted(pdf.columns):
        column = pdf[name]
        if pd.api.types.is_bool_dtype(column):
            out[name] = column.astype("string")
        elif pd.api.types.is_integer_dtype(column):
            out[name] = column.astype("string")
        elif pd.api.types.is_float_dtype(column):
            out[name] = column.map(lambda v: None if pd.isna(v) else f"{v:.9g}")
        elif column.dtype == object:
            def text(v):
                if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                    return None
                return f"{v:.9g}" if isinstance(v, float) else str(v)

            out[name] = column.map(text)
        else:
            out[name] = column.astype("string")
        out[name] = out[name].astype("string").fillna("<null>")
    return out.sort_values(list(out.columns), ignore_index=True)


def compare(spark, con, name, sf_dir):
    started = time.time()
    got = QUERIES[name](spark, sf_dir).toArrow()
    took = time.time() - started
    if name not in SQL:
        return f"rows {got.num_rows}", took
    want = con.sql(SQL[name]).to_arrow_table()
    types = {
        f.name: (str(f.type), str(want.schema.field(f.name).type))
        for f in got.schema
        if f.name in want.schema.names
        and str(f.type) != str(want.schema.field(f.name).type)
    }
    note = f" types {types}" if types else ""
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(got.column_names)} vs {sorted(want.column_names)}", took
    a = canonical(got.to_pandas(integer_object_nulls=True))
    b = canonical(want.to_pandas(integer_object_nulls=True))
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}{note}", took
    if not a.equals(b):
        where = (a != b).any(axis=1)
        columns = list(a.columns[(a != b).any()])
        return (
            f"VALUES differ in {where.sum()} rows, {columns}{note}\n"
            f"{a[where].head(3).to_string()}\n{b[where].head(3).to_string()}",
            took,
        )
    return f"ok {len(a)}{note}", took


def main(argv):
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    bad = 0
    for name in names:
        try:
            result, took = compare(spark, con, name, sf_dir)
        except Exception as error:
            result, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not result.startswith(("ok", "rows"))
        print(f"{took:6.2f}s {name:24s} {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
