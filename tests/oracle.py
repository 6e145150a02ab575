"""Compare a registered query with its DuckDB twin, column by column, without row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

from __spark_entry__ import oracle_sql, queries


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, dict)):
        raise AssertionError("nested value in a query result")
    return value


def _sorted_rows(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in place) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, name: str, folder: str) -> int:
    """Number of rows when equal; raises with the first differences otherwise."""
    df = queries()[name](spark, folder)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    want = _sorted_rows(columns, cur.fetchall())
    types_got = [type(v).__name__ for v in got[0]] if got else []
    types_want = [type(v).__name__ for v in want[0]] if want else []
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        raise AssertionError(f"{name}: {len(got)} rows, twin {len(want)}; columns {sorted(columns)}; only here {extra}; only twin {missing}")
    assert types_got == types_want or None in got[0] + want[0], (name, types_got, types_want)
    return len(got)
