"""Run a registered query in Spark and its SQL in DuckDB; compare results.

Mirrors the driver's check: same row count, same column names, and the
same multiset of rows after normalising values (doubles to 6 places).
Usable as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        if r == int(r) and abs(r) < 1e15:
            return str(int(r))
        return f"{r:.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, int):
        return str(v)
    return str(v)


def normalise(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


# Spark simple type name -> DuckDB type name of the same logical type
TYPE_PAIRS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
              "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        bad_types = [f"{c}:{t}/{d_types.get(c)}" for c, t in sdf.dtypes
                     if TYPE_PAIRS.get(t, t) != d_types.get(c)]
        if bad_types:
            problems.append(f"types {bad_types}")
    if not problems:
        a, b = normalise(s_rows, s_cols), normalise(d_rows, d_cols)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return problems, t1 - t0, t2 - t1, len(s_rows)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from fitframe.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    if os.environ.get("FF_VANILLA"):  # the driver's plain session: default configs
        from pyspark.sql import SparkSession
        b = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
            .config("spark.ui.showConsoleProgress", "false")
        if os.environ.get("FF_NO_ANSI"):
            b = b.config("spark.sql.ansi.enabled", "false")
        if os.environ.get("FF_NO_BROADCAST"):
            b = b.config("spark.sql.autoBroadcastJoinThreshold", "-1")
        if os.environ.get("FF_NO_AQE"):
            b = b.config("spark.sql.adaptive.enabled", "false")
        if os.environ.get("FF_TZ"):
            b = b.config("spark.sql.session.timeZone", os.environ["FF_TZ"])
        spark = b.getOrCreate()
    else:
        spark = local_session(8)
    con = duck(sf_dir)
    q, o = queries(), oracle_sql()
    bad = 0
    for n in names:
        if n not in o:
            t0 = time.time()
            rows = q[n](spark, sf_dir).count()
            print(f"ROWS  {n}: {rows} rows ({time.time() - t0:.1f}s, no oracle)")
            continue
        try:
            problems, ts, td, nrows = compare(spark, con, n, q[n], o[n], sf_dir)
        except Exception as e:  # report and continue
            problems, ts, td, nrows = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], 0, 0, 0
        status = "OK   " if not problems else "FAIL "
        bad += bool(problems)
        print(f"{status}{n}: {nrows} rows spark {ts:.1f}s duck {td:.2f}s {'; '.join(problems)}")
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
