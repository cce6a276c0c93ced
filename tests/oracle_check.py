"""Run the catalogue and its SQL side by side: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def compare(spark_df, db, sql: str) -> str | None:
    """What differs, or None. Columns by name, rows in any order, values exactly."""
    columns = sorted(spark_df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in spark_df.collect()), key=repr)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    types = dict(zip(names, (str(d[1]) for d in result.description)))
    wanted = {c: TYPES[t] for c, t in spark_df.dtypes}
    if types != wanted:
        return f"types {wanted} / {types}"
    place = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{repr(a)[:400]} / {repr(b)[:400]}"
    return None


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as spark_entry
    from siftline.sources import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
           "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="siftline-")},
    )
    spark.sparkContext.setLogLevel("OFF")
    db, queries, sqls = connect(sf_dir), spark_entry.queries(), spark_entry.oracle_sql()
    names, bad = sys.argv[2:] or list(sqls), 0
    print("without SQL:", sorted(set(queries) - set(sqls)), "SQL only:", sorted(set(sqls) - set(queries)))
    for name in names:
        start = time.time()
        try:
            problem = compare(queries[name](spark, sf_dir), db, sqls[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
