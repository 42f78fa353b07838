"""Compare queries with their SQL twins: python tests/oracle_check.py SF_DIR [name...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


# Type names that the two engines give the same values.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


def differences(df, con, sql) -> str | None:
    mine, names = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    theirs, other = _rows([c[0] for c in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} against {other}"
    kinds = {c[0]: str(c[1]) for c in cur.description}
    wrong = [(n, t, kinds[n]) for n, t in df.dtypes if KINDS.get(t) != kinds[n]]
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ, such as {bad[:2]}" if bad else None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from flowsieve.session import local_session

    partitions, zone = os.environ.get("PARTITIONS", "8"), os.environ.get("ZONE", "UTC")
    spark = local_session(**{"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": zone})
    con, failed = connect(sf_dir), 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                found = differences(df, con, sql[name])
            else:
                found = None if df.count() >= 0 else "no rows"
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - t0:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed; SQL without query: {sorted(set(sql) - set(entry.queries()))}")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
