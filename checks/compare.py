"""Compare queries with their expected answers: ``python -m checks.compare SF_DIR [name ..]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from touchline.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def compare(spark, sf: str, name: str) -> str:
    """One line on the agreement of a query with its SQL, rows compared as a multiset."""
    start = time.time()
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    ours = got.select(columns).toPandas()
    took = time.time() - start
    if name not in ORACLE:
        return f"rows-only {name}: {len(ours)} rows, {took:.1f}s"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    start = time.time()
    relation = con.sql(ORACLE[name])
    theirs = relation.df()
    sql_took = time.time() - start
    if sorted(theirs.columns) != columns:
        return f"BAD {name}: columns {columns} against {sorted(theirs.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN"}
    odd = [
        f"{c}: {t} against {types[c]}" for c, t in got.dtypes if kinds.get(t) != types[c]
    ]
    counts = [
        frame[columns].astype(object).where(frame[columns].notna(), None).value_counts(dropna=False)
        for frame in (ours, theirs)
    ]
    rows = [
        {tuple("" if v is None else str(float(v)) if isinstance(v, (int, float)) else str(v)
               for v in key): n for key, n in zip(c.index, c, strict=True)}
        for c in counts
    ]
    line = f"{name}: {len(ours)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"
    if odd:
        line += f" TYPES {odd}"
    if rows[0] == rows[1]:
        return f"ok  {line}"
    extra = list(rows[0].keys() - rows[1].keys())[:3]
    lacking = list(rows[1].keys() - rows[0].keys())[:3]
    return f"BAD {line} against {len(theirs)}\n   only spark {extra}\n   only sql {lacking}"


if __name__ == "__main__":
    session = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:] or QUERIES:
        try:
            print(compare(session, sys.argv[1], query), flush=True)
        except Exception as error:  # keep going; the line says what failed
            print(f"FAIL {query}: {str(error)[:600]}", flush=True)
