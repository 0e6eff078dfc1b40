"""Runs a registered query on Spark and its SQL on DuckDB and compares them exactly."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pyarrow as pa

KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "long", "HUGEINT": "huge",
    "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}
SPARK_KINDS = {"bigint": "long", "smallint": "int", "tinyint": "int", "timestamp": "timestamp_ntz"}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [KINDS.get(str(d[1]).upper(), str(d[1])) for d in cursor.description]
    return names, kinds, cursor.fetchall()


def rows_of_spark(df):
    kinds = [SPARK_KINDS.get(kind, kind) for _, kind in df.dtypes]
    data: pa.Table = df.toArrow()
    return df.columns, kinds, list(zip(*[c.to_pylist() for c in data.columns])) if data.num_columns else []


def order(names, kinds, rows):
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in by_name) for row in rows]
    return [names[i] for i in by_name], [kinds[i] for i in by_name], sorted(picked, key=repr)


def compare(spark, con, name, build, sql, folder):
    """A list of differences; empty when both sides agree."""
    left = order(*rows_of_spark(build(spark, folder)))
    right = order(*rows_of_sql(con, sql))
    problems = []
    if left[0] != right[0]:
        return [f"columns {left[0]} / {right[0]}"]
    if left[1] != right[1]:
        problems.append(
            "types " + str([(n, a, b) for n, a, b in zip(left[0], left[1], right[1]) if a != b])
        )
    if len(left[2]) != len(right[2]):
        problems.append(f"rows {len(left[2])} / {len(right[2])}")
    bad = [(a, b) for a, b in zip(left[2], right[2]) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
        problems.append(f"{len(bad)} rows differ, first in {diff}"[:600])
    if not left[2]:
        problems.append("no rows")
    return problems


def main(argv):
    from sessionloom.plans import catalog
    from tests.conftest import make_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(folder)
    wanted = argv or list(catalog.QUERIES)
    failed = 0
    for name in wanted:
        if name not in catalog.QUERIES:
            names = [n for n in catalog.QUERIES if n.startswith(name)]
        else:
            names = [name]
        for n in names:
            start = time.time()
            try:
                if n in catalog.CHECKS:
                    problems = compare(spark, con, n, catalog.QUERIES[n], catalog.CHECKS[n], folder)
                    note = "ok"
                else:
                    problems = []
                    note = f"rows only: {catalog.QUERIES[n](spark, folder).count()}"
            except Exception as error:  # noqa: BLE001
                problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
            failed += bool(problems)
            print(f"{n:34s} {time.time() - start:6.2f}s {'; '.join(problems) or note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(bool(main(sys.argv[1:])))
