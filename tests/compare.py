"""Runs a registered query on Spark and its SQL on DuckDB and compares the results as bags of rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from quire.sources.tables import NAMES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else (int(value) if value.is_integer() and abs(value) < 2**53 else float(f"{value:.10g}"))
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def kind(name: str) -> str:
    name = name.lower()
    for key, words in {"int": ("int", "long"), "real": ("double", "float", "decimal"), "text": ("string", "varchar"), "bool": ("bool",), "time": ("time", "date")}.items():
        if any(w in name for w in words):
            return key
    return name


def compare(df, con, sql: str):
    """None when equal, else a short description of the first difference."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: kind(str(c[1])) for c in result.description}
    theirs = result.fetchall()
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} vs {order}"
    ours_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [(c, ours_types[c], types[c]) for c in order if kind(ours_types[c]) != types[c]]
    if wrong:
        return f"types {wrong}"
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    index = [names.index(c) for c in order]
    wanted = Counter(tuple(plain(r[i]) for i in index) for r in theirs)
    if ours == wanted:
        return None
    a, b = (str(sorted(x.items(), key=str)[:4])[:700] for x in (ours - wanted, wanted - ours))
    return f"rows {sum(ours.values())} vs {sum(wanted.values())}\n  only spark: {a}\n  only sql:   {b}\n  columns {order}"


def main(argv: list[str]) -> int:
    from quire import catalog
    from quire.session import build_session

    sf_dir = argv[0]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"(no sql) {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        status = "ok" if problem is None else problem
        bad += problem is not None and not problem.startswith("(no sql)")
        print(f"{name:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
