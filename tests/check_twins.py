"""Runs registered queries against their SQL twins: python tests/check_twins.py DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """Empty text if equal, else the first difference."""
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names, types = [c[0] for c in rel.description], {c[0]: str(c[1]) for c in rel.description}
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    off = [f"{c}: {t} vs {types[c]}" for c, t in df.dtypes if KINDS.get(t) != types[c]]
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} vs {len(want)} rows in {sorted(names)}\n   spark only {extra}\n   sql only   {missing}"
    return f"types {off}" if off else ""


def main(sf_dir, only):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, twins = duck(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = f(spark, sf_dir)
            if name not in twins:
                print(f"rows  {name:28s} {len(df.collect())} {time.time() - start:.1f}", flush=True)
                continue
            diff = compare(df, con, twins[name])
            print(f"{'ok   ' if not diff else 'DIFF '} {name:28s} {time.time() - start:.1f} {diff[:1500]}", flush=True)
        except Exception as e:  # noqa: BLE001 - a report of all queries is wanted
            print(f"FAIL  {name:28s} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
