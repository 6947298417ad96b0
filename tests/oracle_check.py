"""Run registered queries against DuckDB: ``python -m tests.oracle_check sf0.01 [names]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((type(v).__name__ if isinstance(v, bool) else "", v) for v in row)


def compare(spark, con, sf_dir: str, name: str) -> list[str]:
    """Problems found, empty when names, row counts and all values agree."""
    df = entry_module.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return []
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    position = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in position) for r in want]
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = Counter(map(_key, got)), Counter(map(_key, want))
    if a != b:
        extra, lacking = list((a - b).elements()), list((b - a).elements())
        problems.append(f"{len(extra)} rows differ; columns {df.columns}")
        order = lambda r: tuple(str(v) for v in r)
        problems += [f"  spark  {[v for _, v in r]}" for r in sorted(extra, key=order)[:3]]
        problems += [f"  duckdb {[v for _, v in r]}" for r in sorted(lacking, key=order)[:3]]
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_kinds = {d[0]: str(d[1]) for d in cursor.description}
    if "-v" in sys.argv:
        print({c: (spark_kinds[c], duck_kinds[c]) for c in names})
    return problems


def main() -> None:
    from surveyspan.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [a for a in sys.argv[2:] if not a.startswith("-")] or list(entry_module.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n" if problems else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
