"""Queries against their SQL: python tests/compare.py [sf_dir] [query ...]"""

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, db, sf_dir, name, query, sql):
    """None if the results are equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if got != expected:
        odd = [pair for pair in zip(got, expected) if pair[0] != pair[1]][:3]
        return f"{len(got)} rows instead of {len(expected)}; {odd}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from eventfold.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = local_session("8"), database(sf_dir)
    for name, query in contract.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        begun = time.time()
        try:
            if name in contract.oracle_sql():
                wrong = compare(spark, db, sf_dir, name, query, contract.oracle_sql()[name])
            else:
                wrong = f"(no SQL) {query(spark, sf_dir).count()} rows"
        except Exception as error:
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"\n## {name} {time.time() - begun:.1f}s {wrong or 'ok'}", flush=True)
