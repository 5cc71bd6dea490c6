"""Compares the named queries with their SQL: ``compare.py SF_DIR [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    def norm(v):
        return None if v is None or v != v else float(v) + 0.0 if isinstance(v, float) else v
    out = [tuple(norm(r[k]) for k in order) for r in values]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """``(ok, message)`` for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(got[1])} rows, no SQL, spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"{name}: {len(got[1])} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if got == want:
        return True, note
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:3]
    return False, f"{note}\n   MISMATCH {got[0]} vs {want[0]}, {len(got[1])} vs {len(want[1])} rows, {bad}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from kmerweave import build_session
    session = build_session("compare", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        try:
            ok, message = compare(session, con, name, entry.queries()[name], entry.oracle_sql().get(name), sys.argv[1])
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", message, flush=True)
        failed += [] if ok else [name]
    print("failed:", failed)
