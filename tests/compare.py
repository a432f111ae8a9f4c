"""Run each query beside its SQL: columns, row counts, values. Usage: compare.py SF_DIR [name...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        cells = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and math.isnan(v):
                v = None
            cells.append(v)
        out.append(tuple(cells))
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None if equal, else a description of the first difference."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} vs {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    return f"{len(diff)} differ, first {diff[0]}" if diff else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from wearline.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), e.oracle_sql()
    for name, function in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {type(error).__name__} {str(error)[:700]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
