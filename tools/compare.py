"""Compare named queries with their SQL on DuckDB: ``python tools/compare.py DIR [name …]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from evigraph.plans import catalog  # noqa: E402
from evigraph.session import TABLES, build_session  # noqa: E402


def _cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, q, root):
    started = time.time()
    df = q.run(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if q.sql is None:
        return "rows", len(got), spent, ""
    started = time.time()
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    kinds = [str(d[1]) for d in res.description]
    want = rows_of(names, res.fetchall())
    oracle = time.time() - started
    note = f"sql {oracle:.1f}s "
    odd = [f"{n}:{k}" for n, k in zip(names, kinds) if k in ("HUGEINT",) or k.startswith("DECIMAL")]
    if odd:
        note += f"TYPES {odd} "
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), spent, note + f"{sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return "DIFFER", len(got), spent, note + f"{len(want)} rows\n   spark only {str(extra)[:600]}\n   sql only   {str(missing)[:600]}"
    return "ok", len(got), spent, note


def main():
    root, names = sys.argv[1], sys.argv[2:]
    registry = catalog.load()
    chosen = [q for n, q in registry.items()
              if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    bad = 0
    for q in chosen:
        try:
            state, n, spent, note = compare(spark, con, q, root)
        except Exception as error:  # report and go on with the next query
            state, n, spent, note = "ERROR", 0, 0.0, str(error)[:900]
        bad += state not in ("ok", "rows")
        print(f"{state:8} {q.name:28} rows={n:<8} {spent:6.2f}s {note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
