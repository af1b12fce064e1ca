"""Compares queries with SQL on the smallest tables, where they are there."""

from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def differences(spark, query, sql):
    """Rows on one side only."""
    import duckdb

    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = query(spark, str(FOLDER))
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    return [x for x in ours if x not in set(theirs)], [x for x in theirs if x not in set(ours)], len(ours) - len(theirs)
