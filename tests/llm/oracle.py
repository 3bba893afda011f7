"""A query's rows against its SQL's, as the driver compares them."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def duck(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    done = con.execute(sql)
    return sorted(c[0] for c in done.description), rows_of([c[0] for c in done.description], done.fetchall())


def same(frame, sql, sf):
    names, expected = duck(sql, sf)
    assert sorted(frame.columns) == names
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == expected
