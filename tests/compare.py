"""Rows of two engines made comparable."""

from decimal import Decimal


def plain(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, duck, sql):
    cur = duck.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, expected)
