"""Order-insensitive comparison of a Spark and a DuckDB result."""

import math


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    result = con.execute(sql)
    expected = normal([c[0] for c in result.description], result.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == expected
