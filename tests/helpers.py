"""Comparison of rows from two engines."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def of_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_duck(relation):
    return table(relation.columns, relation.fetchall())
