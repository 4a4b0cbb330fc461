"""Rows of a Spark query against rows of its SQL."""

import datetime
import decimal


def plain(v):
    if v is None or isinstance(v, bool | str):
        return repr(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if v != v else repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, relation) -> None:
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    place = [relation.columns.index(c) for c in cols]
    ours = sorted("|".join(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    theirs = sorted("|".join(plain(r[i]) for i in place) for r in relation.fetchall())
    assert ours == theirs
