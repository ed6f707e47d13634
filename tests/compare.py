"""Rows of a Spark query and of its SQL in one comparable form."""

from collections import Counter

import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "__index__"):
        return str(int(v))
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([_cell(x) for x in v])
    return str(v)


def rows(df: pd.DataFrame) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    # numbers that are whole in one engine may be doubles in the other
    if x != y:
        norm = lambda c: Counter({tuple(_number(v) for v in k): n for k, n in c.items()})
        x, y = norm(x), norm(y)
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])


def _number(v):
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return v
