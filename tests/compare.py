"""Order-free comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    return v.isoformat().removesuffix("T00:00:00") if hasattr(v, "isoformat") else v


def assert_same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert mine == theirs
