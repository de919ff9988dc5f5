"""Comparison of two results as sorted rows of plain values."""

from __future__ import annotations

import math


def plain(v):
    if v is None:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if str(v) in ("NaT", "<NA>"):
        return "null"
    try:
        return f"{float(v):.6g}" if not isinstance(v, (str, bool)) else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False))
