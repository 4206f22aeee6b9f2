"""Order-insensitive comparison of two result sets (used by the oracle checks)."""

from __future__ import annotations

import math


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def _close(a, b):
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        if math.isinf(a) or math.isinf(b):
            return a == b
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    return False


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"COLUMNS spark={sorted(spark_cols)} duck={sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return f"ROWS spark={len(a)} duck={len(b)}"
    exact = all(x == y for x, y in zip(a, b))
    if exact:
        return "exact"
    bad = [(x, y) for x, y in zip(a, b) if not all(_close(p, q) for p, q in zip(x, y))]
    if not bad:
        return "close"
    return f"VALUES {len(bad)} rows differ, first: spark={bad[0][0]} duck={bad[0][1]}"
