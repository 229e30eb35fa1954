"""Rows of either engine in one form."""

import math


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return None
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "uint")):
        return round(float(x), 6)
    return x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([value(x) for x in r]) for r in frame[names].itertuples(index=False, name=None))
