"""Rows of two frames in an order of their own, numbers rounded."""

from __future__ import annotations

import numpy as np
import pandas as pd


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, (float, np.floating)) and value != value):
        return None
    if isinstance(value, (float, np.floating)) or hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    return int(value) if isinstance(value, np.integer) else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    assert a == b
