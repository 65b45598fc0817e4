"""Jaro-Winkler similarity as an Arrow-batched function over matrices of code points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The boost applies above this similarity, by this weight for each of at most this many common first letters.
BOOST_ABOVE, PREFIX_WEIGHT, PREFIX_MAX = 0.7, 0.1, 4
_CHUNK = 4096


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    width = max(1, max(map(len, texts), default=1))
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return codes, np.fromiter(map(len, texts), int, len(texts))


def _chunk(a: list[str], b: list[str]) -> np.ndarray:
    x, nx = _matrix(a)
    y, ny = _matrix(b)
    rows, at = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)[:, None]
    free = at < ny[:, None]
    hit_x = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = (y == x[:, i, None]) & free & (np.abs(at - i) <= reach) & (i < nx)[:, None]
        j = fits.argmax(axis=1)
        found = fits[rows, j]
        hit_x[:, i] = found
        free[rows[found], j[found]] = False
    hit_y = (at < ny[:, None]) & ~free
    m = hit_x.sum(axis=1)
    width = min(x.shape[1], y.shape[1])
    left = np.take_along_axis(x, np.argsort(~hit_x, axis=1, kind="stable"), axis=1)[:, :width]
    right = np.take_along_axis(y, np.argsort(~hit_y, axis=1, kind="stable"), axis=1)[:, :width]
    swaps = ((left != right) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    k = min(PREFIX_MAX, width)
    same = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(nx, ny)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + PREFIX_WEIGHT * prefix * (1 - jaro), jaro)


def jaro_winkler_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarities of two series; None where a side is None. Repeated pairs are computed once, pairs of like length together."""
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
    known = pairs.dropna().drop_duplicates()
    order = np.argsort(np.maximum(known["a"].str.len(), known["b"].str.len()).to_numpy(), kind="stable")
    values = np.empty(len(known))
    ka, kb = known["a"].to_numpy(), known["b"].to_numpy()
    for s in range(0, len(order), _CHUNK):
        at = order[s : s + _CHUNK]
        values[at] = _chunk(list(ka[at]), list(kb[at]))
    known = known.assign(s=values)
    return pairs.merge(known, on=["a", "b"], how="left")["s"]


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return jaro_winkler_pairs(a, b) if len(a) else pd.Series([], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity in [0, 1]; null if a side is null, 0 if both are empty."""
    return _jaro_winkler(a, b)
