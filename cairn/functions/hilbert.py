"""Hilbert codes of grid cells, as Arrow-vectorised functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_codes(cells: np.ndarray, depth: int) -> np.ndarray:
    """Codes of ``cells[n, 3]`` (0 <= cell < 2**depth): Gray-code transposition of the axes, then interleaving."""
    x = cells.astype(np.uint64).T.copy()
    top = np.uint64(1) << np.uint64(depth - 1)
    q = top
    while q > 1:
        low = q - np.uint64(1)
        for axis in range(3):
            on = (x[axis] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap if axis else np.uint64(0)
        q >>= np.uint64(1)
    x[1] ^= x[0]
    x[2] ^= x[1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        turn ^= np.where((x[2] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= turn
    code = np.zeros(x.shape[1], np.uint64)
    for bit in range(depth - 1, -1, -1):
        for axis in range(3):
            code = (code << np.uint64(1)) | ((x[axis] >> np.uint64(bit)) & np.uint64(1))
    return code.astype(np.int64)


def hilbert_cells(codes: np.ndarray, depth: int) -> np.ndarray:
    """The cells of ``codes``: the inverse of ``hilbert_codes``."""
    codes = codes.astype(np.uint64)
    x = np.zeros((3, len(codes)), np.uint64)
    for bit in range(depth):
        for axis in range(3):
            x[axis] |= ((codes >> np.uint64(3 * bit + 2 - axis)) & np.uint64(1)) << np.uint64(bit)
    gray = x[2] >> np.uint64(1)
    x[2] ^= x[1]
    x[1] ^= x[0]
    x[0] ^= gray
    for bit in range(1, depth):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for axis in (2, 1, 0):
            on = (x[axis] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap if axis else np.uint64(0)
    return x.T.astype(np.int64)


def hilbert(gx, gy, gz, batch=None, depth: int = 16, swapped: bool = False) -> Column:
    """Hilbert code of a cell; ``swapped`` exchanges x and y; the batch number goes on top."""

    @F.pandas_udf("long")
    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes(np.stack([a, b, c], axis=1), depth))

    gx, gy = (gy, gx) if swapped else (gx, gy)
    found = code(gx, gy, gz)
    return found if batch is None else F.shiftleft(F.col(batch).cast("long") if isinstance(batch, str) else batch.cast("long"), 3 * depth).bitwiseOR(found)


def hilbert_cell(code, depth: int = 16) -> Column:
    """``struct<gx, gy, gz>`` of a code without batch bits."""

    @F.pandas_udf("gx long, gy long, gz long")
    def cell(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(hilbert_cells(codes.to_numpy() & ((1 << (3 * depth)) - 1), depth), columns=["gx", "gy", "gz"])

    return cell(code)
