"""Arithmetic modulo the prime 2**61 - 1 on numpy arrays of uint64."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P, _LOW32, _LOW29 = np.uint64(P), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
_32, _29, _61, _3 = np.uint64(32), np.uint64(29), np.uint64(61), np.uint64(3)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod P for a, b < P, by 32-bit halves; 2**61 is 1, so high parts fold back by shifts."""
    ah, al, bh, bl = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    mid, low = ah * bl + al * bh, al * bl
    s = ((ah * bh) << _3) + (mid >> _29) + ((mid & _LOW29) << _32) + (low & _P) + (low >> _61)
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= _P, s - _P, s)


def product_by_group(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of the rows of each group (`starts` as for reduceat, none empty), by halving every group at a time."""
    lengths = np.diff(np.append(starts, len(values)))
    while lengths.max(initial=1) > 1:
        half = (lengths + 1) // 2
        first = np.repeat(starts, half) + 2 * _ramp(half)
        paired = first + 1 < np.repeat(starts + lengths, half)
        out = values[first]
        out[paired] = mul(out[paired], values[first[paired] + 1])
        values, lengths = out, half
        starts = np.cumsum(half) - half
    return values


def _ramp(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def solve(rows: list[list[int]]) -> list[int] | None:
    """A solution of a linear system over the field (each row: coefficients, then right side); free unknowns are 0.

    None if the system contradicts itself.
    """
    n = len(rows[0]) - 1
    rows = [r[:] for r in rows]
    pivots: list[int] = []
    at = 0
    for col in range(n):
        k = next((i for i in range(at, len(rows)) if rows[i][col]), None)
        if k is None:
            continue
        rows[at], rows[k] = rows[k], rows[at]
        inv = pow(rows[at][col], P - 2, P)
        top = rows[at] = [x * inv % P for x in rows[at]]
        for i in range(at + 1, len(rows)):
            if f := rows[i][col]:
                row = rows[i]
                rows[i] = row[:col] + [(x - f * y) % P for x, y in zip(row[col:], top[col:])]
        pivots.append(col)
        at += 1
        if at == len(rows):
            break
    if any(r[n] for r in rows[at:]):
        return None
    out = [0] * n
    for i in range(at - 1, -1, -1):
        row = rows[i]
        out[pivots[i]] = (row[n] - sum(row[j] * out[j] for j in range(pivots[i] + 1, n) if row[j])) % P
    return out
