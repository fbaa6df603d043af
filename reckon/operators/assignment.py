"""Least-cost pairing of the rows that exact matching leaves in a duplicate-key group."""

from __future__ import annotations

import numpy as np


def pair_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns differ between each row of a and each row of b (arrays of text)."""
    return (a[:, None, :] != b[None, :, :]).sum(2)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column once, as many as there can be.

    Shortest augmenting paths with dual prices, one row added at a time; the scan over columns is
    vectorised."""
    turned = cost.shape[0] > cost.shape[1]
    c = np.asarray(cost.T if turned else cost, float)
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for new in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, last, rows = new, 0.0, -1, [new]
        while True:
            through = base + c[row] - row_price[row] - column_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], last
            last = int(np.where(done, np.inf, reach).argmin())
            base, done[last] = reach[last], True
            if row_of[last] < 0:
                break
            row = int(row_of[last])
            rows.append(row)
        seen = np.nonzero(done)[0]
        row_price[new] += base
        for k in seen:
            if row_of[k] >= 0:
                row_price[row_of[k]] += base - reach[k]
        column_price[seen] -= base - reach[seen]
        k = last
        while k >= 0:  # hand each column on the path to the row before it
            before = int(via[k])
            row_of[k] = row_of[before] if before >= 0 else new
            k = before
    pairs = [(int(r), k) for k, r in enumerate(row_of) if r >= 0]
    return sorted((k, r) for r, k in pairs) if turned else sorted(pairs)
