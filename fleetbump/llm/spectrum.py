"""Leading eigenpairs of a symmetric matrix by spectrum slicing: inertia counts, then Rayleigh quotient iteration.

``below(a, s)`` counts the eigenvalues under ``s``: the LDL^T factorisation of ``a - s I`` has as many negative pivots
(Sylvester's law of inertia). Bisection with these counts isolates each leading eigenvalue, Rayleigh quotient iteration
converges to it cubically, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALPHA = (1 + np.sqrt(17)) / 8  # the growth bound of Bunch and Kaufman's pivoting
EPS = np.finfo(float).eps


def below(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``a`` under ``shift``, by LDL^T with one- and two-row pivots."""
    m = a - shift * np.eye(len(a))
    n, negative = len(m), 0
    while n:
        # The trailing matrix is ``m``; its first row or first two rows are eliminated.
        size = 1
        if n > 1:
            column = np.abs(m[1:, 0])
            r = int(column.argmax()) + 1
            largest = column[r - 1]
            if abs(m[0, 0]) < ALPHA * largest:
                row = np.abs(m[r])
                row[r] = 0
                if abs(m[0, 0]) * row.max() < ALPHA * largest * largest:
                    swap = 0 if abs(m[r, r]) >= ALPHA * row.max() else 1
                    size = swap + 1
                    order = np.arange(n)
                    order[[swap, r]] = order[[r, swap]]
                    m = m[np.ix_(order, order)]
        pivot, rest, out = m[:size, :size], m[size:, :size], m[size:, size:]
        if size == 2:
            determinant = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] * pivot[1, 0]
            negative += 1 if determinant < 0 else 2 * int(pivot[0, 0] < 0)
            m = out - rest @ np.linalg.solve(pivot, rest.T)
        elif pivot[0, 0] != 0:
            negative += int(pivot[0, 0] < 0)
            m = out - np.outer(rest[:, 0], rest[:, 0] / pivot[0, 0])
        else:  # a zero pivot stands in a zero column: an eigenvalue at the shift itself
            m = out
        n -= size
    return negative


@dataclass
class Pair:
    """Eigenvalue ``number`` (1 is the largest), which lies within ``bound`` of ``value``, and its unit vector."""

    number: int
    value: float
    bound: float
    vector: np.ndarray


class Slicer:
    """Counts asked so far narrow the interval of every eigenvalue, so no count is asked twice."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.n = len(a)
        reach = np.abs(self.a).sum(axis=1).max()  # every eigenvalue is within it, on both sides
        self.unit = max(reach, np.finfo(float).tiny) * EPS * self.n
        self.counts = {-reach - self.unit: self.n, reach + self.unit: 0}

    def at_least(self, shift: float) -> int:
        """Number of eigenvalues at or above ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = self.n - below(self.a, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known [low, high) with eigenvalue ``number``."""
        low = max(s for s, c in self.counts.items() if c >= number)
        high = min((s for s, c in self.counts.items() if c < number and s > low), default=low + self.unit)
        return low, high

    def halve(self, number: int) -> tuple[float, float]:
        low, high = self.interval(number)
        self.at_least((low + high) / 2)
        return self.interval(number)

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval of this eigenvalue alone, or one as narrow as rounding allows (equal eigenvalues)."""
        low, high = self.interval(number)
        while high - low > self.unit and self.at_least(low) - self.at_least(high) > 1:
            low, high = self.halve(number)
        return low, high

    def iterate(self, low: float, high: float, found: list[Pair]) -> tuple[float, float, np.ndarray]:
        """(value, residual, vector) of Rayleigh quotient iteration from the middle of an interval."""
        others = np.array([p.vector for p in found]).reshape(-1, self.n)
        v = np.random.default_rng(len(found)).standard_normal(self.n)
        best, shift, turns = (low, np.inf, v), (low + high) / 2, 0
        while turns < 30:
            v = v - others.T @ (others @ v)
            v /= np.linalg.norm(v)
            try:
                w = np.linalg.solve(self.a - shift * np.eye(self.n), v)
            except np.linalg.LinAlgError:
                w = np.linalg.solve(self.a - (shift + self.unit) * np.eye(self.n), v)
            w -= others.T @ (others @ w)
            v = w / np.linalg.norm(w)
            value = float(v @ self.a @ v)
            residual = float(np.linalg.norm(self.a @ v - value * v))
            if residual < best[1] / 2:
                best = (value, residual, v)
            elif residual <= 8 * self.unit:
                break
            # Two steps of inverse iteration settle on the interval's vector before the shift moves with the quotient.
            turns += 1
            shift = value if turns > 2 and low <= value <= high else (low + high) / 2
        return best

    def pair(self, number: int, found: list[Pair]) -> Pair:
        low, high = self.isolate(number)
        for _ in range(200):
            value, residual, vector = self.iterate(low, high, found)
            bound = max(2 * residual, 4 * self.unit)
            if residual <= 64 * self.unit and self.at_least(value - bound) >= number > self.at_least(value + bound):
                return Pair(number, value, bound, vector)
            if high - low <= self.unit:
                break
            low, high = self.halve(number)
        raise ArithmeticError(f"eigenvalue {number} could not be certified")


def leading(a: np.ndarray, count: int) -> list[Pair]:
    """The ``count`` largest eigenpairs of a covariance, fewer where it has less rank than that."""
    if not a.any():
        return []
    slicer, found = Slicer(a), []
    for number in range(1, min(count, len(a)) + 1):
        one = slicer.pair(number, found)
        if one.value <= 64 * slicer.unit:
            break
        found.append(one)
    return found
