"""Exact coefficients: finite differences, interpolation kernels, multi-step integrators.

All are derived with fractions on the driver; on the data they are polynomials in Column form.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Poly = list[Fraction]


def _mul(a: Poly, b: Poly) -> Poly:
    out = [Fraction(0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def _add(a: Poly, b: Poly, factor: Fraction = Fraction(1)) -> Poly:
    n = max(len(a), len(b))
    return [(a[i] if i < len(a) else 0) + factor * (b[i] if i < len(b) else 0) for i in range(n)]


def basis(nodes: list[int | Fraction]) -> list[Poly]:
    """The polynomials that are 1 on one node and 0 on the others."""
    out = []
    for j, x in enumerate(nodes):
        p: Poly = [Fraction(1)]
        for i, y in enumerate(nodes):
            if i != j:
                p = _mul(p, [Fraction(-y) / (x - y), Fraction(1) / (x - y)])
        out.append(p)
    return out


def differentiate(p: Poly, times: int = 1) -> Poly:
    for _ in range(times):
        p = [k * c for k, c in enumerate(p)][1:] or [Fraction(0)]
    return p


def value(p: Poly, x: Fraction) -> Fraction:
    out = Fraction(0)
    for c in reversed(p):
        out = out * x + c
    return out


def fd_weights(nodes: list, order: int, at: Fraction | int = 0) -> list[Fraction]:
    """Weights of a derivative at ``at`` from values on any grid."""
    return [value(differentiate(p, order), Fraction(at)) for p in basis([Fraction(x) for x in nodes])]


@lru_cache
def lagrange(n: int) -> tuple[Poly, ...]:
    """2n+2 weights on the nodes -n..n+1."""
    if not 1 <= n <= 10:
        raise ValueError("n is 1 to 10")
    return tuple(basis(list(range(-n, n + 2))))


def _hermite(m: int) -> tuple[list[Poly], list[Poly]]:
    """Polynomials with one of value, first, ..., m-th derivative 1 at 0 (or at 1) and the rest 0."""
    size = 2 * m + 2
    rows = [differentiate_row(size, d, Fraction(x)) for x in (0, 1) for d in range(m + 1)]
    inverse = _inverse(rows)
    columns = [[inverse[i][j] for i in range(size)] for j in range(size)]
    return columns[: m + 1], columns[m + 1 :]


def differentiate_row(size: int, d: int, x: Fraction) -> list[Fraction]:
    row = []
    for k in range(size):
        c = Fraction(1)
        for i in range(d):
            c *= k - i
        row.append(c * x ** (k - d) if k >= d else Fraction(0))
    return row


def _inverse(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    n = len(rows)
    a = [list(r) + [Fraction(i == j) for j in range(n)] for i, r in enumerate(rows)]
    for i in range(n):
        k = next(r for r in range(i, n) if a[r][i] != 0)
        a[i], a[k] = a[k], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i and a[r][i] != 0:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i])]
    return [r[n:] for r in a]


@lru_cache
def spline(n: int, m: int) -> tuple[Poly, ...]:
    """2n+2 weights whose interpolant has m continuous derivatives.

    On [0, 1] it meets the values at both ends and derivatives 1..m there, which are centred
    differences over 2n+1 points.
    """
    if not 1 <= n <= 10 or not 0 <= m <= 2 * n:
        raise ValueError("n is 1 to 10 and m at most 2n")
    left, right = _hermite(m)
    out: list[Poly] = [[Fraction(0)] for _ in range(2 * n + 2)]
    for d in range(m + 1):
        weights = fd_weights(list(range(-n, n + 1)), d)
        for j, w in enumerate(weights):
            out[j] = _add(out[j], left[d], w)
            out[j + 1] = _add(out[j + 1], right[d], w)
    return tuple(out)


def kernel(n: int, m: int) -> tuple[Poly, ...]:
    """By neighbours and smoothness; smoothness 0 stands for the Lagrange family, without neighbours the linear one."""
    if n == m == 0:
        return tuple(basis([0, 1]))
    return lagrange(n) if m == 0 else spline(n, m)


def horner(p: Poly, x: Column) -> Column:
    """The polynomial as an expression."""
    out = F.lit(float(p[-1]))
    for c in reversed(p[:-1]):
        out = out * x + F.lit(float(c))
    return out


def weights(n: int, m: int, x: Column, derivative: int = 0) -> Column:
    """Array of the kernel's weights at offset ``x``, for each cell."""
    return F.array(*[horner(differentiate(p, derivative), x) for p in kernel(n, m)])


def sql(p: Poly, x: str) -> str:
    """The polynomial as SQL text, by powers."""
    return " + ".join(f"({float(c)!r}) * power({x}, {k})" if k else f"({float(c)!r})" for k, c in enumerate(p) if c or not k)


@lru_cache
def adams_bashforth(s: int) -> tuple[Fraction, ...]:
    """Weights of the newest, second newest, ... right-hand side; exact for polynomials of degree s-1."""
    if not 1 <= s <= 6:
        raise ValueError("1 to 6 steps")
    out = []
    for p in basis([Fraction(-k) for k in range(s)]):
        out.append(sum(c / (k + 1) for k, c in enumerate(p)))
    return tuple(out)
