from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldlake.functions import kernels as K

PAIRS = [(n, m) for n in (1, 2, 3, 4, 6, 10) for m in (0, 1, 2, 4) if m <= 2 * n]


@pytest.mark.parametrize("n, m", PAIRS)
def test_weights_sum_to_one_and_meet_the_nodes(n, m):
    for family in (K.spline(n, m), K.lagrange(n)):
        for x in (Fraction(0), Fraction(1, 3), Fraction(1)):
            assert sum(K.value(p, x) for p in family) == 1
        assert [K.value(p, Fraction(0)) for p in family] == [Fraction(j == n) for j in range(2 * n + 2)]
        assert [K.value(p, Fraction(1)) for p in family] == [Fraction(j == n + 1) for j in range(2 * n + 2)]


@pytest.mark.parametrize("n, m", [p for p in PAIRS if p[1]])
def test_splines_reproduce_lines_and_join_smoothly(n, m):
    family = K.spline(n, m)
    x = Fraction(2, 7)
    assert sum((j - n) * K.value(p, x) for j, p in enumerate(family)) == x
    for d in range(1, m + 1):  # the right end's derivative is the next cell's at its left end
        right = [Fraction(0)] + [K.value(K.differentiate(p, d), Fraction(1)) for p in family][1:]
        left = [Fraction(0)] + [K.value(K.differentiate(p, d), Fraction(0)) for p in family][:-1]
        assert right == left


@pytest.mark.parametrize("n", range(1, 6))
def test_lagrange_reproduces_polynomials(n):
    x = Fraction(3, 8)
    for degree in range(2 * n + 2):
        assert sum(Fraction(j - n) ** degree * K.value(p, x) for j, p in enumerate(K.lagrange(n))) == x**degree


@pytest.mark.parametrize("s", range(1, 7))
def test_multi_step_is_exact_for_polynomials(s):
    for degree in range(s):
        assert sum(c * Fraction(-k) ** degree for k, c in enumerate(K.adams_bashforth(s))) == Fraction(1, degree + 1)


@given(st.lists(st.integers(-9, 9), min_size=4, max_size=7, unique=True), st.integers(0, 3))
def test_difference_weights_are_exact(nodes, order):
    for degree in range(len(nodes)):
        expected = 0 if degree != order else [1, 1, 2, 6][order]
        assert sum(w * Fraction(x) ** degree for w, x in zip(K.fd_weights(nodes, order), nodes)) == expected


def test_bounds():
    for bad in (lambda: K.lagrange(0), lambda: K.spline(1, 3), lambda: K.adams_bashforth(7)):
        with pytest.raises(ValueError):
            bad()
