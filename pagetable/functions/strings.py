"""Small string helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character Unicode text processing treats as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column) -> Column:
    """Trim all Unicode white space, not just blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` can use it many times but it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_or_null(items: Column) -> Column:
    return F.get(items, F.lit(0))


def positions(items: Column | str) -> Column:
    """``posexplode`` for arrays that are costly to compute; filter on ``pos`` being set.

    For a plain ``posexplode`` the optimizer adds a test that the array is not empty and pushes it
    below the projection, where the array is computed once more per test.
    """
    return F.posexplode_outer(items)
