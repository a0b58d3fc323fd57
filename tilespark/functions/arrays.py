"""Array helpers for per-tile work inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as a lambda
    variable.

    A column read inside a lambda is re-evaluated on every lambda call when
    the optimizer inlines its (possibly expensive) producer, e.g. a tile that
    was just assembled from cells.  Passing it as the argument of a
    one-element ``transform`` binds it once per row instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
