"""Column functions over arrays in time linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def islands(items: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """Runs of an array's items, as arrays: an item begins a new one where ``begins(item, the one before)``; none for an empty array."""

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)))
        starts = F.filter(places, lambda i: (i == 1) | F.coalesce(begins(F.element_at(xs, i), F.element_at(xs, F.greatest(i - 1, F.lit(1)))), F.lit(False)))
        runs = let(starts, lambda at: F.transform(at, lambda s, k: F.slice(xs, s, F.coalesce(F.get(at, k + 1), F.size(xs) + 1) - s)))
        return F.when(F.size(xs) > 0, runs).otherwise(F.slice(F.array(xs), 1, 0))

    return let(items, cut)
