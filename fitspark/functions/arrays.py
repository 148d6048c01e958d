"""Arrays, sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """The sum in order, in double; 0 of an empty array."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """The vector with length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths and zero vectors."""
    n = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(ok, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    """The square of the Euclidean distance of two vectors."""
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def similarity_of_distance(squared: Column) -> Column:
    """Cosine similarity of two unit vectors from the square of their distance."""
    return 1 - squared / 2


def overlap(a: Column, b: Column) -> Column:
    """Shared members over all members, at least one."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once; in lambdas it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


#: Steps of a fold that gathers rows, before what it has gathered is set aside.
BLOCK = 256


def gathered(items: Column, state: Column, row: str, step) -> Column:
    """The rows that a fold over the items gives, as array<row>; step(state, item) is (new state, array of rows).

    A fold that appends to an array copies it at each step. Here blocks of BLOCK
    items have arrays of their own, which are flattened once, so that the work is
    in proportion to the items.
    """
    none = F.expr(f"cast(array() as array<{row}>)")

    def add(acc: Column, x: Column) -> Column:
        new, rows = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], rows).alias("out"))

    def folded(a: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            return F.aggregate(F.slice(a, k, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), add, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(starts, F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{row}>>)").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return bound(items, folded)


def distinct_by(items: Column, key) -> Column:
    """The items without those whose key occurred before, in order.

    Keys are sorted with their places, the first place of each key is kept, and the
    places are sorted again: O(n log n).
    """

    def first_places(s: Column) -> Column:
        kept = F.filter(s, lambda x, j: (j == 0) | ~x["k"].eqNullSafe(F.get(s, j - 1)["k"]))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def pick(a: Column) -> Column:
        placed = F.sort_array(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        return F.transform(bound(placed, first_places), lambda i: F.get(a, i))

    return bound(items, pick)


def shrunk_top_mean(values: Column, k: int, floor: float, span: float, shrink: float) -> Column:
    """Mean of the k largest, scaled to 0..1, times n / (n + shrink); 0 of an empty array."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    n = F.size(values)
    mean = F.try_divide(total(top), F.size(top).cast("double"))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean - floor) / span))
    return F.when(n > 0, scaled * n / (n + shrink)).otherwise(F.lit(0.0))
