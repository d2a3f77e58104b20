"""Functions on list columns, row by row, as JVM higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def counts(lists) -> Column:
    """Length of each list; null of a null list."""
    return F.when(_c(lists).isNotNull(), F.size(_c(lists)))


def pick(lists, i: int) -> Column:
    """Element i (negative from the end), null where the list is too short."""
    c = _c(lists)
    return F.get(c, F.lit(i)) if i >= 0 else F.get(c, F.size(c) + i)


def cut_inner(values, masks, test: Callable[[Column], Column] = lambda m: m) -> Column:
    """The elements of values whose partner in masks passes the test; both have the same length."""
    named = F.zip_with(_c(values), _c(masks), lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(named, lambda x: test(x["m"])), lambda x: x["v"])


def total(lists) -> Column:
    """Sum of each list in order, 0 of an empty one."""
    return F.aggregate(_c(lists), F.lit(0.0), lambda a, x: a + x.cast("double"))


def least(lists) -> Column:
    """Smallest element, null of an empty list."""
    return F.array_min(_c(lists))


def greatest(lists) -> Column:
    """Largest element, null of an empty list, so that comparisons with it drop the row."""
    return F.array_max(_c(lists))


def any_of(masks, test: Callable[[Column], Column] = lambda m: m) -> Column:
    return F.exists(_c(masks), test)


def all_of(masks, test: Callable[[Column], Column] = lambda m: m) -> Column:
    return F.forall(_c(masks), test)


def cross(a, b) -> Column:
    """All pairs of each row's two lists as structs (i0, i1), the first list's order first."""
    return F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: F.struct(x.alias("i0"), y.alias("i1")))))


def choose(lists, n: int) -> Column:
    """All n elements of different places, in order, as structs (i0, ..., in-1)."""
    c = _c(lists)
    return F.transform(argchoose(c, n), lambda at: F.struct(*[F.get(c, at[f"i{k}"]).alias(f"i{k}") for k in range(n)]))


def argchoose(lists, n: int) -> Column:
    """Places of choose(), as structs of ints."""
    if n < 1:
        raise ValueError("n must be positive")
    c = _c(lists)

    def after(k: int, taken: list[Column]) -> Column:
        low = taken[-1] + 1 if taken else F.lit(0)
        own = F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda i: (i >= low) & (i < F.size(c)))
        if k == n - 1:
            return F.transform(own, lambda i: F.struct(*[x.alias(f"i{j}") for j, x in enumerate([*taken, i])]))
        return F.flatten(F.transform(own, lambda i: after(k + 1, [*taken, i])))

    return after(0, [])


def argmax(lists) -> Column:
    """Place of the first largest element, null of an empty list."""
    return F.nullif(F.array_position(_c(lists), F.array_max(_c(lists))), F.lit(0)) - 1


def argmin(lists) -> Column:
    return F.nullif(F.array_position(_c(lists), F.array_min(_c(lists))), F.lit(0)) - 1


def gather(lists, places) -> Column:
    """The elements at the given places, null where there is none."""
    return F.transform(_c(places), lambda i: F.get(_c(lists), i.cast("int")))


def flatten_all(lists, depth: int = 2) -> Column:
    """A list of lists (of lists ...) as one list."""
    out = _c(lists)
    for _ in range(depth - 1):
        out = F.flatten(out)
    return out


def elementwise(f: Callable[..., Column], *lists) -> Column:
    """f applied to the elements of one list, or of two of the same length."""
    if len(lists) == 1:
        return F.transform(_c(lists[0]), f)
    if len(lists) == 2:
        return F.zip_with(_c(lists[0]), _c(lists[1]), f)
    first, *rest = lists
    return F.transform(_c(first), lambda x, i: f(x, *[F.get(_c(r), i) for r in rest]))


def zip_map(keys, values) -> Column:
    """A map from two lists side by side, as of split pairs."""
    return F.map_from_arrays(_c(keys), _c(values))
