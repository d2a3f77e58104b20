"""Steps over entries: clusters, memory targets, equal steps and explicit ranges."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.entries import entry_range, memory_size


@dataclass(frozen=True)
class Chunk:
    """One stored chunk of a branch: entries [start, stop) and its bytes."""

    branch: str
    start: int
    stop: int
    uncompressed: int = 0
    compressed: int = 0
    items: int = 0


def clusters(chunks: Iterable[Chunk], branches: Iterable[str], start: int, stop: int, strict: bool = False) -> list[tuple[int, int]]:
    """Ranges at whose ends the chunks of all branches end too. strict: only those inside [start, stop), else all that overlap it."""
    edges: dict[str, set[int]] = {b: set() for b in branches}
    for c in chunks:
        if c.branch in edges:
            edges[c.branch] |= {c.start, c.stop}
    common = sorted(set.intersection(*edges.values())) if edges else []
    pairs = list(zip(common, common[1:], strict=False))
    if strict:
        return [(a, b) for a, b in pairs if start <= a and b <= stop]
    return [(a, b) for a, b in pairs if a < stop and b > start]


def memory_step(chunks: Iterable[Chunk], branches: Iterable[str], target: int, start: int, stop: int) -> int | None:
    """Rows a step for about target bytes: max(1, round(ceil(rows * target / bytes))), bytes prorated at the range's ends; None if there are no bytes."""
    if target <= 0:
        raise ValueError("a memory target must be positive")
    own, total = set(branches), 0.0
    for c in chunks:
        rows = min(stop, c.stop) - max(start, c.start)
        if c.branch in own and rows > 0:
            total += c.uncompressed * rows / (c.stop - c.start)
    if not total:
        return None
    return max(1, round(math.ceil((stop - start) * target / total)))


def equal(step: int, start: int, stop: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, stop)) for a in range(start, stop, step)]


def steps(spec, n: int, start: int | None = None, stop: int | None = None, chunks: Iterable[Chunk] = (), branches: Iterable[str] = ()) -> list[tuple[int, int]]:
    """Ranges for a step spec: None for clusters, inf for one step, a positive number of rows, a memory size, or ranges."""
    a, b = entry_range(n, start, stop)
    chunks, branches = list(chunks), list(branches)
    if spec is None:
        return [(max(x, a), min(y, b)) for x, y in clusters(chunks, branches, a, b)]
    if isinstance(spec, str):
        target = memory_size(spec)
        if target is None:
            raise ValueError(f"not a memory size: {spec!r}")
        step = memory_step(chunks, branches, target, a, b)
        return equal(step, a, b) if step else []
    if isinstance(spec, (int, float)) and not isinstance(spec, bool):
        if spec == float("inf"):
            return [(a, b)] if b > a else []
        if spec <= 0 or spec != int(spec):
            raise ValueError(f"a step must be a positive whole number: {spec!r}")
        return equal(int(spec), a, b)
    try:
        pairs = [(int(x), int(y)) for x, y in spec]
    except (TypeError, ValueError) as e:
        raise TypeError(f"not a step: {spec!r}") from e
    return [(x, y) for x, y in ((max(x, a), min(y, b)) for x, y in pairs) if x < y]


def step_of(entry: str, step: int, start: int = 0) -> Column:
    """The number of the equal step that an entry is in: a column, not a loop."""
    return F.expr(f"div(`{entry}` - {start}, {step})")


def step_summary(df: DataFrame, step: int, entry: str = "entry") -> DataFrame:
    """Per equal step: step, entry_start, entry_stop, n; one partial aggregation."""
    return (
        df.groupBy(step_of(entry, step).alias("step"))
        .agg(F.min(entry).alias("entry_start"), (F.max(entry) + 1).alias("entry_stop"), F.count("*").alias("n"))
    )
