"""Histograms as small tables: bin, low, high, sumw, sumw2.

Bin 0 counts what lies under the first edge, bin n + 1 what lies at or over
the last. A fill is one partial aggregation over any number of rows; what
comes out has n + 2 rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """n equal bins from low to high, or edges of bins of any width; labels name the bins."""

    n: int
    low: float
    high: float
    edges: tuple[float, ...] = ()
    labels: tuple[str, ...] = ()
    title: str = ""

    @classmethod
    def variable(cls, edges: Sequence[float], **more) -> Axis:
        return cls(len(edges) - 1, float(edges[0]), float(edges[-1]), tuple(map(float, edges)), **more)

    def bounds(self) -> np.ndarray:
        return np.array(self.edges) if self.edges else np.linspace(self.low, self.high, self.n + 1)

    def bin(self, x: Column, closed: bool = False) -> Column:
        """The bin of x, null of null and NaN; closed: the last bin holds its upper edge too."""
        x = x.cast("double")
        if self.edges:
            at = F.lit(0)
            for e in self.edges:
                at = at + F.when(x >= e, 1).otherwise(0)
            at = F.when(x.isNotNull() & ~F.isnan(x), at)
        else:
            at = F.when(x.isNotNull() & ~F.isnan(x), F.width_bucket(x, F.lit(self.low), F.lit(self.high), F.lit(self.n)))
        at = at.cast("long")
        return F.when(x == self.high, F.lit(self.n).cast("long")).otherwise(at) if closed else at


def fill(df: DataFrame, x: Column | str, axis: Axis, weight: Column | None = None, closed: bool = False) -> DataFrame:
    """bin, sumw, sumw2 of the bins that have entries."""
    x = F.col(x) if isinstance(x, str) else x
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(axis.bin(x, closed).alias("bin"), w.alias("w")).where("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))


def complete(filled: DataFrame, axis: Axis) -> DataFrame:
    """All n + 2 bins with their edges; empty ones have 0."""
    e = axis.bounds()
    rows = [(i, float(e[i - 1]) if i else -float("inf"), float(e[i]) if i <= axis.n else float("inf")) for i in range(axis.n + 2)]
    bins = filled.sparkSession.createDataFrame(rows, "bin bigint, low double, high double")
    out = bins.join(filled, "bin", "left")
    return out.select("bin", "low", "high", F.coalesce("sumw", F.lit(0.0)).alias("sumw"), F.coalesce("sumw2", F.lit(0.0)).alias("sumw2"))


def fill_2d(df: DataFrame, x, y, x_axis: Axis, y_axis: Axis, weight: Column | None = None) -> DataFrame:
    """x_bin, y_bin, sumw, sumw2."""
    c = lambda a: F.col(a) if isinstance(a, str) else a
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(x_axis.bin(c(x)).alias("x_bin"), y_axis.bin(c(y)).alias("y_bin"), w.alias("w")).where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    return rows.groupBy("x_bin", "y_bin").agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))


def add(*filled: DataFrame) -> DataFrame:
    """The sum of fills of the same axis."""
    out = filled[0]
    for f in filled[1:]:
        out = out.unionByName(f)
    keys = [c for c in out.columns if c.endswith("bin")]
    return out.groupBy(*keys).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))


def normalize(filled: DataFrame) -> DataFrame:
    """Divides by the total of all bins, which is one number."""
    total = F.sum("sumw").over(W.partitionBy(F.lit(0)))  # over as many rows as bins
    scaled = filled.withColumn("of_total", total)
    return scaled.withColumns({"sumw": F.col("sumw") / F.col("of_total"), "sumw2": F.col("sumw2") / (F.col("of_total") * F.col("of_total"))}).drop("of_total")


@dataclass
class Histogram:
    """A filled histogram on the driver, with under- and overflow at the ends."""

    axis: Axis
    allvalues: np.ndarray
    allvariances: np.ndarray
    name: str = ""
    title: str = ""
    stats: dict = field(default_factory=dict)

    @classmethod
    def collect(cls, filled: DataFrame, axis: Axis, name: str = "", title: str = "") -> Histogram:
        values, squares = np.zeros(axis.n + 2), np.zeros(axis.n + 2)
        for r in filled.select("bin", "sumw", "sumw2").collect():  # n + 2 rows at most
            values[r.bin], squares[r.bin] = r.sumw, r.sumw2
        return cls(axis, values, squares, name, title)

    @property
    def edges(self) -> np.ndarray:
        return self.axis.bounds()

    @property
    def values(self) -> np.ndarray:
        return self.allvalues[1:-1]

    @property
    def variances(self) -> np.ndarray:
        return self.allvariances[1:-1]

    def numpy(self):
        return self.values, self.edges

    def to_df(self, spark: SparkSession) -> DataFrame:
        return complete(spark.createDataFrame([(i, float(v), float(s)) for i, (v, s) in enumerate(zip(self.allvalues, self.allvariances, strict=True))], "bin bigint, sumw double, sumw2 double"), self.axis)

    def pandas(self):
        import pandas as pd

        e = np.concatenate(([-np.inf], self.edges, [np.inf]))
        return pd.DataFrame({"count": self.allvalues, "variance": self.allvariances}, index=pd.IntervalIndex.from_breaks(e, closed="left"))

    def hepdata(self) -> str:
        """A HEPData record in YAML text."""
        head = f"dependent_variables:\n- header: {{name: {self.title or self.name or 'counts'}}}\n  values:\n"
        body = "".join(f"  - errors:\n    - {{label: stat, symerror: {float(np.sqrt(s))!r}}}\n    value: {float(v)!r}\n" for v, s in zip(self.values, self.variances, strict=True))
        tail = f"independent_variables:\n- header: {{name: {self.axis.title or 'x'}}}\n  values:\n"
        return head + body + tail + "".join(f"  - {{high: {float(b)!r}, low: {float(a)!r}}}\n" for a, b in zip(self.edges, self.edges[1:], strict=False))

    def show(self, width: int = 60) -> str:
        """A plot in text, a line a bin."""
        e = np.concatenate(([-np.inf], self.edges, [np.inf]))
        top = max(self.allvalues.max(), 1e-300)
        name = lambda i: self.axis.labels[i - 1] if 0 < i <= len(self.axis.labels) else f"[{e[i]:g}, {e[i + 1]:g})"
        wide = max(len(name(i)) for i in range(len(self.allvalues)))
        return "\n".join(f"{name(i):>{wide}} {v:<10g}|{'*' * round(width * v / top)}" for i, v in enumerate(self.allvalues))


@dataclass
class HistogramND:
    """A filled histogram of one to three axes on the driver; arrays have an index per axis, each with under- and overflow."""

    axes: tuple[Axis, ...]
    allvalues: np.ndarray
    allvariances: np.ndarray
    name: str = ""
    title: str = ""

    @classmethod
    def collect(cls, filled: DataFrame, axes: Sequence[Axis], name: str = "", title: str = "") -> HistogramND:
        """From a fill whose bin columns come first, in the order of the axes."""
        shape = tuple(a.n + 2 for a in axes)
        values, squares = np.zeros(shape), np.zeros(shape)
        for r in filled.collect():  # a row a bin at most
            at = tuple(r[: len(axes)])
            values[at], squares[at] = r.sumw, r.sumw2
        return cls(tuple(axes), values, squares, name, title)

    @property
    def values(self) -> np.ndarray:
        return self.allvalues[(slice(1, -1),) * len(self.axes)]

    @property
    def variances(self) -> np.ndarray:
        return self.allvariances[(slice(1, -1),) * len(self.axes)]

    def numpy(self):
        return self.values, [a.bounds() for a in self.axes]

    def project(self, axis: int) -> Histogram:
        """Summed over all other axes, their under- and overflow included."""
        other = tuple(i for i in range(len(self.axes)) if i != axis)
        return Histogram(self.axes[axis], self.allvalues.sum(other), self.allvariances.sum(other), self.name, self.title)


@dataclass
class Profile:
    """Per bin of one to three axes the sums of weights, of their squares, of w * y and of w * y * y."""

    axes: tuple[Axis, ...]
    entries: np.ndarray
    entries2: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    name: str = ""
    title: str = ""

    @classmethod
    def collect(cls, filled: DataFrame, axes: Sequence[Axis], name: str = "", title: str = "") -> Profile:
        shape = tuple(a.n + 2 for a in axes)
        out = [np.zeros(shape) for _ in range(4)]
        for r in filled.collect():  # a row a bin at most
            for a, v in zip(out, (r.sumw, r.sumw2, r.sumwy, r.sumwy2), strict=True):
                a[tuple(r[: len(axes)])] = v
        return cls(tuple(axes), *out, name, title)

    @property
    def means(self) -> np.ndarray:
        """Mean of y per inner bin; NaN where nothing was filled."""
        inner = (slice(1, -1),) * len(self.axes)
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.sums[inner] / self.entries[inner]

    @property
    def errors(self) -> np.ndarray:
        """Error of the mean per inner bin: spread over the root of the effective number of entries."""
        inner = (slice(1, -1),) * len(self.axes)
        n, n2, sq = self.entries[inner], self.entries2[inner], self.squares[inner]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.sqrt(np.maximum(sq / n - self.means**2, 0.0) * n2) / n


def fill_nd(df: DataFrame, xs: Sequence[Column | str], axes: Sequence[Axis], weight: Column | None = None, y: Column | str | None = None) -> DataFrame:
    """bin_0, bin_1 ..., sumw, sumw2, and with y sumwy and sumwy2 for a profile: one partial aggregation."""
    c = lambda a: F.col(a) if isinstance(a, str) else a
    keys = [f"bin_{i}" for i in range(len(axes))]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    ys = [] if y is None else [c(y).cast("double").alias("y")]
    rows = df.select(*[a.bin(c(x)).alias(k) for k, x, a in zip(keys, xs, axes, strict=True)], w.alias("w"), *ys).dropna(subset=[*keys, *(["y"] if ys else [])])
    w, y = F.col("w"), F.col("y")
    more = [F.sum(w * y).alias("sumwy"), F.sum(w * y * y).alias("sumwy2")] if ys else []
    return rows.groupBy(*keys).agg(F.sum(w).alias("sumw"), F.sum(w * w).alias("sumw2"), *more)
