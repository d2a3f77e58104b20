"""Two-, three- and four-vectors as struct columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cartesian(x, y, z, e) -> Column:
    """A Lorentz vector from its components."""
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), _c(z).cast("double").alias("z"), _c(e).cast("double").alias("e"))


def from_pt_eta_phi_mass(pt_, eta_, phi_, mass_) -> Column:
    p, h, f, m = (_c(a).cast("double") for a in (pt_, eta_, phi_, mass_))
    x, y, z = p * F.cos(f), p * F.sin(f), p * F.sinh(h)
    return cartesian(x, y, z, F.sqrt(x * x + y * y + z * z + m * m))


def add(a, b) -> Column:
    a, b = _c(a), _c(b)
    return cartesian(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"], a["e"] + b["e"])


def pt(v) -> Column:
    return F.hypot(_c(v)["x"], _c(v)["y"])


def p(v) -> Column:
    v = _c(v)
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def phi(v) -> Column:
    return F.atan2(_c(v)["y"], _c(v)["x"])


def eta(v) -> Column:
    """Pseudorapidity asinh(z / pt); infinite along the axis."""
    v = _c(v)
    return F.when(pt(v) != 0, F.asinh(v["z"] / F.nullif(pt(v), F.lit(0.0)))).otherwise(F.when(v["z"] > 0, float("inf")).when(v["z"] < 0, -float("inf")).otherwise(0.0))


def mass2(v) -> Column:
    v = _c(v)
    return v["e"] * v["e"] - v["x"] * v["x"] - v["y"] * v["y"] - v["z"] * v["z"]


def mass(v) -> Column:
    """Invariant mass; null where its square is negative."""
    return F.when(mass2(v) >= 0, F.sqrt(F.greatest(mass2(v), F.lit(0.0))))


def delta_phi(a, b) -> Column:
    """phi(a) - phi(b) in [-pi, pi)."""
    d = phi(a) - phi(b) + math.pi
    return d - 2 * math.pi * F.floor(d / (2 * math.pi)) - math.pi


def delta_r(a, b) -> Column:
    return F.hypot(eta(a) - eta(b), delta_phi(a, b))
