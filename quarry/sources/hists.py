"""Histograms and profiles of one to three axes in the file format."""

from __future__ import annotations

import re

import numpy as np

from quarry.operators.hist import Axis, Histogram, HistogramND, Profile
from quarry.sources.binary import In, Out

# Fixed values of the format: letter of a class -> big-endian type of its bins.
BINS = {"C": ">i1", "S": ">i2", "I": ">i4", "F": ">f4", "D": ">f8"}
# Fixed values of the format: versions of classes by number of axes.
BASE_VERSION, OWN_VERSION, PROFILE_VERSION = {2: 4, 3: 5}, {1: 3, 2: 3, 3: 3}, {1: 7, 2: 8, 3: 8}
# Fixed values of the format: sums that a base class of two or three axes keeps after those of the first axis.
MORE_SUMS = {2: 3, 3: 7}
_NONE = Axis(1, 0.0, 1.0)


def _doubles(o: Out, values) -> Out:
    return o.put("i", len(values)).raw(np.asarray(values, ">f8").tobytes())


def _label(text: str, number: int):
    return lambda o: o.object(1, lambda x: x.put("HII", 1, number, 0x03000000).string(text))


def _axis(name: str, axis: Axis):
    def labels(o: Out):
        def items(x: Out):
            x.base_object().string("").put("i", len(axis.labels))
            for i, text in enumerate(axis.labels, 1):
                x.pointer(("label", name, i), "TObjString", _label(text, i)).string("")

        o.object(5, items)

    def fill(o: Out):
        o.named(name, axis.title)
        o.object(4, lambda x: x.put("ihhhfffhh", 510, 1, 1, 42, 0.005, 0.035, 0.03, 1, 1) .put("f", 1.0))
        o.put("idd", axis.n, axis.low, axis.high)
        _doubles(o, axis.edges)
        o.put("iiHb", 0, 0, 0, 0).string("")
        (o.pointer(("labels", name), "THashList", labels) if axis.labels else o.pointer(None)).pointer(None)

    return fill


def _base(h, axes: tuple[Axis, ...], name: str, values: np.ndarray, squares: np.ndarray):
    """What all classes share: titles, axes, sums of the first axis, squared weights."""

    def fill(o: Out):
        o.named(name, h.title)
        o.object(2, lambda x: x.put("hhh", 602, 1, 1)).object(2, lambda x: x.put("hh", 0, 1001)).object(2, lambda x: x.put("hhf", 1, 1, 1.0))
        o.put("i", values.size)
        for n, a in zip(("xaxis", "yaxis", "zaxis"), (*axes, _NONE, _NONE), strict=False):
            o.object(10, _axis(n, a))
        inner = (slice(1, -1),) * len(axes)
        v = values[inner]
        w = v.sum(tuple(range(1, len(axes))))
        mid = (axes[0].bounds()[1:] + axes[0].bounds()[:-1]) / 2
        sums = w.sum(), squares[inner].sum(), (w * mid).sum(), (w * mid * mid).sum()
        o.put("hhd", 0, 1000, float(values.sum())).put("dddd", *map(float, sums)).put("ddd", -1111.0, -1111.0, 0.0)
        _doubles(o, [])
        _doubles(o, squares.ravel(order="F"))
        o.string("").object(5, lambda x: x.base_object().string("").put("i", 0)).put("ibii", 0, 0, 0, 2)

    return lambda o: o.object(8, fill)


def _sums(axes: tuple[Axis, ...], values: np.ndarray) -> list[float]:
    """Sums over the inner bins of w * y, w * y * y, w * x * y and, of three axes, the same with z."""
    v = values[(slice(1, -1),) * len(axes)]
    mids = np.meshgrid(*[(a.bounds()[1:] + a.bounds()[:-1]) / 2 for a in axes], indexing="ij")
    x, y, *rest = mids
    terms = [y, y * y, x * y]
    if rest:
        z = rest[0]
        terms += [z, z * z, x * z, y * z]
    return [float((v * t).sum()) for t in terms]


def _bins(h, axes: tuple[Axis, ...], name: str, values: np.ndarray, squares: np.ndarray, kind: str):
    """The class of a histogram with its bins, the first axis running fastest."""
    base = _base(h, axes, name, values, squares)

    def of_axes(o: Out):
        base(o)
        if len(axes) == 2:
            o.put("d", 1.0)
        else:
            o.object(1, lambda x: x)
        o.put(f"{MORE_SUMS[len(axes)]}d", *_sums(axes, values))

    def fill(o: Out):
        if len(axes) == 1:
            base(o)
        else:
            o.object(BASE_VERSION[len(axes)], of_axes)
        flat = values.ravel(order="F")
        o.put("i", len(flat)).raw(flat.astype(BINS[kind]).tobytes())

    return lambda o: o.object(OWN_VERSION[len(axes)], fill)


def class_of(h, kind: str = "D") -> str:
    n = 1 if isinstance(h, Histogram) else len(h.axes)
    return ("TProfile" + (f"{n}D" if n > 1 else "")) if isinstance(h, Profile) else f"TH{n}{kind}"


def write_hist(h: Histogram | HistogramND | Profile, name: str, origin: int, kind: str = "D") -> bytes:
    """The object of class_of(h, kind), with under- and overflow and the sums of squared weights."""
    out = Out(origin)
    if not isinstance(h, Profile):
        axes = (h.axis,) if isinstance(h, Histogram) else h.axes
        _bins(h, axes, name, h.allvalues, h.allvariances, kind)(out)
        return bytes(out.parts)
    inner = (slice(1, -1),) * len(h.axes)

    def profile(o: Out):
        _bins(h, h.axes, name, h.sums, h.squares, "D")(o)
        _doubles(o, h.entries.ravel(order="F")).put("i", 0).put("dddd", 0.0, 0.0, float(h.sums[inner].sum()), float(h.squares[inner].sum()))
        _doubles(o, h.entries2.ravel(order="F"))

    return bytes(out.object(PROFILE_VERSION[len(h.axes)], profile).parts)


def _read_label(cls: str, d: In, end: int | None, note) -> str:
    d.header()
    d.base_object()
    return d.string()


def _read_labels(cls: str, d: In, end: int | None, note) -> tuple[str, ...]:
    d.header()
    d.base_object()
    d.string()
    out = []
    for _ in range(d.take("i")):
        out.append(d.pointer(_read_label))
        d.string()
    return tuple(out)


def _array(d: In, kind: str = ">f8") -> np.ndarray:
    n = d.take("i")
    return np.frombuffer(d.bytes(n * np.dtype(kind).itemsize), kind).astype(float)


def _read_axis(d: In) -> Axis:
    _, stop = d.header()
    _, title = d.named()
    d.skip()
    n, low, high = d.take("idd")
    edges = tuple(_array(d).tolist())
    d.take("iiHb")
    d.string()
    labels = d.pointer(_read_labels) or ()
    d.at = stop
    return Axis(n, low, high, edges, labels, title)


def read_hist(d: In, cls: str) -> Histogram | HistogramND | Profile:
    """TH1, TH2, TH3 of C, S, I, F or D, and TProfile, TProfile2D, TProfile3D."""
    m = re.fullmatch(r"TH([123])([CSIFD])|TProfile([23]?)D?", cls)
    if m is None:
        raise TypeError(f"{cls} can't be read")
    count, kind = int(m[1] or m[3] or 1), BINS[m[2] or "D"]
    if not m[1]:
        d.header()
    d.header()
    end = d.header()[1] if count > 1 else None
    _, base_end = d.header()
    name, title = d.named()
    for _ in range(3):
        d.skip()
    d.take("i")
    axes = [_read_axis(d) for _ in range(3)][:count]
    d.take("hhddddd")
    d.take("ddd")
    _array(d)
    squares = _array(d)
    d.at = base_end if end is None else end
    values = _array(d, kind)
    shaped = lambda x: x.reshape([a.n + 2 for a in axes], order="F")
    values = shaped(values)
    squares = shaped(squares) if len(squares) else values.copy()
    if m[1]:
        return Histogram(axes[0], values, squares, name, title) if count == 1 else HistogramND(tuple(axes), values, squares, name, title)
    entries = shaped(_array(d))
    d.take("idddd")
    entries2 = _array(d)
    return Profile(tuple(axes), entries, shaped(entries2) if len(entries2) else entries.copy(), values, squares, name, title)
