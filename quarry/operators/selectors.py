"""Column selection by name, glob, regular expression, predicate or mapping.

All of it happens on the driver, on the schema: the result is an ordinary
``select``, so column pruning reaches the scan.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from quarry.sources.elements import arrow_of

_FLAGS = {"i": re.I, "m": re.M, "s": re.S, "x": re.X, "a": re.A, "u": re.U, "l": re.L}
_REGEX = re.compile(r"/(.*)/([a-z]*)", re.S)


@dataclass(frozen=True)
class Branch:
    """A column or a field of a struct column. path: its names from the top."""

    path: tuple[str, ...]
    field: T.StructField

    @property
    def name(self) -> str:
        return self.path[-1]

    @property
    def dataType(self) -> T.DataType:
        return self.field.dataType

    @property
    def interior(self) -> bool:
        return isinstance(self.field.dataType, T.StructType)

    def column(self) -> Column:
        return F.col(".".join(f"`{n.replace('`', '``')}`" for n in self.path))


def branches(schema: T.StructType, recursive: bool | str = True, at: tuple[str, ...] = ()) -> list[Branch]:
    """Columns in schema order, each followed by its fields where recursive holds."""
    out = []
    for f in schema.fields:
        b = Branch((*at, f.name), f)
        out.append(b)
        if recursive and b.interior:
            out += branches(f.dataType, recursive, b.path)
    return out


def names(schema: T.StructType, recursive: bool | str = True, tree: str | None = None, filtername: Callable | None = None, filtertitle: Callable | None = None, aliases: Mapping[str, str] | None = None) -> list[str]:
    """Branch names; ``recursive="/"`` gives them with their provenance, which starts with the tree's name, if given."""
    out = []
    for b in branches(schema, recursive):
        shown = (aliases or {}).get(b.name, b.name)
        title = (b.field.metadata or {}).get("title", "")
        if (filtername is None or filtername(shown)) and (filtertitle is None or filtertitle(title)):
            out.append("/".join([*([tree] if tree else []), *b.path[:-1], shown]) if recursive == "/" else shown)
    return out


def lookup(schema: T.StructType, name: str, recursive: bool = True) -> Branch:
    """The branch of this exact name, or of an exact ``a/b`` path; KeyError if there is none. Case counts."""
    own = branches(schema, recursive)
    for b in own:
        if b.name == name or "/".join(b.path) == name:
            return b
    raise KeyError(name)


def _is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def matcher(pattern: str) -> Callable[[str], bool] | None:
    """A test of names for ``/regex/flags`` (anchored at the start only) or a glob; None of a plain name."""
    m = _REGEX.fullmatch(pattern)
    if m:
        flags = 0
        for c in m[2]:
            if c not in _FLAGS:
                raise ValueError(f"unknown flag {c!r} in {pattern!r}")
            flags |= _FLAGS[c]
        return lambda n: re.compile(m[1], flags).match(n) is not None
    return (lambda n: fnmatch.fnmatchcase(n, pattern)) if _is_glob(pattern) else None


def _readable(b: Branch) -> bool:
    return not isinstance(b.dataType, T.NullType) and not (b.interior and not b.dataType.fields)


def select_all(schema: T.StructType, selector, recursive: bool = True) -> list[tuple[Branch, T.DataType | None]]:
    """Branches that a selector takes, with the type to cast to, repeats kept.

    selector: None for all top-level columns; a name, glob or ``/regex/flags``,
    or several in an iterable; a mapping from these to types; a function of
    the branch that gives exactly True to select, a type to select and cast,
    anything else to skip. A plain name must exist; patterns may match none.
    """
    if isinstance(selector, str):
        selector = [selector]
    if selector is None:
        return [(b, None) for b in branches(schema, False) if _readable(b)]
    if callable(selector):
        out = []
        for b in branches(schema, recursive):
            said = selector(b)
            if said is True:
                out.append((b, None))
            elif isinstance(said, (T.DataType, np.dtype)):
                out.append((b, as_type(said)))
        return [x for x in out if _readable(x[0])]
    pairs = list(selector.items()) if isinstance(selector, Mapping) else [(s, None) for s in selector]
    out, own = [], [b for b in branches(schema, recursive) if _readable(b)]
    for pattern, kind in pairs:
        if not isinstance(pattern, str):
            raise TypeError(f"a selector holds names, not {type(pattern).__name__}")
        kind = as_type(kind)
        test = matcher(pattern)
        if test is None:
            out.append((lookup(schema, pattern, recursive), kind))
        else:
            out += [(b, kind) for b in own if test(b.name) or ("/" in pattern and not pattern.startswith("/") and test("/".join(b.path)))]
    return out


def as_type(kind) -> T.DataType | None:
    """The Spark type that a type, its name in SQL, a NumPy dtype, class or array, or a Python number class stands for."""
    if kind is None or isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, str) and kind[:1] not in "<>=|":
        return T._parse_datatype_string(kind)
    return from_arrow_type(arrow_of(np.dtype(kind.dtype if isinstance(kind, np.ndarray) else kind).str))


def compatible(a, b) -> bool:
    """Whether two targets hold the same values, whatever may be null."""

    def bare(t: T.DataType):
        if isinstance(t, T.StructType):
            return ("struct", *((f.name, bare(f.dataType)) for f in t.fields))
        if isinstance(t, T.ArrayType):
            return ("array", bare(t.elementType))
        if isinstance(t, T.MapType):
            return ("map", bare(t.keyType), bare(t.valueType))
        return t.simpleString()

    return bare(as_type(a)) == bare(as_type(b))


def matches(schema: T.StructType, selector, recursive: bool = True) -> list[str]:
    return [b.name for b, _ in select_all(schema, selector, recursive)]


def cast(column: Column, kind: T.DataType) -> Column:
    """Numbers are cut toward zero; what doesn't fit is null."""
    return column.try_cast(kind)


def select(df: DataFrame, selector=None, recursive: bool | str = True, keep: Iterable[str] = (), namedecode: Callable[[str], str] | None = None, tree: str | None = None) -> DataFrame:
    """The DataFrame of the selected branches, each once, before it the columns named in keep.

    ``recursive="/"`` names columns by their provenance. Names that differ in
    case only are refused, as Spark can't tell them apart.
    """
    chosen: dict[tuple, tuple[Branch, T.DataType | None]] = {}
    for b, kind in select_all(df.schema, selector, bool(recursive)):
        if b.path[0] not in keep:
            chosen.setdefault(b.path, (b, kind))
    shown, cols = [], []
    for b, kind in chosen.values():
        name = "/".join([*([tree] if tree else []), *b.path]) if recursive == "/" else b.name
        shown.append(namedecode(name) if namedecode else name)
        cols.append((cast(b.column(), kind) if kind is not None else b.column()).alias(shown[-1]))
    folded: dict[str, str] = {}
    for n in shown:
        if folded.setdefault(n.lower(), n) != n or shown.count(n) > 1:
            raise ValueError(f"names clash: {folded[n.lower()]!r} and {n!r}")
    return df.select(*[F.col(f"`{k}`") for k in keep], *cols)
