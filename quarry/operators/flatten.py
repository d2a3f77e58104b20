"""Nested to flat: rows per entry, or per entry and subentry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatname(branch: str, field: str | None, index: tuple[int, ...]) -> str:
    """The column name of one element: ``branch.field[i][j]``."""
    return branch + (f".{field}" if field else "") + "".join(f"[{i}]" for i in index)


def jagged(schema: T.StructType, fixed: Iterable[str] = ()) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in fixed]


def drop_jagged(df: DataFrame, fixed: Iterable[str] = ()) -> DataFrame:
    """Without the columns of lists that vary in length."""
    return df.drop(*jagged(df.schema, set(fixed)))


def explode_fixed(df: DataFrame, shapes: dict[str, tuple[int, ...]], name: Callable = flatname) -> DataFrame:
    """Each fixed array as one column an element, row-major. A length that differs from the shape is an error at run time."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name not in shapes:
            cols.append(col)
            continue
        todo = [((), col)]
        for n in shapes[f.name]:
            todo = [((*at, i), F.when(F.size(c) == n, F.get(c, F.lit(i))).otherwise(F.when(c.isNotNull(), F.raise_error(f"{f.name}: length differs from {n}")))) for at, c in todo for i in range(n)]
        cols += [c.alias(name(f.name, None, at)) for at, c in todo]
    return df.select(*cols)


def explode_structs(df: DataFrame, name: Callable = flatname) -> DataFrame:
    """Each struct column as ``name.field`` columns; fields whose names begin with a space are hidden."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            cols += [col.getField(g.name).alias(name(f.name, g.name, ())) for g in f.dataType.fields if not g.name.startswith(" ")]
        else:
            cols.append(col)
    return df.select(*cols)


def flatten(df: DataFrame, columns: Iterable[str] | None = None, fixed: dict[str, tuple[int, ...]] | None = None, entry: str = "entry", subentry: str = "subentry", name: Callable = flatname) -> DataFrame:
    """One row per entry and subentry: (entry, subentry, other columns, list elements).

    All list columns (or those named) go side by side and must have the same
    length in each row, else the query fails. Other columns repeat. Entries
    with empty or null lists vanish. Without list columns the rows stay as
    they are. Fixed arrays and structs become columns.
    """
    fixed = fixed or {}
    lists = list(columns) if columns is not None else jagged(df.schema, fixed)
    if lists:
        q = lambda c: F.col(f"`{c}`")
        same = F.lit(True)
        for c in lists[1:]:
            same = same & (F.coalesce(F.size(q(c)), F.lit(-1)) == F.coalesce(F.size(q(lists[0])), F.lit(-1)))
        zipped = F.arrays_zip(*[q(c).alias(f"f{i}") for i, c in enumerate(lists)])
        checked = F.when(same, zipped).otherwise(F.raise_error("lists differ in length: " + ", ".join(lists))) if len(lists) > 1 else zipped
        names = df.select(zipped.alias("z")).schema["z"].dataType.elementType.fieldNames()
        rest = [q(c) for c in df.columns if c not in lists]
        df = df.select(*rest, F.posexplode(checked).alias(subentry, "element"))
        df = df.select(*[q(c) for c in df.columns if c != "element"], *[F.col("element").getField(n).alias(c) for n, c in zip(names, lists, strict=True)])
    df = explode_structs(explode_fixed(df, fixed, name), name)
    front = [c for c in (entry, subentry) if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*front, *(c for c in df.columns if c not in front)]])


def concatenate(df: DataFrame, column: str) -> DataFrame:
    """The contents of a list column, one element a row, without row identity."""
    return df.select(F.explode(f"`{column}`").alias(column))


def unstack(flat: DataFrame, value: str, most: int, entry: str = "entry", subentry: str = "subentry") -> DataFrame:
    """One row an entry with value[0] to value[most - 1]; what an entry lacks is null."""
    picked = [F.max(F.when(F.col(subentry) == i, F.col(f"`{value}`"))).alias(f"{value}[{i}]") for i in range(most)]
    return flat.groupBy(entry).agg(*picked)
