"""Stored bytes as columns: other readings of the same bytes, and decoders of elements. A batch at a time, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quarry.sources.binary import In
from quarry.sources.elements import Quantised, Record, arrow_of, decode_bits


def reinterpret(column: Column | str, stored: str, target: str) -> Column:
    """The bits of numbers of one NumPy type read as another of the same width (\"f8\" as \"i8\"); null stays null."""
    a, b = np.dtype(stored), np.dtype(target)
    if a.itemsize != b.itemsize:
        raise ValueError(f"{stored} and {target} differ in width")
    kind = from_arrow_type(arrow_of(f"<{b.str[1:]}"))

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        none = x.is_null().to_numpy(zero_copy_only=False)
        bits = x.fill_null(0).to_numpy(zero_copy_only=False).astype(a).view(b)
        return pa.array(bits, mask=none)

    return run(F.col(column) if isinstance(column, str) else column)


def raw(column: Column | str) -> Column:
    """Stored bytes as numbers from 0 to 255, to look at."""
    text = F.hex(F.col(column) if isinstance(column, str) else column)
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("int"))


def decode(df: DataFrame, column: str, element, out: str) -> DataFrame:
    """df with the column out: what the binary column holds, one element a row.

    element: a Quantised, a Record, a whole number for bit sets of so many
    bits, or an element of parse(). Null bytes are null.
    """
    if isinstance(element, int):
        kind = pa.list_(pa.bool_())
        read = lambda data: decode_bits(data, element)[0].tolist()
    elif isinstance(element, Quantised):
        kind = element.arrow
        read = lambda data: element.decode(data)[0].item()
    elif isinstance(element, Record):
        kind = element.arrow
        read = lambda data: element.decode(data)[0].as_py()
    else:
        kind = element.arrow
        read = lambda data: element.read(In(data))
    schema = StructType([*df.schema.fields, StructField(out, from_arrow_type(kind))])
    to = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            got = pa.array([None if x is None else read(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, got], to, strict=True)], schema=to)

    return df.mapInArrow(run, schema)
