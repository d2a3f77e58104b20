"""Helpers shared by the operators: shared tables, id ranges, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side with at most so many rows of a few numbers may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: Bytes of a batch that become lists at once.
SLICE = 8 << 20
#: The column that tells rows apart where doc_id may not.
ROW = "row_of_docs"
_OWN: dict[str, str] = {}
_KEPT: dict[str, Callable] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9]+', '-', label.lower())}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            return


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it from there.

    It cuts the lineage: what comes later survives lost executors without
    running the earlier steps again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(make: Callable) -> Callable:
    """make(*arguments), kept by a worker process for the tasks of one operator: tasks of others let it go."""
    kept = lru_cache(maxsize=2)(make)
    _KEPT[make.__name__] = kept
    return kept


def let_go(but: str | None) -> None:
    """Empties a worker's caches but one."""
    for name, f in _KEPT.items():
        if name != but:
            f.cache_clear()


def give_back() -> None:
    """Returns a worker's free memory to the system: the next task may be another operator's, or the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema: str | StructType, arrays: bool = False, keeps: str | None = None) -> DataFrame:
    """mapInArrow for functions that take and give columns as lists or arrays.

    arrays: they take NumPy arrays, for columns of numbers without nulls.
    keeps: the worker_cache that they use. Batches are of about SLICE bytes, for
    the whole session from then on: so many rows of long texts wouldn't fit.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE))
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = out.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(out)

    def run(batches):
        let_go(keeps)

        def columns():
            for b in batches:
                rows = b.num_rows if arrays else max(1, b.num_rows * SLICE // max(1, b.nbytes))
                for at in range(0, b.num_rows, rows or 1):
                    part = b.slice(at, rows)
                    yield {n: part.column(i).to_numpy(zero_copy_only=False) if arrays else part.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        try:
            for got in fn(columns()):
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=to.field(n).type) for n in names], schema=to)
        finally:
            give_back()

    return df.mapInArrow(run, out)


def added(rows: DataFrame, add: Callable, schema: str, key: str = "block", ways: int = 256) -> DataFrame:
    """groupBy(key) with add(pandas), which gives one row like those that it gets, in two steps: no group grows with the tasks that rows come from."""
    some = rows.withColumn("way", F.spark_partition_id() % ways).groupBy(key, "way").applyInPandas(lambda p: add(p.drop(columns="way")), schema)
    return some.groupBy(key).applyInPandas(add, schema)


def bits(i: int) -> int:
    """An unsigned 64-bit number as Spark's signed long."""
    return i - (1 << 64) if i >> 63 else i


def id_ranges(df: DataFrame, key: str, parts: int) -> list:
    """At most parts - 1 ascending bounds that cut key into ranges of about as many rows."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.select(key).where(F.col(key).isNotNull()).approxQuantile(key, probs, max(1e-4, 0.1 / parts))
    return sorted({int(x) for x in got})


def range_of(col, bounds: list):
    """Number of bounds at or below col; nulls come first. The bounds are as few as partitions."""
    if not bounds:
        return F.lit(0)
    text = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    name = col if isinstance(col, str) else col._jc.toString()
    return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.expr(f"size(filter({text}, b -> b <= {name}))"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a column ROW, if it has none: a long of each row's own, never null, that ascends with the key, nulls first.

    It is the key itself where no row lacks one or shares it. Otherwise the
    rows are sorted and written once with their numbers; a hot key is dealt
    over tasks like any other rows.
    """
    if ROW in docs.columns:
        return docs
    if docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn(ROW, F.col(key))
    own = docs.withColumn(ROW, F.monotonically_increasing_id()).orderBy(F.col(key).asc_nulls_first(), ROW)
    return stored(own.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keep_by(docs: DataFrame, ids: DataFrame, count: int, how: str, key: str = "doc_id") -> DataFrame:
    """docs left semi or anti joined to ids by key; broadcast only where count allows it.

    Null ids match null ids.
    """
    name = fresh(docs, "other_id")
    small = ids.select(F.col(key).alias(name))
    if count <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return docs.join(small, docs[key].eqNullSafe(F.col(name)), how)
