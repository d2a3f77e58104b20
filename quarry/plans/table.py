"""A table of columns over an entry number, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import entries, flatten, selectors, steps


class Table:
    """df with an entry column. Reads declare plans; iterate, show and clusters run actions."""

    def __init__(self, df: DataFrame, name: str = "tree", entry: str = "entry", chunks: list[steps.Chunk] | None = None, title: str = ""):
        self.df, self.name, self.entry, self.title = df, name, entry, title
        self._chunks, self._n = chunks, None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if f.name != self.entry])

    @property
    def numentries(self) -> int:
        if self._n is None:
            self._n = self.df.count()
        return self._n

    @property
    def numbranches(self) -> int:
        return len(self.schema)

    def keys(self, recursive: bool | str = False, filtername: Callable | None = None, filtertitle: Callable | None = None, aliases=None) -> list[str]:
        return selectors.names(self.schema, recursive, self.name, filtername, filtertitle, aliases)

    def get(self, name: str) -> selectors.Branch:
        return selectors.lookup(self.schema, name)

    def __contains__(self, name: str) -> bool:
        try:
            return bool(self.get(name))
        except KeyError:
            return False

    def matches(self, selector) -> list[str]:
        return selectors.matches(self.schema, selector)

    def show(self, foldnames: bool = False) -> str:
        """A line a branch: name, whether it is a group of branches, the type that it is read as. foldnames: long names on lines of their own."""
        out = []
        for b in selectors.branches(self.schema):
            name = f"{'  ' * (len(b.path) - 1)}{b.name}"
            out += [name, f"{'':<30} {b.dataType.simpleString()}"] if foldnames and len(name) > 29 else [f"{name:<30} {b.dataType.simpleString()}"]
        return "\n".join(out)

    def lazyarrays(self, branches=None, entrystart=None, entrystop=None, recursive: bool | str = True, namedecode=None) -> DataFrame:
        """The selected columns of an entry range, after the entry number."""
        rows = entries.slice_entries(self.df, entrystart, entrystop, self.entry, self._n)
        return selectors.select(rows, branches, recursive, keep=[self.entry], namedecode=namedecode, tree=self.name)

    def array(self, branch, interpretation: T.DataType | str | None = None, entrystart=None, entrystop=None, flat: bool = False) -> DataFrame:
        """One column with its entry; ValueError if the selector takes not exactly one. flat: list contents, one a row."""
        found = selectors.select_all(self.schema, branch)
        if len(found) != 1:
            raise ValueError(f"{branch!r} selects {len(found)} branches")
        one = found[0][0]
        df = self.lazyarrays({"/".join(one.path): interpretation or found[0][1]}, entrystart, entrystop)
        return flatten.concatenate(df, one.name) if flat else df

    def arrays(self, branches=None, outputtype=dict, entrystart=None, entrystop=None, flat: bool | None = False, recursive: bool | str = True, namedecode=None, blocking: bool = True):
        """Collects the selected columns in entry order into outputtype. blocking=False: gives a function that waits for them.

        dict (or a subclass), list, tuple, a named tuple class, "pandas",
        "arrow", or any callable of the columns. flat=None drops list columns.
        """
        if not blocking:
            pool = ThreadPoolExecutor(1)
            waits = pool.submit(self.arrays, branches, outputtype, entrystart, entrystop, flat, recursive, namedecode)
            pool.shutdown(wait=False)
            return waits.result
        df = self.lazyarrays(branches, entrystart, entrystop, recursive, namedecode)
        df = flatten.drop_jagged(df) if flat is None else df
        if outputtype in (DataFrame, "spark"):
            return flatten.flatten(df, entry=self.entry) if flat else df
        return self._contain(df.orderBy(self.entry).toArrow(), outputtype, bool(flat))

    def _contain(self, got: pa.Table, outputtype, flat: bool):
        if outputtype == "arrow":
            return got.drop_columns([self.entry])
        if outputtype == "pandas":
            return got.to_pandas().set_index(self.entry)
        cols = {n: got[n].combine_chunks() for n in got.column_names if n != self.entry}
        cols = {n: (c.flatten() if flat and pa.types.is_list(c.type) else c) for n, c in cols.items()}
        if isinstance(outputtype, type) and issubclass(outputtype, dict):
            return outputtype(cols)
        if outputtype in (list, tuple):
            return outputtype(cols.values())
        return outputtype(*cols.values())

    def pandas_df(self, branches=None, entrystart=None, entrystop=None, flat: bool = True, flatname: Callable = flatten.flatname):
        """pandas with index entry, or (entry, subentry) if there are list columns and flat holds."""
        df = self.lazyarrays(branches, entrystart, entrystop)
        df = flatten.flatten(df, entry=self.entry, name=flatname) if flat else flatten.explode_structs(df, flatname)
        index = [c for c in (self.entry, "subentry") if c in df.columns]
        return df.orderBy(*index).toPandas().set_index(index)

    def chunks(self) -> list[steps.Chunk]:
        return self._chunks or []

    def clusters(self, branches=None, entrystart=None, entrystop=None, strict: bool = False) -> list[tuple[int, int]]:
        a, b = entries.entry_range(self.numentries, entrystart, entrystop)
        return steps.clusters(self.chunks(), self.matches(branches), a, b, strict)

    def mempartitions(self, numbytes, branches=None, entrystart=None, entrystop=None) -> list[tuple[int, int]]:
        a, b = entries.entry_range(self.numentries, entrystart, entrystop)
        target = entries.memory_size(numbytes) if isinstance(numbytes, str) else int(numbytes)
        if target is None:
            raise ValueError(f"not a memory size: {numbytes!r}")
        step = steps.memory_step(self.chunks(), self.matches(branches), target, a, b)
        return steps.equal(step, a, b) if step else []

    def iterate(self, branches=None, entrysteps=float("inf"), outputtype=dict, reportentries: bool = False, entrystart=None, entrystop=None, flat: bool = False) -> Iterator:
        """Pulls steps one after another to the driver, in order: one sorted pass over the data, a step in memory at a time.

        For work on all steps in parallel use map_steps.
        """
        ranges = steps.steps(entrysteps, self.numentries, entrystart, entrystop, self.chunks(), self.matches(branches))
        if not ranges:
            return
        low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
        df = self.lazyarrays(branches, low, high)
        rising = all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        for got, (a, b) in zip(self._pull(df, ranges) if rising else (self._one(df, a, b) for a, b in ranges), ranges, strict=False):
            out = self._contain(got, outputtype, flat)
            yield (a, b, out) if reportentries else out

    def _one(self, df: DataFrame, a: int, b: int) -> pa.Table:
        return df.where((F.col(self.entry) >= a) & (F.col(self.entry) < b)).orderBy(self.entry).toArrow()

    def _pull(self, df: DataFrame, ranges) -> Iterator[pa.Table]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, at = to_arrow_schema(df.schema), [], 0
        it = df.orderBy(self.entry).toLocalIterator(prefetchPartitions=True)
        make = lambda rs: pa.Table.from_pylist([r.asDict(recursive=True) for r in rs], schema=schema)
        for r in it:
            n = r[self.entry]
            while n >= ranges[at][1]:
                yield make(rows)
                rows, at = [], at + 1
            if n >= ranges[at][0]:
                rows.append(r)
        while at < len(ranges):
            yield make(rows)
            rows, at = [], at + 1

    def map_steps(self, fn: Callable, schema: str, step: int, branches=None) -> DataFrame:
        """fn(pandas) on every equal step, in parallel; a step is one group of at most step rows."""
        entry = self.entry
        df = self.lazyarrays(branches).withColumn("step_no", steps.step_of(entry, step))
        return df.groupBy("step_no").applyInPandas(lambda p: fn(p.drop(columns="step_no").sort_values(entry)), schema)


def open_table(spark: SparkSession, paths, name: str = "tree") -> Table:
    """Parquet files as one table, with global entry numbers in the order of the paths."""
    return Table(entries.read_all(spark, paths), name)


def row_group_chunks(paths: list[str]) -> list[steps.Chunk]:
    """Chunks of local Parquet files laid end to end, from their footers alone."""
    import pyarrow.parquet as pq

    out, at = [], 0
    for p in paths:
        meta = pq.ParquetFile(p).metadata
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            for c in range(rg.num_columns):
                col = rg.column(c)
                out.append(steps.Chunk(col.path_in_schema.split(".")[0], at, at + rg.num_rows, col.total_uncompressed_size, col.total_compressed_size, col.num_values))
            at += rg.num_rows
    return out


def chunk_stats(spark: SparkSession, chunks: list[steps.Chunk] | DataFrame) -> DataFrame:
    """Per branch: chunks, rows, items, bytes and their ratio (null without bytes). chunks: a table of them stays with the executors."""
    df = chunks
    if not isinstance(chunks, DataFrame):
        rows = [(c.branch, c.start, c.stop, c.uncompressed, c.compressed, c.items) for c in chunks]
        df = spark.createDataFrame(rows, "branch string, start bigint, stop bigint, uncompressed bigint, compressed bigint, items bigint")
    return df.groupBy("branch").agg(
        F.count("*").alias("numbaskets"), F.sum(F.col("stop") - F.col("start")).alias("numentries"), F.sum("items").alias("numitems"),
        F.sum("uncompressed").alias("uncompressedbytes"), F.sum("compressed").alias("compressedbytes"),
        F.try_divide(F.sum("uncompressed"), F.sum("compressed")).alias("compressionratio"),
    )
