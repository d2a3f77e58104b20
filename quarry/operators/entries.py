"""Entry numbers, entry ranges, file sets and memory sizes."""

from __future__ import annotations

import glob as globbing
import os
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"": 0, "B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5, "EB": 6, "ZB": 7, "YB": 8, "K": 1, "M": 2, "G": 3, "T": 4}
_SIZE = re.compile(r"\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*([a-zA-Z]+)\s*")
#: Rows of a per-file table that may be broadcast; over it the join shuffles.
MOST_FILES = 200_000


def memory_size(text) -> int | None:
    """Bytes of "50 kB" and the like, in powers of 1024, whatever the case; None of anything else."""
    m = _SIZE.fullmatch(text) if isinstance(text, str) else None
    if not m or m[2].upper() not in _UNITS:
        return None
    return int(float(m[1]) * 1024 ** _UNITS[m[2].upper()])


def entry_range(n: int, start: int | None = None, stop: int | None = None) -> tuple[int, int]:
    """The half-open range within n entries: negative bounds count from the end, both are clamped; IndexError if reversed."""
    clamp = lambda x: min(max(x + n if x < 0 else x, 0), n)
    a, b = clamp(0 if start is None else start), clamp(n if stop is None else stop)
    if b < a:
        raise IndexError(f"stop {stop} is before start {start} among {n} entries")
    return a, b


def expand(paths: str | os.PathLike | Iterable) -> list[str]:
    """Files in order: local globs sorted, ``~`` expanded, URLs untouched, lists one after another. TypeError if none match."""
    if isinstance(paths, (str, os.PathLike)):
        text = os.fspath(paths)
        if "://" in text and not text.startswith("file://"):
            return [text]
        found = sorted(globbing.glob(os.path.expanduser(text.removeprefix("file://"))))
        if not found:
            raise TypeError(f"no such file: {text!r}")
        return found
    out = [p for x in paths for p in expand(x)]
    if not out:
        raise TypeError("no files")
    return out


def slice_entries(df: DataFrame, start: int | None = None, stop: int | None = None, entry: str = "entry", n: int | None = None) -> DataFrame:
    """Rows of an entry range. The rows are counted only where a bound is negative; bounds reach the scan as filters."""
    if (start or 0) < 0 or (stop or 0) < 0:
        n = df.count() if n is None else n
        start, stop = entry_range(n, start, stop)
    elif start is not None and stop is not None and (min(stop, n) if n is not None else stop) < (min(start, n) if n is not None else start):
        raise IndexError(f"stop {stop} is before start {start}")
    if start:
        df = df.where(F.col(entry) >= start)
    return df if stop is None else df.where(F.col(entry) < stop)


def _status(spark: SparkSession, path: str):
    """What Spark's file systems say of a path, or None if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(at) if store.exists(at) else None


def _bare(path: str) -> str:
    """A path without scheme and leading slashes, as keys of files."""
    found = re.match("[a-z][a-z0-9]*:/+", path)
    return path[found.end() :] if found else os.path.abspath(path).lstrip("/")


@dataclass(frozen=True)
class Part:
    """A data file: the path it was asked for by, its name as the scan says it, and its rows."""

    path: str
    name: str
    rows: int


def file_parts(spark: SparkSession, paths: list[str]) -> list[Part]:
    """The Parquet files under each path (a file or a folder, its files by name), in the order of paths, from one pass that reads no column.

    A missing path has none. Files without rows are left out. ValueError if
    the scan names a file that none of the paths holds.
    """
    there = [p for p in dict.fromkeys(paths) if _status(spark, p) is not None]
    got = {}
    if there:
        for r in spark.read.parquet(*there).groupBy(F.col("_metadata.file_path").alias("f")).count().collect():  # a row a file
            got[_bare(unquote(r.f))] = (r.f, r["count"])
    names, out = sorted(got), []
    for p in paths:
        key = _bare(p.rstrip("/"))
        inside = names[bisect_left(names, f"{key}/") : bisect_left(names, f"{key}0")]  # 0 comes after the slash
        out += [Part(p, *got[n]) for n in ([key] if key in got else []) + inside]
    lost = {n for n, _ in got.values()} - {x.name for x in out}
    if lost:
        raise ValueError(f"files of no path that was given: {sorted(lost)[:3]}")
    return out


def file_counts(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Rows under each path, in the order of paths. A missing path counts 0."""
    out = dict.fromkeys(paths, 0)
    for x in file_parts(spark, list(out)):
        out[x.path] += x.rows
    return out


def numentries(spark: SparkSession, paths, total: bool = True):
    """Row count of all files, or with total=False a dict of path -> count in order."""
    files = expand(paths)
    counts = file_counts(spark, files)
    return sum(counts[p] for p in files) if total else counts


def _one_file(spark: SparkSession, path: str, entry: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(F.col("_metadata.row_index").alias(entry), *[F.col(f"`{c}`") for c in df.columns])


def read_with_entry(spark: SparkSession, path: str, entry: str = "entry") -> DataFrame:
    """One Parquet table with the number of each row.

    Of a single file the reader gives it without a shuffle, and bounds on it
    reach the scan; the files of a folder follow each other by name.
    """
    status = _status(spark, path)
    if status is not None and status.isFile():
        return _one_file(spark, path, entry)
    return _laid_out(spark, [path], entry, None)


def read_all(spark: SparkSession, paths, entry: str = "entry", file: str | None = None) -> DataFrame:
    """The ordered union of Parquet files or folders with global entry numbers.

    Columns are merged by name, whatever the number of files; a file that
    lacks one has nulls. Each file's offset is the sum of the counts before it
    in the order of the paths (a path that comes twice counts twice); rows get
    offset + own row number in the scan, without a shuffle. file: a column
    with the path.
    """
    return _laid_out(spark, expand(paths), entry, file)


def _laid_out(spark: SparkSession, paths: list[str], entry: str, file: str | None) -> DataFrame:
    at, rows = 0, []
    for x in file_parts(spark, paths):
        rows.append((x.name, x.path, at))
        at += x.rows
    there = [p for p in dict.fromkeys(paths) if _status(spark, p) is not None]
    df = spark.read.option("mergeSchema", "true").parquet(*there)
    cols = [F.col(f"`{c}`") for c in df.columns]
    offsets = spark.createDataFrame(rows, "file_key string, file_path string, file_at bigint")
    offsets = F.broadcast(offsets) if len(rows) <= MOST_FILES else offsets
    keyed = df.select(F.col("_metadata.file_path").alias("of_file"), F.col("_metadata.row_index").alias("of_row"), F.struct(*cols).alias("of_columns"))
    joined = keyed.join(offsets, F.col("of_file") == F.col("file_key"))
    own = [F.col("of_columns").getField(c).alias(c) for c in df.columns]
    return joined.select((F.col("file_at") + F.col("of_row")).alias(entry), *own, *([F.col("file_path").alias(file)] if file else []))


def save_skim(df: DataFrame, path: str, entry: str = "entry", derived: Iterable[str] = ()) -> None:
    """Saves selected rows as pointers: their entry numbers, and the derived columns, nothing of the table itself."""
    df.select(entry, *derived).write.mode("errorifexists").parquet(path)


def open_skim(spark: SparkSession, path: str, paths, entry: str = "entry") -> DataFrame:
    """The rows of a table of files that a skim points to, with its derived columns, read when needed."""
    skim = spark.read.parquet(path)
    whole = read_all(spark, paths, entry)
    return whole.join(skim, entry)
