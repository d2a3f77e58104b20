"""The Spark data source "eventfile": reads and writes trees, a task for each entry range or output file.

Options: path (a file, a folder, a glob, or several split by commas; any store
that Arrow's file systems know), transport ("file", "http" or "arrow"), user
and password (for HTTP), tree, branches
(names split by commas: Spark can't prune columns of a Python source itself),
entrystart, entrystop, step (entries a task, or a size as "64 MB", of more than
TASKS steps several a task; clusters that together have about 64 MB by
default), compression, level, rows,
compressions (of single columns, as "x:zstd,y:lz4"; "x:" for none), shapes (of
lists of fixed length, as "a:3,b:2x3").
"""

from __future__ import annotations

import glob as globbing
import math
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from quarry.operators import entries, steps
from quarry.sources.reader import File
from quarry.sources.writer import FileWriter

TARGET = "64 MB"
#: Tasks of a read, from which on neighbouring steps of a file share one: each task reads a file's lists of chunks.
TASKS = 256
#: Files that the driver opens at once to plan.
OPENERS = 32
#: Bytes of a written file that stay in memory; rows a chunk.
SPOOL, ROWS = 64 << 20, 100_000


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    offset: int
    #: Entries that are read at once.
    piece: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _listed(store: fs.FileSystem, root: str) -> list[str]:
    """The data files of a folder, by name."""
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".root") and not f.base_name.startswith("."))


def _files(options) -> list[str]:
    out = []
    for p in options["path"].split(","):
        if p.startswith(("http://", "https://")) or options.get("transport") == "http" or globbing.has_magic(p):
            out += entries.expand(p)
            continue
        store, root = _store(p)
        if store.get_file_info(root).type == fs.FileType.Directory:
            own = _listed(store, root)
            scheme = f"{p.split('://', 1)[0]}://" if "://" in p else ""
            out += [f"{scheme}{x}" for x in own] if scheme in ("", "file://") else [f"{p.rstrip('/')}/{x.rsplit('/', 1)[-1]}" for x in own]
            if not own:
                raise TypeError(f"no files in {p!r}")
        else:
            out += entries.expand(p)
    return out


def _opened(options, path: str) -> File:
    auth = (options["user"], options.get("password", "")) if options.get("user") else None
    return File(path, transport=options.get("transport"), auth=auth)


def _pairs(text: str) -> list[tuple[str, str]]:
    """("x", "zstd"), ("y", "") of "x:zstd,y:"."""
    return [tuple(x.strip().rsplit(":", 1)) for x in text.split(",") if x.strip()]


def _merge(pairs: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """Neighbouring clusters joined up to about rows entries."""
    out: list[list[int]] = []
    for a, b in pairs:
        if out and out[-1][1] == a and b - out[-1][0] <= rows:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.spark_schema = dict(options), schema
        self.tree, self.names = options.get("tree", "tree"), [f.name for f in schema.fields if f.name != "entry"]

    def partitions(self):
        out, own, at = [], [], 0
        o = self.options
        bound = lambda k: int(o[k]) if k in o else None
        step = o.get("step")
        exact = not (step or "1").isdigit()

        def survey(path):
            """Entries, chunks and bytes, from the tree's own lists; only a step in bytes needs every chunk's head."""
            with _opened(o, path) as f:
                if self.tree not in f:
                    return None
                t = f.tree(self.tree)
                chunks = t.chunks(self.names) if exact else [c for n in self.names for c in t.branch(n).planned()] if not step else []
                return path, t.numentries, chunks, sum(t.branch(n).total for n in self.names)

        with ThreadPoolExecutor(OPENERS) as pool:
            files = [x for x in pool.map(survey, _files(o)) if x]
        total = sum(n for _, n, _, _ in files)
        first, last = entries.entry_range(total, bound("entrystart"), bound("entrystop"))
        for path, n, chunks, size in files:
            a, b = max(0, first - at), min(n, last - at)
            if a < b and step:
                rows = self._rows(step, chunks, a, b) or b - a
                own.append((path, a, b, at, rows, max(1, n * entries.memory_size(TARGET) // max(1, size))))
            elif a < b:
                rows = steps.memory_step(chunks, self.names, entries.memory_size(TARGET), a, b) if self.names else b - a
                ranges = _merge(steps.steps(None, n, a, b, chunks, self.names), rows) if self.names and chunks else [(a, b)]
                out += [Range(path, x, y, at, y - x) for x, y in ranges or [(a, b)]]
            at += n
        share = math.ceil(sum(len(range(a, b, rows)) for _, a, b, _, rows, _ in own) / TASKS)
        for path, a, b, at, rows, many in own:
            out += [Range(path, x, y, at, rows * max(1, many // rows)) for x, y in steps.equal(rows * share, a, b)]
        return out or [Range("", 0, 0, 0, 0)]

    def _rows(self, step: str, chunks, a: int, b: int) -> int | None:
        """Entries of a step; None of one in bytes where there are none."""
        if step.isdigit():
            return int(step)
        size = entries.memory_size(step)
        if size is None:
            raise ValueError(f"not a memory size: {step!r}")
        return steps.memory_step(chunks, self.names, size, a, b)

    def read(self, partition):
        if not partition.path:
            return
        schema = to_arrow_schema(self.spark_schema)
        with _opened(self.options, partition.path) as f:
            t = f.tree(self.tree)
            for start, stop in steps.equal(partition.piece, partition.start, partition.stop):
                got, cols = t.read(self.names, start, stop), []
                for field in schema:
                    if field.name == "entry":
                        cols.append(pa.array(np.arange(start + partition.offset, stop + partition.offset, dtype=np.int64)))
                    else:
                        cols.append(got[field.name].cast(field.type))
                yield from pa.table(cols, schema=schema).combine_chunks().to_batches(max_chunksize=50_000)


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    """Every task writes a file of its own to a folder beside the data, on the same store; commit moves them in, then old ones go.

    A file is put together in the task's memory or temporary folder first, as
    its head is written last and stores don't seek.
    """

    def __init__(self, options, schema, overwrite):
        self.options, self.schema, self.folder = dict(options), to_arrow_schema(schema), options["path"]
        self.job = uuid.uuid4().hex
        store, root = _store(self.folder)
        self.old = _listed(store, root)
        if self.old and not overwrite:
            raise FileExistsError(f"{self.folder} exists; files can't be updated in place")
        store.create_dir(f"{root}/_temporary-{self.job}", recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = _store(self.folder)
        name = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        o = self.options
        with tempfile.SpooledTemporaryFile(SPOOL) as held:
            with FileWriter(held, "create", o.get("compression", "zlib") or None, int(o.get("level", 1))) as f:
                shapes = {k: tuple(int(n) for n in v.split("x")) for k, v in _pairs(o.get("shapes", ""))}
                t = f.tree(o.get("tree", "tree"), self.schema, o.get("title", ""), shapes, {k: v or None for k, v in _pairs(o.get("compressions", ""))}, o.get("split", "true") == "true")
                rows = int(o.get("rows", ROWS))
                for batch in iterator:
                    for at in range(0, batch.num_rows, rows):
                        t.extend(pa.Table.from_batches([batch.slice(at, rows)]))
                t.close()
            held.seek(0)
            with store.open_output_stream(name) as out:
                while part := held.read(8 << 20):
                    out.write(part)
        return Written(f"{name}|{TaskContext.get().partitionId():05d}")

    def commit(self, messages):
        store, root = _store(self.folder)
        for m in filter(None, messages):
            name, part = m.path.split("|")
            store.move(name, f"{root}/part-{part}{f'-{self.job}' if self.old else ''}.root")
        for p in self.old:
            store.delete_file(p)
        store.delete_dir(f"{root}/_temporary-{self.job}")

    def abort(self, messages):
        store, root = _store(self.folder)
        store.delete_dir(f"{root}/_temporary-{self.job}")


class EventFile(DataSource):
    @classmethod
    def name(cls):
        return "eventfile"

    def schema(self):
        """From the first file that has the tree; an entry column comes first."""
        tree = self.options.get("tree", "tree")
        for path in _files(self.options):
            with _opened(self.options, path) as f:
                if tree in f:
                    t = f.tree(tree)
                    names = [n.strip() for n in self.options["branches"].split(",")] if self.options.get("branches") else t.keys()
                    fields = [pa.field("entry", pa.int64()), *[t.schema().field(n) for n in names]]
                    return from_arrow_schema(pa.schema(fields))
        raise ValueError(f"no file has a tree {tree!r}")

    def reader(self, schema):
        return Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return Writer(self.options, schema, overwrite)


_MEMBERS = pa.schema([("file", pa.string()), ("class", pa.string()), ("version", pa.int64()), ("place", pa.int64()), ("member", pa.string()), ("type", pa.string())])


def register(spark) -> None:
    spark.dataSource.register(EventFile)


def baskets(spark, paths, tree: str = "tree"):
    """file, branch, basket, entry_start, entry_stop, uncompressed, compressed, items of all stored chunks: one row a chunk, read by the executors."""
    files = entries.expand(paths)
    schema = "file string, branch string, basket int, entry_start bigint, entry_stop bigint, uncompressed bigint, compressed bigint, items bigint"
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with File(p) as f:
                    t = f.tree(tree)
                    rows = [(p, n, i, c.start, c.stop, c.uncompressed, c.compressed, c.items) for n in t.keys() for i, c in enumerate(t.chunks([n]))]
                yield pa.RecordBatch.from_pylist([dict(zip(to.names, r, strict=True)) for r in rows], schema=to)

    return spark.createDataFrame([(p,) for p in files], "file string").repartition(len(files)).mapInArrow(run, schema)


def classes(spark, paths):
    """The members of the classes that files describe: file, class, version, place, member, type."""

    def members(batches):
        for b in batches:
            rows = []
            for p in b["file"].to_pylist():
                with File(p) as f:
                    rows += [(p, c.name, c.version, i, m.name, m.type) for own in f.classes.own.values() for c in own.values() for i, m in enumerate(c.members)]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "class", "version", "place", "member", "type"), r, strict=True)) for r in rows], schema=_MEMBERS)

    files = entries.expand(paths)
    own = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, len(files)))
    return own.mapInArrow(members, from_arrow_schema(_MEMBERS))


def catalog(spark, paths):
    """path, name, cycle, class_name, title, nbytes of all keys of files: one row a key, read by the executors."""
    df = spark.createDataFrame([(p,) for p in entries.expand(paths)], "file string").repartition(max(1, len(entries.expand(paths))))

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                with File(p) as f:
                    rows += [{"file": p, "path": k.path, "name": k.name, "cycle": k.cycle, "class_name": k.class_name, "title": k.title, "nbytes": k.nbytes} for k in f.keys]
            yield pa.RecordBatch.from_pylist(rows, schema=to)

    schema = "file string, path string, name string, cycle int, class_name string, title string, nbytes bigint"
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)
