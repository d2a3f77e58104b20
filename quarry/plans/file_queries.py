"""Queries over files that they write: Parquet folders and the binary format. And their SQL."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import bytes as stored
from quarry.functions import nested, vectors
from quarry.operators import entries, flatten, hist, selectors, steps
from quarry.plans.scratch import folder
from quarry.plans.table import Table, chunk_stats, row_group_chunks
from quarry.sources import datasource
from quarry.sources.elements import Quantised, Record, parse
from quarry.sources.reader import ELEMENTS, File, iterate, numentries
from quarry.sources.writer import FileWriter


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parted(spark: SparkSession, d: str) -> str:
    """orders as a folder of four part files, ascending by key."""
    path = folder(spark, "orders parts")
    _read(spark, d, "orders").select("o_orderkey", "o_custkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return path


def _many(spark: SparkSession, d: str) -> list[str]:
    """Ten folders with names of blanks and signs; every other one has x, the rest y."""
    own, root = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey"), folder(spark, "many")
    out = []
    for i in range(10):
        part = own.where(F.col("k") % 10 == i).withColumnRenamed("s_nationkey", "x" if i % 2 else "y")
        out.append(f"{root}/part {i}+%41.parquet")
        part.coalesce(1).sortWithinPartitions("k").write.parquet(out[-1])
    return out


def _eventfile(spark: SparkSession, df: DataFrame, label: str, **options) -> DataFrame:
    datasource.register(spark)
    path = folder(spark, label)
    df.write.format("eventfile").options(**options).mode("append").save(path)
    return spark.read.format("eventfile").load(path)


def _written(table: pa.Table, rows: int, compression: str | None = None, name: str = "tree") -> bytes:
    """A file of one tree with so many rows a chunk."""
    out = io.BytesIO()
    with FileWriter(out, compression=compression) as f:
        t = f.tree(name, table.schema)
        for at in range(0, table.num_rows, rows):
            t.extend(table.slice(at, rows))
        t.close()
    return out.getvalue()


#: Chunks of a column in each of the files that _chunks() makes of a table.
CHUNKS = 256
_HEADS = "branch string, start bigint, stop bigint, uncompressed bigint, compressed bigint, items bigint, total bigint"


def _chunks(spark: SparkSession, own: DataFrame, key: str, rows: int) -> DataFrame:
    """A row for each stored chunk of numbers sorted by key, so many rows a chunk, not compressed: its head, and the sum of whole numbers.

    The sorted rows are numbered by their place in files; executors write each
    CHUNKS * rows of them as a file, in memory, and read its chunks.
    """
    path = folder(spark, "sorted")
    own.orderBy(key).write.parquet(path)
    numbered = entries.read_with_entry(spark, path, "chunks entry").withColumn("chunks file", F.expr(f"div(`chunks entry`, {CHUNKS * rows})"))

    to = to_arrow_schema(StructType.fromDDL(_HEADS))

    def heads(table: pa.Table) -> pa.Table:
        at = table["chunks file"][0].as_py() * CHUNKS * rows
        table = table.sort_by("chunks entry").drop_columns(["chunks entry", "chunks file"])
        with File(_written(table, rows)) as f:
            t = f.tree("tree")
            total = lambda n, i: int(np.sum(t.basket(n, i).to_numpy())) if pa.types.is_integer(t.schema().field(n).type) else None
            out = [(n, at + c.start, at + c.stop, c.uncompressed, c.compressed, c.items, total(n, i)) for n in t.keys() for i, c in enumerate(t.chunks([n]))]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)

    return numbered.groupBy("chunks file").applyInArrow(heads, _HEADS)


def entry_folder(spark, d):
    return entries.read_with_entry(spark, _parted(spark, d)).select("entry", "o_orderkey")


def entry_folder_slice(spark, d):
    return entries.slice_entries(entries.read_with_entry(spark, _parted(spark, d)), 10, 200).select("entry", "o_orderkey")


def numentries_odd_names(spark, d):
    counts = entries.numentries(spark, _many(spark, d), total=False)
    return spark.createDataFrame([(i, n) for i, n in enumerate(counts.values())], "file bigint, n bigint")


def union_many(spark, d):
    """Ten files of two schemas as one: entries run on, columns go by name."""
    return entries.read_all(spark, _many(spark, d)).select("entry", "k", "x", "y")


def skim(spark, d):
    """A skim saved as pointers, joined to its table again."""
    path, table = folder(spark, "skim"), f"{d}/orders.parquet"
    cut = entries.read_with_entry(spark, table).where("o_totalprice > 200000").withColumn("half", F.col("o_totalprice") / 2)
    entries.save_skim(cut, path, derived=["half"])
    return entries.open_skim(spark, path, [table]).select("o_orderkey", "half")


def chunk_sums(spark, d):
    """Sums over the chunks of a table's columns, from the heads of its stored chunks: three columns of 8 bytes, 500 rows a chunk, not compressed."""
    return chunk_stats(spark, _chunks(spark, _read(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 500))


def basket_ranges(spark, d):
    """Every chunk of a column, with its entries and bytes."""
    own = _chunks(spark, _read(spark, d, "customer").select("c_custkey"), "c_custkey", 64)
    return own.select(F.expr("div(start, 64)").alias("basket"), F.col("start").alias("entry_start"), F.col("stop").alias("entry_stop"), F.col("uncompressed").alias("bytes"), "total")


def basket_table(spark, d):
    """The chunks of written files as a table, read by the executors: rows and elements of a list column."""
    datasource.register(spark)
    path = folder(spark, "baskets")
    _lists(spark, d).select("quantity").write.format("eventfile").mode("append").save(path)
    own = datasource.baskets(spark, datasource._files({"path": path})).where("branch = 'quantity'")
    return own.agg(F.sum(F.col("entry_stop") - F.col("entry_start")).alias("n"), F.sum("items").alias("items"))


def clusters(spark, d):
    """Where the chunks of two columns, of 6 and of 4 rows, end together."""
    own = _read(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").toArrow()
    chunks = []
    for name, rows in (("n_nationkey", 6), ("n_regionkey", 4)):
        with File(_written(own.select([name]), rows)) as f:
            chunks += f.tree("tree").chunks()
    return spark.createDataFrame(steps.clusters(chunks, own.column_names, 0, own.num_rows), "low bigint, high bigint")


def mempartitions(spark, d):
    """Steps of about 4000 bytes over two columns of 8 bytes each."""
    own = _chunks(spark, _read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 100)
    table = Table(spark.createDataFrame([], "entry bigint, c_custkey bigint, c_acctbal double"), chunks=[steps.Chunk(*r) for r in own.drop("total").collect()])
    table._n = max((c.stop for c in table.chunks()), default=0)
    return spark.createDataFrame(table.mempartitions(4000), "low bigint, high bigint")


def row_groups(spark, d):
    """The same on a Parquet table: its row groups hold all rows once."""
    import glob
    import os

    path = f"{d}/orders.parquet"
    files = [path] if os.path.isfile(path) else sorted(glob.glob(f"{path}/*.parquet"))
    rows = [(c.branch, c.start, c.stop) for c in row_group_chunks(files)]
    df = spark.createDataFrame(rows, "branch string, low bigint, high bigint")
    return df.groupBy("branch").agg(F.sum(F.col("high") - F.col("low")).alias("n"), F.max("high").alias("high"))


def iterate_files(spark, d):
    """Steps of 7 entries over two files in memory, one after the other, with what they report."""
    root = folder(spark, "iterate").removeprefix("file://")
    import os

    os.makedirs(root)
    names = []
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        names.append(f"{root}/{name}.root")
        with open(names[-1], "wb") as f:
            f.write(_written(_read(spark, d, name).select(F.col(key).cast("long").alias("key")).orderBy("key").toArrow(), 5))
    rows = [(os.path.basename(p).split(".")[0], a, b, int(np.sum(x["key"].to_numpy()))) for p, a, b, x in iterate(names, "tree", entrysteps=7, reportpath=True, reportentries=True)]
    return spark.createDataFrame(rows, "file string, low bigint, high bigint, total bigint")


def iterate_pandas(spark, d):
    """pandas frames by clusters, with the entry as index."""
    own = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key")).orderBy("key").toArrow()
    root = folder(spark, "iterate").removeprefix("file://")
    import os

    os.makedirs(root)
    with open(f"{root}/a.root", "wb") as f:
        f.write(_written(own, 10))
    rows = [(int(p.index[0]), int(p["key"].sum())) for p in iterate(f"{root}/a.root", "tree", pandas=True)]
    return spark.createDataFrame(rows, "low bigint, total bigint")


def numentries_files(spark, d):
    """Rows from the heads of files alone; a file without the tree counts 0."""
    root = folder(spark, "count").removeprefix("file://")
    import os

    os.makedirs(root)
    own = _read(spark, d, "nation").select("n_nationkey").toArrow()
    for name, tree in (("a", "tree"), ("b", "other"), ("c", "tree")):
        with open(f"{root}/{name}.root", "wb") as f:
            f.write(_written(own, 10, name=tree))
    counts = numentries(f"{root}/*.root", "tree", total=False)
    return spark.createDataFrame([(os.path.basename(p)[0], n) for p, n in counts.items()], "file string, n bigint")


def catalog(spark, d):
    """All keys of files as a table: cycles, a tree, a histogram."""
    root = folder(spark, "catalog").removeprefix("file://")
    import os

    os.makedirs(root)
    axis = hist.Axis(4, 0.0, 60.0)
    filled = hist.Histogram.collect(hist.fill(_read(spark, d, "lineitem"), "l_quantity", axis), axis)
    with FileWriter(f"{root}/a.root") as f:
        f.string("hello", "first")
        f.string("hello", "second")
        f.update({"quantity": filled, "gone": "x"})
        f.remove("gone")
        t = f.tree("nations", pa.schema([("n", pa.int64())]))
        t.extend(pa.table({"n": [1, 2, 3]}))
        t.close()
    return datasource.catalog(spark, [f"{root}/a.root"]).select("name", F.col("cycle").cast("long").alias("cycle"), "class_name")


def string_cycles(spark, d):
    """Strings by name and cycle, from a file in memory; without a cycle the last."""
    out = io.BytesIO()
    with FileWriter(out) as f:
        for r in _read(spark, d, "region").orderBy("r_regionkey").collect():
            f.string("region", r.r_name)
    with File(out.getvalue()) as f:
        return spark.createDataFrame([(n, f.string(n)) for n in ("region", "region;1", "region;3")], "name string, said string")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    own = entries.read_with_entry(spark, f"{d}/lineitem.parquet")
    return own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("entry", "l_quantity"))).alias("it")).select("l_orderkey", F.col("it.l_quantity").alias("quantity"))


def file_jagged(spark, d):
    """Lists written with their counter column and read again."""
    back = _eventfile(spark, _lists(spark, d), "lists", compression="lz4")
    return back.select("l_orderkey", F.col("nquantity").cast("long").alias("n"), nested.total("quantity").alias("total"), nested.pick("quantity", -1).alias("last"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.struct(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance")).alias("c"))


def object_split(spark, d):
    """Objects written a branch a member, by a class that the file describes."""
    back = _eventfile(spark, _customers(spark, d), "split", compression="zstd")
    return back.select(F.col("`c.key`").alias("key"), F.col("`c.name`").alias("name"), F.col("`c.balance`").alias("balance"))


def object_whole(spark, d):
    """Objects written whole, an entry each."""
    back = _eventfile(spark, _customers(spark, d), "whole", split="false")
    return back.select("c.key", "c.name", "c.balance")


def object_flat(spark, d):
    """Objects of a fixed width."""
    own = _read(spark, d, "supplier").select(F.struct(F.col("s_suppkey").cast("int").alias("key"), F.col("s_acctbal").cast("double").alias("balance")).alias("s"))
    return _eventfile(spark, own, "flat", split="false").select(F.col("s.key").cast("long").alias("key"), "s.balance")


def object_lists(spark, d):
    """Lists of objects, split: a branch that counts them and one for each member."""
    lines = F.struct(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_linenumber").cast("int").alias("line"))
    own = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey")).agg(F.collect_list(lines).alias("it"))
    back = _eventfile(spark, own, "objects", compression="lz4")
    return back.select("l_orderkey", F.col("it").cast("long").alias("n"), nested.total(F.col("`it.quantity`")).alias("quantity"), nested.total(F.col("`it.line`")).cast("long").alias("lines"))


def object_classes(spark, d):
    """The members of the class that a file describes."""
    path = folder(spark, "classes")
    datasource.register(spark)
    _customers(spark, d).coalesce(1).write.format("eventfile").mode("append").save(path)
    return datasource.classes(spark, f"{path.removeprefix('file://')}/*.root").select("class", "version", "place", "member", "type")


def file_fixed(spark, d):
    """Lists of fixed length as two-dimensional arrays."""
    own = _read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("m"))
    back = _eventfile(spark, own, "fixed", shapes="m:8x8")
    return back.select("vec_id", F.col("m")[0][0].cast("double").alias("first"), F.col("m")[7][7].cast("double").alias("last"))


def _codec(name: str, **options):
    def run(spark, d):
        own = _read(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") > 25).alias("big"))
        return _eventfile(spark, own, name, compression=name, **options).select("p_partkey", "p_name", "p_retailprice", "big")

    run.__name__ = f"file_{name}"
    run.__doc__ = f"A table compressed by {name}, written and read again."
    return run


def file_columns_codecs(spark, d):
    """A codec for each column, and the ones that the file says."""
    own = _read(spark, d, "region").orderBy("r_regionkey").toArrow()
    out, how = io.BytesIO(), {"r_regionkey": "zstd", "r_name": "lzma"}
    with FileWriter(out, compression="zlib") as f:
        t = f.tree("tree", own.schema, compressions=how)
        t.extend(own)
        t.close()
    with File(out.getvalue()) as f:
        return spark.createDataFrame([(n, f.tree("tree").compression(n)[0]) for n in how], "branch string, codec string")


def file_range(spark, d):
    """An entry range over many files, by options of the source."""
    datasource.register(spark)
    path = folder(spark, "range")
    _read(spark, d, "orders").select("o_orderkey").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").write.format("eventfile").option("rows", 50).mode("append").save(path)
    return spark.read.format("eventfile").options(entrystart="40", entrystop="-40", step="33").load(path).select("entry", "o_orderkey")


def file_histogram(spark, d):
    """A histogram written to a file and read from it."""
    axis, out = hist.Axis(8, 0.0, 40.0), io.BytesIO()
    filled = hist.Histogram.collect(hist.fill(_read(spark, d, "lineitem"), "l_quantity", axis), axis, title="quantity")
    with FileWriter(out) as f:
        f.hist("h", filled)
    with File(out.getvalue()) as f:
        return f.histogram("h").to_df(spark).select("bin", "sumw", "sumw2")


def file_labels(spark, d):
    """Bins with labels, through a file."""
    names = ("A", "N", "R")
    axis, out = hist.Axis(3, 0.0, 3.0, labels=names), io.BytesIO()
    at = F.array_position(F.array(*map(F.lit, names)), F.col("l_returnflag")).cast("double") - 0.5
    with FileWriter(out) as f:
        f.hist("flags", hist.Histogram.collect(hist.fill(_read(spark, d, "lineitem"), at, axis), axis))
    with File(out.getvalue()) as f:
        h = f.histogram("flags")
        return spark.createDataFrame(list(zip(h.axis.labels, map(float, h.values), strict=True)), "flag string, n double")


def file_path_lookup(spark, d):
    """A branch by a path through its tree."""
    with File(_written(_read(spark, d, "region").select("r_regionkey", "r_name").toArrow(), 10)) as f:
        rows = [(p, p in f) for p in ("tree", "tree/r_name", "tree/none", "none")]
    return spark.createDataFrame(rows, "path string, there boolean")


def bytes_reinterpret(spark, d):
    """Doubles whose bits are read as whole numbers, and back.

    Numbers below zero have bits from above those of -0.0, the least of all,
    to those of -inf; NaNs with a sign are beyond.
    """
    own = _read(spark, d, "customer").select("c_custkey", "c_acctbal", stored.reinterpret("c_acctbal", "f8", "i8").alias("bits"))
    return own.select("c_custkey", F.expr("bits > -9223372036854775807 - 1 AND bits <= -4503599627370496").alias("negative"), stored.reinterpret("bits", "i8", "f8").alias("value"))


def _four(x) -> F.Column:
    """The four bytes of a whole number, the highest first."""
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def bytes_raw(spark, d):
    own = _read(spark, d, "nation").select("n_nationkey", stored.raw(_four(F.col("n_nationkey") * 1000)).alias("raw"))
    return own.select("n_nationkey", F.col("raw")[2].cast("long").alias("third"), F.col("raw")[3].cast("long").alias("fourth"))


def bytes_quantised(spark, d):
    """Whole numbers of 16 bits as doubles between -1 and 3."""
    own = _read(spark, d, "part").select("p_partkey", _four(F.col("p_partkey") % 65536).alias("data"))
    return stored.decode(own, "data", Quantised(-1.0, 3.0, 16), "value").select("p_partkey", "value")


def bytes_quantised_single(spark, d):
    """The same as single-precision floats, in 8 bits."""
    own = _read(spark, d, "part").select("p_partkey", _four(F.col("p_partkey") % 256).alias("data"))
    return stored.decode(own, "data", Quantised(0.0, 4.0, 8, wide=False), "value").select("p_partkey", F.col("value").cast("double").alias("value"))


def bytes_bits(spark, d):
    """Bit sets of 5 bits: a count and a byte a bit."""
    bits = F.concat(*[F.lpad(F.hex(F.expr(f"shiftright(p_size, {k}) & 1")), 2, "0") for k in range(5)])
    own = _read(spark, d, "part").select("p_partkey", F.unhex(F.concat(F.lit("00000005"), bits)).alias("data"))
    return stored.decode(own, "data", 5, "bits").select("p_partkey", F.size(F.filter("bits", lambda x: x)).cast("long").alias("ones"))


def bytes_record(spark, d):
    """Leaf lists: a whole number and two of two bytes side by side."""
    two = lambda c: F.lpad(F.hex(F.col(c)), 4, "0")
    own = _read(spark, d, "part").select(F.unhex(F.concat(F.lpad(F.hex("p_partkey"), 8, "0"), two("p_size"), F.lit("0007"))).alias("data"))
    got = stored.decode(own, "data", Record((("key", ">i4", ()), ("pair", ">i2", (2,)))), "r")
    return got.select(F.col("r.key").cast("long").alias("key"), F.col("r.pair")[0].cast("long").alias("size"), F.col("r.pair")[1].cast("long").alias("seven"))


def bytes_vectors(spark, d):
    """Vectors of vectors of whole numbers: a count before each."""
    four = lambda x: F.lpad(F.hex(x), 8, "0")
    inner = F.concat(four(F.lit(2)), four(F.col("n_nationkey")), four(F.col("n_regionkey")))
    own = _read(spark, d, "nation").select(F.unhex(F.concat(four(F.lit(3)), inner, four(F.lit(0)), inner)).alias("data"))
    got = stored.decode(own, "data", parse("vector<vector<int>>", ELEMENTS), "v")
    return got.select(F.size("v").cast("long").alias("n"), F.size(F.col("v")[1]).cast("long").alias("empty"), nested.total(nested.flatten_all("v")).cast("long").alias("total"))


def jagged_empty(spark, d):
    """Entries with empty lists vanish when lists become rows."""
    own = _lists(spark, d).select(F.col("l_orderkey").alias("entry"), F.filter("quantity", lambda q: q > 40).alias("quantity"))
    return flatten.flatten(own).select("entry", F.col("subentry").cast("long").alias("subentry"), "quantity")


def vector_delta(spark, d):
    """Distances of vectors in angle and pseudorapidity."""
    a = vectors.cartesian("l_quantity", "l_discount", "l_tax", F.lit(1e6))
    b = vectors.cartesian(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(1e6))
    own = _read(spark, d, "lineitem").where("l_quantity > 0").select("l_orderkey", vectors.delta_r(a, b).alias("r"), vectors.delta_phi(a, b).alias("phi"))
    return own.groupBy("l_orderkey").agg(F.round(F.max("r"), 6).alias("r"), F.round(F.min("phi"), 6).alias("phi"))


def select_numpy(spark, d):
    """Targets as NumPy types and arrays."""
    return selectors.select(_read(spark, d, "supplier"), {"s_suppkey": np.int32, "s_acctbal": np.zeros(1, np.int64)})


def select_twice(spark, d):
    """Overlapping patterns take a column once, names are decoded."""
    return selectors.select(_read(spark, d, "region"), ["r_*", "r_name"], namedecode=lambda n: n.removeprefix("r_"))


_PARTS = "SELECT p_partkey, p_name, p_retailprice, p_size > 25 AS big FROM part"
_NUMBERED = "(SELECT *, row_number() OVER () - 1 AS e FROM lineitem)"
_BIN = "CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 40 THEN 9 ELSE cast(floor(l_quantity / 5.0) AS BIGINT) + 1 END"
_FILE = "(k % 10)::BIGINT"
ORACLE_SQL = {
    "entry_folder": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS entry, o_orderkey FROM orders",
    "entry_folder_slice": "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS entry, o_orderkey FROM orders) WHERE entry >= 10 AND entry < 200",
    "numentries_odd_names": "SELECT f AS file, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = f) AS n FROM (SELECT unnest(range(10)) AS f)",
    "union_many": f"SELECT row_number() OVER (ORDER BY {_FILE}, k) - 1 AS entry, k, CASE WHEN k % 2 = 1 THEN n END AS x, CASE WHEN k % 2 = 0 THEN n END AS y FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)",
    "skim": "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 200000",
    "chunk_sums": "SELECT b AS branch, ((n + 499) // 500)::BIGINT AS numbaskets, n AS numentries, n AS numitems, 8 * n AS uncompressedbytes, 8 * n AS compressedbytes, 1.0::DOUBLE AS compressionratio FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['event_id', 'user_id', 'value']) AS b)",
    "basket_ranges": "SELECT e // 64 AS basket, min(e) AS entry_start, max(e) + 1 AS entry_stop, 8 * count(*) AS bytes, sum(c_custkey)::BIGINT AS total FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS e FROM customer) GROUP BY 1",
    "basket_table": "SELECT count(DISTINCT l_orderkey)::BIGINT AS n, count(*)::BIGINT AS items FROM lineitem",
    "clusters": "SELECT x AS low, least(x + 12, (SELECT count(*) FROM nation)) AS high FROM (SELECT unnest(range(0, (SELECT count(*) FROM nation), 12)) AS x)",
    "mempartitions": "SELECT x AS low, least(x + 250, (SELECT count(*) FROM customer)) AS high FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer), 250)) AS x)",
    "row_groups": "SELECT b AS branch, n, n AS high FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS b)",
    "iterate_files": "SELECT 'nation' AS file, min(e) AS low, max(e) + 1 AS high, sum(e)::BIGINT AS total FROM (SELECT n_nationkey::BIGINT AS e FROM nation) GROUP BY e // 7 UNION ALL SELECT 'region', 25, 30, sum(r_regionkey)::BIGINT FROM region",
    "iterate_pandas": "SELECT min(n_nationkey)::BIGINT AS low, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_nationkey // 10",
    "numentries_files": "SELECT f AS file, CASE WHEN f = 'b' THEN 0 ELSE (SELECT count(*) FROM nation) END AS n FROM (SELECT unnest(['a', 'b', 'c']) AS f)",
    "catalog": "SELECT * FROM (VALUES ('hello', 1::BIGINT, 'TObjString'), ('hello', 2, 'TObjString'), ('quantity', 1, 'TH1D'), ('nations', 1, 'TTree')) AS t(name, cycle, class_name)",
    "string_cycles": "SELECT CASE WHEN n = 0 THEN 'region' ELSE 'region;' || n END AS name, (SELECT r_name FROM region WHERE r_regionkey = CASE WHEN n = 0 THEN 4 ELSE n - 1 END) AS said FROM (SELECT unnest([0, 1, 3]) AS n)",
    "file_jagged": f"SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total, last(l_quantity ORDER BY e) AS last FROM {_NUMBERED} GROUP BY 1",
    "object_split": "SELECT c_custkey AS key, c_name AS name, c_acctbal::DOUBLE AS balance FROM customer",
    "object_whole": "SELECT c_custkey AS key, c_name AS name, c_acctbal::DOUBLE AS balance FROM customer",
    "object_flat": "SELECT s_suppkey AS key, s_acctbal::DOUBLE AS balance FROM supplier",
    "object_lists": "SELECT l_orderkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1",
    "object_classes": "SELECT * FROM (VALUES ('c', 1::BIGINT, 0::BIGINT, 'key', 'Long64_t'), ('c', 1, 1, 'name', 'TString'), ('c', 1, 2, 'balance', 'double')) t(class, version, place, member, type)",
    "file_fixed": "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings",
    "file_zlib": _PARTS, "file_lzma": _PARTS, "file_lz4": _PARTS, "file_zstd": _PARTS,
    "file_columns_codecs": "SELECT * FROM (VALUES ('r_regionkey', 'zstd'), ('r_name', 'lzma')) AS t(branch, codec)",
    "file_range": "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS entry, o_orderkey FROM orders) WHERE entry >= 40 AND entry < (SELECT count(*) FROM orders) - 40",
    "file_histogram": f"SELECT r.bin, coalesce(n, 0)::DOUBLE AS sumw, coalesce(n, 0)::DOUBLE AS sumw2 FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM lineitem GROUP BY 1) h ON r.bin = h.bin",
    "file_labels": "SELECT l_returnflag AS flag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1",
    "file_path_lookup": "SELECT * FROM (VALUES ('tree', true), ('tree/r_name', true), ('tree/none', false), ('none', false)) AS t(path, there)",
    "bytes_reinterpret": "SELECT c_custkey, c_acctbal < 0 AS negative, c_acctbal AS value FROM customer",
    "bytes_raw": "SELECT n_nationkey, ((n_nationkey * 1000) // 256 % 256)::BIGINT AS third, (n_nationkey * 1000 % 256)::BIGINT AS fourth FROM nation",
    "bytes_quantised": "SELECT p_partkey, (p_partkey % 65536) * (4.0::DOUBLE / 65536) - 1 AS value FROM part",
    "bytes_quantised_single": "SELECT p_partkey, (p_partkey % 256) * (4.0::DOUBLE / 256) AS value FROM part",
    "bytes_bits": "SELECT p_partkey, bit_count((p_size % 32)::INTEGER)::BIGINT AS ones FROM part",
    "bytes_record": "SELECT p_partkey AS key, p_size::BIGINT AS size, 7::BIGINT AS seven FROM part",
    "bytes_vectors": "SELECT 3::BIGINT AS n, 0::BIGINT AS empty, (2 * (n_nationkey + n_regionkey))::BIGINT AS total FROM nation",
    "jagged_empty": f"SELECT l_orderkey AS entry, row_number() OVER (PARTITION BY l_orderkey ORDER BY e) - 1 AS subentry, l_quantity AS quantity FROM {_NUMBERED} WHERE l_quantity > 40",
    "vector_delta": """SELECT l_orderkey, round(max(sqrt((eta - asinh(3 / sqrt(5::DOUBLE))) * (eta - asinh(3 / sqrt(5::DOUBLE))) + phi * phi)), 6) AS r, round(min(phi), 6) AS phi
        FROM (SELECT l_orderkey, asinh(l_tax / sqrt(l_quantity * l_quantity + l_discount * l_discount)) AS eta, atan2(l_discount, l_quantity) - atan2(2::DOUBLE, 1::DOUBLE) AS phi FROM lineitem WHERE l_quantity > 0) GROUP BY 1""",
    "select_numpy": "SELECT s_suppkey::INTEGER AS s_suppkey, cast(trunc(s_acctbal) AS BIGINT) AS s_acctbal FROM supplier",
    "select_twice": "SELECT r_regionkey AS regionkey, r_name AS name FROM region",
}
for _name in ("zlib", "lzma", "lz4", "zstd"):
    globals()[f"file_{_name}"] = _codec(_name)
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
