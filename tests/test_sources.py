"""The file format: round trips with every codec, fixed bytes, ranges, recovery of errors."""

import base64
import http.server
import io
import lzma
import os
import re
import threading
import urllib.error
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.operators.hist import Axis, Histogram, HistogramND, Profile, fill_nd
from quarry.plans.table import Table
from quarry.sources import codec, datasource
from quarry.sources.reader import File, numentries
from quarry.sources.remote import HttpFile
from quarry.sources.writer import FileWriter, write_table

RANGES = [(None, None), (1, None), (1, 2), (1, 10), (10, 11), (10, 20), (6, 12), (6, 13)]


def sample():
    n = [i % 5 for i in range(30)]
    cols = {"n": pa.array(n, pa.int32()), "b": pa.array([i % 2 == 0 for i in range(30)]), "str": pa.array([f"hey-{i}" * (1 + 60 * (i == 7)) for i in range(30)])}
    for k, t in (("i1", pa.int8()), ("i2", pa.int16()), ("i4", pa.int32()), ("i8", pa.int64()), ("f4", pa.float32()), ("f8", pa.float64())):
        cols[k] = pa.array(np.arange(30) - 15).cast(t)
        cols[f"a{k}"] = pa.array([[i - 14, i - 13, i - 12] for i in range(30)], pa.list_(t))
        if k != "i1":
            cols[f"A{k}"] = pa.array([[5 * (i // 5) - 15 + 2 * j for j in range(n[i])] for i in range(30)], pa.list_(t))
    return pa.table(cols), {f"a{k}": (3,) for k in ("i1", "i2", "i4", "i8", "f4", "f8")}


@pytest.mark.parametrize("kind", [None, "zlib", "lzma", "lz4", "zstd"])
def test_round_trip(tmp_path, kind):
    table, shapes = sample()
    path = tmp_path / "a.root"
    write_table(path, table, rows=7, compression=kind, shapes=shapes)
    with File(path) as f:
        t = f.tree("tree")
        assert t.numentries == 30 and set(table.column_names) <= set(t.keys())
        for a, b in RANGES:
            got = t.read(table.column_names, a or 0, b)
            want = table.slice(a or 0, (b or 30) - (a or 0))
            assert got.to_pydict() == want.to_pydict()
        assert [c.stop - c.start for c in t.chunks(["i8"])] == [7, 7, 7, 7, 2]
        assert t.read(["nAi4"])["nAi4"].to_pylist() == [len(x) for x in table["Ai4"].to_pylist()]
        with pytest.raises(KeyError):
            t.read(["none"])
    with pytest.raises(FileExistsError):
        write_table(path, table, shapes=shapes)
    with pytest.raises(ValueError):
        f.tree("tree").read(["n"])


def test_fixed_bytes(tmp_path):
    path = tmp_path / "a.root"
    with FileWriter(path, compression=None) as f:
        f.string("hello", "uno")
        f.string("hello", "dos")
    raw = path.read_bytes()
    assert raw[:4] == b"root" and int.from_bytes(raw[8:12], "big") == 100
    assert b"\x0aTObjString\x05hello\x18Collectable string class" in raw
    with File(raw) as f:
        assert [(k.name, k.cycle) for k in f.listing()] == [("hello", 1), ("hello", 2)]
        assert f.string("hello") == "dos" and f.string("hello;1") == "uno" and "hello;3" not in f
    with pytest.raises(ValueError):
        File(b"rock" + raw[4:])
    with pytest.raises(NotImplementedError):
        FileWriter(path, "update")


def test_histogram(tmp_path):
    values = np.array([0, 7, 0, 0, 0, 2.5, 1])
    h = Histogram(Axis(5, 1.0, 10.0, title="x"), values, values * 2, "h", "title")
    edges = Histogram(Axis.variable([0, 1, 10, 100, 1000, 10000]), values, values, "v")
    with FileWriter(tmp_path / "h.root") as f:
        f.hist("h", h)
        f.hist("v", edges)
    with File(tmp_path / "h.root") as f:
        got = f.histogram("h")
        assert (got.axis.n, got.axis.low, got.axis.high, got.title, got.axis.title) == (5, 1.0, 10.0, "title", "x")
        assert got.allvalues.tolist() == values.tolist() and got.allvariances.tolist() == (values * 2).tolist()
        assert f.histogram("v").edges.tolist() == [0, 1, 10, 100, 1000, 10000]


@pytest.mark.parametrize("kind", ["C", "S", "I", "F", "D"])
def test_histograms_of_many_axes(tmp_path, kind):
    axes = (Axis(3, 0.0, 3.0, title="x"), Axis.variable([0, 1, 10], title="y", labels=("low", "high")), Axis(4, -1.0, 1.0))
    with FileWriter(tmp_path / "h.root") as f:
        for n in (1, 2, 3):
            values = np.arange(np.prod([a.n + 2 for a in axes[:n]])).reshape([a.n + 2 for a in axes[:n]]) % 100.0
            h = HistogramND(axes[:n], values, values * 2, title="t") if n > 1 else Histogram(axes[1], np.array([1.0, 2, 3, 4]), np.ones(4))
            f.hist(f"h{n}", h, kind)
        p = [np.random.default_rng(i).random([a.n + 2 for a in axes[:2]]) for i in range(4)]
        f.update({"p1": Profile(axes[:1], *[x[:, 0] for x in p]), "p2": Profile(axes[:2], *p), "note": "text"})
    with File(tmp_path / "h.root") as f:
        assert [k.class_name for k in f.listing()] == [f"TH1{kind}", f"TH2{kind}", f"TH3{kind}", "TProfile", "TProfile2D", "TObjString"]
        one = f.histogram("h1")
        assert one.axis == axes[1] and one.allvalues.tolist() == [1, 2, 3, 4]
        for n in (2, 3):
            got = f.histogram(f"h{n}")
            want = np.arange(got.allvalues.size).reshape(got.allvalues.shape) % 100.0
            assert got.axes == axes[:n] and (got.allvalues == want).all() and (got.allvariances == want * 2).all()
            assert got.project(0).allvalues.sum() == want.sum()
        got = f.histogram("p2")
        assert all((a == b).all() for a, b in zip((got.entries, got.entries2, got.sums, got.squares), p, strict=True)) and got.axes == axes[:2]
        assert (f.histogram("p1").means == (p[2] / p[0])[1:-1, 0]).all()


def test_bins_run_along_the_first_axis(tmp_path):
    values = np.arange(12.0).reshape(3, 4)
    with FileWriter(tmp_path / "h.root", compression=None) as f:
        f.hist("h", HistogramND((Axis(1, 0.0, 1.0), Axis(2, 0.0, 2.0)), values, values))
    assert np.array([0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11], ">f8").tobytes() in (tmp_path / "h.root").read_bytes()


def test_fill_of_many_axes(spark):
    axes = (Axis(2, 0.0, 4.0), Axis(2, 0.0, 2.0))
    df = spark.createDataFrame([(0.5, 0.5, 1.0), (0.6, 0.1, 3.0), (3.0, 5.0, 2.0), (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, None)], "x double, y double, v double")
    h = HistogramND.collect(fill_nd(df, ["x", "y"], axes), axes)
    assert h.allvalues[1, 1] == 2 and h.allvalues[2, 3] == 1 and h.allvalues[1, 2] == 1 and h.allvalues.sum() == 4
    p = Profile.collect(fill_nd(df, ["x"], axes[:1], y="v"), axes[:1])
    assert p.means.tolist() == [5 / 3, 2.0] and p.entries.sum() == 4
    assert abs(p.errors[0] - np.std([1, 3, 1]) / 3**0.5) < 1e-12


def test_codecs():
    for kind in codec.TAGS:
        for data in (b"", b"x", b"ab" * 5000, bytes(range(256)) * 40):
            assert codec.decompress(codec.compress(data, kind), len(data)) == data
    big = b"a" * ((1 << 24) + 10)
    for data in (big, big[: 1 << 24]):
        packed = codec.compress(data, "zlib")
        assert len(packed) < len(data) and codec.decompress(packed, len(data)) == data
    with pytest.raises(ValueError):
        codec.decompress(codec.compress(b"ab" * 500, "zlib"), 999)


def test_refusals(tmp_path):
    with FileWriter(tmp_path / "x.root") as f:
        with pytest.raises(NotImplementedError):
            f.tree("t", pa.schema([("x", pa.list_(pa.bool_()))]))
        with pytest.raises(NotImplementedError):
            f.tree("t", pa.schema([("x", pa.uint32())]))
        t = f.tree("t", pa.schema([("x", pa.int32()), ("y", pa.int32())]))
        with pytest.raises(ValueError):
            t.extend(pa.table({"x": [1]}))
        t.close()
    with File(tmp_path / "x.root") as f:
        assert f.tree("t").numentries == 0 and f.tree("t").read(["x"]).num_rows == 0


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "id * 0.5D AS x", "concat('s', id) AS s", "sequence(0, cast(id % 4 AS int)) AS l")
    out = str(tmp_path / "out")
    df.write.format("eventfile").option("tree", "t").option("compression", "zstd").mode("append").save(out)
    back = spark.read.format("eventfile").option("tree", "t").load(out)
    rows = back.orderBy("entry").collect()
    assert [r.entry for r in rows] == list(range(1000)) and [r.id for r in rows] == list(range(1000))
    assert all(r.l == list(range(r.id % 4 + 1)) and r.s == f"s{r.id}" and r.nl == len(r.l) for r in rows)
    part = spark.read.format("eventfile").options(tree="t", branches="x", entrystart="-10", step="3").load(out)
    assert part.columns == ["entry", "x"] and [r.entry for r in part.orderBy("entry").collect()] == list(range(990, 1000)) and part.rdd.getNumPartitions() == 4
    assert datasource.catalog(spark, f"{out}/*.root").where("class_name = 'TTree'").count() == 4
    with pytest.raises(Exception, match="exists"):
        df.write.format("eventfile").option("tree", "t").mode("append").save(out)
    df.write.format("eventfile").option("tree", "t").mode("overwrite").save(out)


def test_columns_own_options(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    df = spark.range(0, 500, 1, 2).selectExpr("id", "id * 2 AS twice", "array(array(id, id + 1)) AS fixed")
    df.write.format("eventfile").options(compression="zlib", compressions="twice:lz4,id:", shapes="fixed:1x2").mode("append").save(out)
    with File(f"{out}/part-00000.root") as f:
        t = f.tree("tree")
        assert t.keys() == ["id", "twice", "fixed"]
        raw, packed = (sum(getattr(c, k) for c in t.chunks(["id"])) for k in ("uncompressed", "compressed"))
        assert raw == packed and sum(c.compressed for c in t.chunks(["twice"])) < raw
    back = spark.read.format("eventfile").load(out).orderBy("id").collect()
    assert [(r.twice, r.fixed) for r in back] == [(2 * i, [[i, i + 1]]) for i in range(500)]
    assert numentries(f"{out}/*.root", "tree") == 500 and numentries(f"{out}/*.root", "none") == 0
    assert list(numentries([f"{out}/part-00001.root", f"{out}/part-00000.root"], "tree", total=False).values()) == [250, 250]
    with FileWriter(tmp_path / "x.root") as f, pytest.raises(ValueError):
        f.tree("t", pa.schema([("x", pa.int32())]), compressions={"x": "none"})


def test_remove(tmp_path):
    with FileWriter(tmp_path / "a.root") as f:
        for text in ("one", "two", "three"):
            f.string("x", text)
        f.string("y", "kept")
        f.remove("x;2")
        f.string("x", "four")
        f.string("z", "gone")
        f.remove("z")
        with pytest.raises(KeyError):
            f.remove("z")
    with File(tmp_path / "a.root") as f:
        assert [(k.name, k.cycle) for k in f.listing()] == [("x", 1), ("x", 3), ("y", 1), ("x", 4)] and f.string("x") == "four" and f.string("x;1") == "one"


def test_codec_bytes():
    """Of each codec the tag and the byte after it, the packed and the plain length, and a body that its own library reads."""
    data = b"abcdefgh" * 1000
    heads = {"zlib": b"ZL\x08", "lzma": b"XZ\x00", "lz4": b"L4\x01", "zstd": b"ZS\x01"}
    opened = {"zlib": zlib.decompress, "lzma": lzma.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=len(data))}
    for kind, head in heads.items():
        got = codec.compress(data, kind)
        assert got[:3] == head and int.from_bytes(got[3:6], "little") == len(got) - 9 and int.from_bytes(got[6:9], "little") == len(data)
        assert kind not in opened or opened[kind](got[9:]) == data


class Ranged(http.server.BaseHTTPRequestHandler):
    body, auth, seen = b"", None, 0

    def do_GET(self):
        type(self).seen += 1
        if self.auth and self.headers.get("Authorization") != self.auth:
            self.send_response(401)
            self.send_header("WWW-Authenticate", 'Basic realm="x"')
            self.end_headers()
            return
        a, b = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers["Range"]).groups()
        part = self.body[int(a) : int(b) + 1]
        self.send_response(206 if part else 416)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


def test_http(spark):
    out = io.BytesIO()
    with FileWriter(out) as f:
        t = f.tree("tree", pa.schema([("x", pa.int64())]))
        t.extend(pa.table({"x": list(range(1000))}))
        t.close()
    Ranged.body, Ranged.auth = out.getvalue(), "Basic " + base64.b64encode(b"me:secret").decode()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.root"
    try:
        with File(url, transport="http", auth=("me", "secret")) as f:
            assert f.tree("tree").read()["x"].to_pylist() == list(range(1000))
        with pytest.raises(urllib.error.HTTPError):
            File(url, auth=("me", "wrong"))
        whole = HttpFile(url, ("me", "secret"), chunk=256)
        whole.prefetch([(0, 1000)])
        before = Ranged.seen
        assert whole.read(1000) == Ranged.body[:1000] and Ranged.seen == before and whole.read() == Ranged.body[1000:]
        datasource.register(spark)
        df = spark.read.format("eventfile").options(transport="http", user="me", password="secret").load(url)
        assert df.agg({"x": "sum"}).first()[0] == 499500
        with pytest.raises(NotImplementedError):
            File("root://host/a.root", transport="xrootd")
    finally:
        server.shutdown()


def test_chunks_one_by_one():
    out = io.BytesIO()
    with FileWriter(out) as f:
        t = f.tree("tree", pa.schema([("x", pa.int32()), ("l", pa.list_(pa.int16()))]))
        for at in (0, 5):
            t.extend(pa.table({"x": pa.array(range(at, at + 5), pa.int32()), "l": pa.array([[k] * (k % 3) for k in range(at, at + 5)], pa.list_(pa.int16()))}))
        t.close()
    with File(out.getvalue(), cache_bytes="1 MB") as f:
        t = f.tree("tree")
        assert t.numbaskets("x") == 2 and t.basket_range("x", 1) == (5, 10) and t.basket_bytes("x", 0)[0] == 20
        assert [(a, b, x.to_pylist()) for a, b, x in t.baskets("x", 3, 7, True)] == [(3, 5, [3, 4]), (5, 7, [5, 6])]
        assert [c.items for c in t.chunks(["l"])] == [4, 5] and t.raw("x", 0)[4].as_py() == b"\0\0\0\4"
        for i in (-1, 2):
            with pytest.raises(IndexError):
                t.basket("x", i)
        assert f.get("tree/l").name == "l" and "tree/none" not in f and t.branch("x").keys() == []


def test_overwrite_and_waiting(spark, tmp_path):
    datasource.register(spark)
    own = spark.range(100)
    for _ in range(2):
        own.coalesce(1).write.format("eventfile").mode("overwrite").save(f"{tmp_path}/out")
    assert spark.read.format("eventfile").load(f"file://{tmp_path}/out").count() == 100
    assert [p for p in os.listdir(tmp_path / "out") if not p.endswith(".root")] == []
    waits = Table(own.withColumnRenamed("id", "entry").withColumn("x", F.col("entry") * 2)).arrays(blocking=False)
    assert waits()["x"].to_pylist() == list(range(0, 200, 2))
