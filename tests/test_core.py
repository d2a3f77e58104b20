"""Selectors, entry ranges, steps, flattening, histograms and the table, on small data."""

from collections import OrderedDict, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import nested, vectors
from quarry.operators import entries, flatten, hist, selectors, steps
from quarry.plans import table

SF = "/root/testdata/sf0.001"
_INNER = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("In", T.StructType([T.StructField("y", T.IntegerType())]))])
SCHEMA = T.StructType([T.StructField("Run", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("E1", "px1", "py1", "M")], T.StructField("evt", _INNER)])


def test_selectors():
    m = lambda s: selectors.matches(SCHEMA, s)
    assert m(None) == ["Run", "E1", "px1", "py1", "M", "evt"]
    assert m("M") == ["M"] and m(["p[xy]*", "M", "M"]) == ["px1", "py1", "M", "M"] and m("P*") == []
    assert m("/p.1/") == ["px1", "py1"] and m("/P.1/i") == ["px1", "py1"] and m("/p/") == ["px1", "py1"] and m("/x1/") == []
    assert m("evt/In/y") == ["y"] and m("evt/*") == ["x", "In", "y"]
    assert m(lambda b: b.name == "M") == ["M"] and m(lambda b: 1) == [] and m(lambda b: T.LongType() if b.name == "Run" else None) == ["Run"]
    for bad in ("m", "nothing", ["E1", "none"]):
        with pytest.raises(KeyError):
            m(bad)
    assert selectors.names(SCHEMA, "/", "t")[-3:] == ["t/evt/x", "t/evt/In", "t/evt/In/y"]
    assert selectors.names(SCHEMA, False, filtername=str.islower) == ["px1", "py1", "evt"]


def test_select(spark):
    df = spark.createDataFrame([(1, 2.9, -2.9, 3e30, 1.0, (7, (8,)))], SCHEMA)
    got = selectors.select(df, {"E1": "int", "p*": "int", "evt/In/y": None}, keep=["Run"])
    assert got.columns == ["Run", "E1", "px1", "py1", "y"] and tuple(got.first()) == (1, 2, -2, None, 8)
    assert selectors.select(df, ["M", "M"]).columns == ["M"] and selectors.select(df, "evt/x", "/", tree="t").columns == ["t/evt/x"]


def test_entries(spark):
    assert entries.memory_size("50 kB") == 51200 and entries.memory_size("1.5MB") == 1572864 and entries.memory_size("x") is None and entries.memory_size(5) is None
    assert [entries.entry_range(10, *x) for x in ((None, None), (-3, None), (2, -2), (-99, 99), (4, 4))] == [(0, 10), (7, 10), (2, 8), (0, 10), (4, 4)]
    with pytest.raises(IndexError):
        entries.entry_range(10, 5, 2)
    with pytest.raises(TypeError):
        entries.expand("/nowhere/*.x")
    c = f"{SF}/customer.parquet"
    assert entries.numentries(spark, [c, c, c]) == 450
    assert entries.numentries(spark, [c, c, f"{SF}/nation.parquet"], total=False) == {c: 150, f"{SF}/nation.parquet": 25}
    own = entries.read_all(spark, [c, c, c], file="f")
    assert sorted(r.entry for r in own.select("entry").collect()) == list(range(450))
    many = entries.read_all(spark, [f"{SF}/{t}.parquet" for t in ("customer", "supplier", "nation")])
    assert many.where("entry >= 160").select("n_name").where("n_name IS NOT NULL").count() == 25
    plan = entries.slice_entries(own, 3, 5)
    assert [r.entry for r in plan.orderBy("entry").collect()] == [3, 4]


def test_steps():
    chunk = lambda b, edges, size=8: [steps.Chunk(b, x, y, size * (y - x), 1) for x, y in zip(edges, edges[1:], strict=False)]
    a, b = chunk("a", [0, 6, 12, 18, 24, 30, 36, 42, 46]), chunk("b", [0, 12, 30, 46])
    assert steps.steps(None, 46, chunks=a, branches=["a"]) == [(0, 6), (6, 12), (12, 18), (18, 24), (24, 30), (30, 36), (36, 42), (42, 46)]
    assert steps.clusters(a + b, ["a", "b"], 0, 46) == [(0, 12), (12, 30), (30, 46)] and steps.clusters(a + b, ["a", "b"], 5, 40, strict=True) == [(12, 30)]
    assert [y - x for x, y in steps.steps(500, 2304)] == [500, 500, 500, 500, 304]
    assert steps.steps(float("inf"), 5) == [(0, 5)] and steps.steps([(0, 2), (4, 99)], 6) == [(0, 2), (4, 6)]
    thirty = chunk("a", [0, 30], 250)
    assert steps.steps("500 B", 30, chunks=thirty, branches=["a"]) == [(i, i + 2) for i in range(0, 30, 2)]
    assert steps.steps("5 kB", 30, chunks=[], branches=["a"]) == []
    for bad, kind in ((0, ValueError), ("x", ValueError), (-1, ValueError), ("0 B", ValueError), (True, TypeError), (3.5, ValueError)):
        with pytest.raises(kind):
            steps.steps(bad, 30, chunks=thirty, branches=["a"])


def test_flatten(spark):
    df = spark.createDataFrame([(0, [1, 2], [1.0, 2.0], 5, [9, 8], (3, 4)), (1, [], [], 6, [7, 6], (5, 6)), (2, [3], [3.0], 7, [5, 4], (7, 8))], "entry long, a array<int>, b array<double>, s int, f array<int>, t struct<x: int, ` y`: int>")
    got = flatten.flatten(df, fixed={"f": (2,)})
    assert got.columns == ["entry", "subentry", "s", "f[0]", "f[1]", "t.x", "a", "b"]
    assert [tuple(r) for r in got.orderBy("entry", "subentry").collect()] == [(0, 0, 5, 9, 8, 3, 1, 1.0), (0, 1, 5, 9, 8, 3, 2, 2.0), (2, 0, 7, 5, 4, 7, 3, 3.0)]
    with pytest.raises(Exception, match="lists differ"):
        flatten.flatten(df, ["a", "f"]).collect()
    with pytest.raises(Exception, match="length differs"):
        flatten.explode_fixed(df, {"a": (2,)}).collect()
    assert flatten.drop_jagged(df, ["f"]).columns == ["entry", "s", "f", "t"]
    deep = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "m array<array<int>>")
    wide = flatten.explode_fixed(deep, {"m": (2, 3)})
    assert wide.columns == ["m[0][0]", "m[0][1]", "m[0][2]", "m[1][0]", "m[1][1]", "m[1][2]"] and tuple(wide.first()) == (1, 2, 3, 4, 5, 6)


def test_nested(spark):
    df = spark.createDataFrame([([3, 1, 3],), ([],), (None,), ([5],)], "a array<int>")
    rows = df.select(
        nested.counts("a").alias("n"), nested.argmax("a").alias("hi"), nested.argmin("a").alias("lo"), F.size(nested.choose("a", 2)).alias("c"), nested.choose("a", 3).alias("c3"),
        nested.pick("a", 0).alias("p"), nested.pick("a", -1).alias("q"), nested.total("a").alias("t"), nested.elementwise(lambda x, y, z: x + y + z, "a", "a", "a").alias("e"), nested.gather("a", F.array(F.lit(2), F.lit(0))).alias("g"),
    ).collect()
    assert (rows[0].n, rows[0].hi, rows[0].lo, rows[0].c, rows[0].p, rows[0].q, rows[0].t, rows[0].e, rows[0].g) == (3, 0, 1, 3, 3, 3, 7.0, [9, 3, 9], [3, 3])
    assert [tuple(x) for x in rows[0].c3] == [(3, 1, 3)] and (rows[1].n, rows[1].hi, rows[1].c, rows[1].p, rows[1].t) == (0, None, 0, None, 0.0) and rows[2].n is None and rows[3].g == [None, 5]


def test_vectors(spark):
    v = spark.range(1).select(vectors.from_pt_eta_phi_mass(F.lit(10.0), F.lit(1.5), F.lit(3.0), F.lit(2.0)).alias("v"), vectors.cartesian(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.5)).alias("w"))
    r = v.select(vectors.pt("v").alias("pt"), vectors.eta("v").alias("eta"), vectors.phi("v").alias("phi"), vectors.mass("v").alias("m"), vectors.mass("w").alias("none"), vectors.delta_phi("w", "v").alias("d"), vectors.delta_r("v", "v").alias("z")).first()
    assert np.allclose([r.pt, r.eta, r.phi, r.m, r.d, r.z], [10, 1.5, 3, 2, -3, 0], atol=1e-9) and r.none is None


def test_hist(spark):
    axis = hist.Axis(10, 0.0, 10.0)
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 9.999, 10.0, float("nan"), None, 5.5)], "x double")
    h = hist.Histogram.collect(hist.fill(df, "x", axis), axis, "h")
    assert h.allvalues.tolist() == [1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1] and h.values.sum() == 3 and len(h.edges) == 11
    assert hist.Histogram.collect(hist.fill(df, "x", axis, closed=True), axis).values[-1] == 2
    assert len(h.pandas()) == 12 and "value: 1.0" in h.hepdata() and h.show().count("\n") == 11 and h.to_df(spark).count() == 12
    assert abs(hist.normalize(hist.fill(df, "x", axis)).agg(F.sum("sumw")).first()[0] - 1) < 1e-12
    named = hist.Histogram(hist.Axis(2, 0, 2, labels=("one", "two")), np.array([0, 1, 2, 0.0]), np.zeros(4))
    assert "one" in named.show()


def test_table(spark):
    t = table.Table(spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_id", "entry"), "events", chunks=table.row_group_chunks([f"{SF}/events.parquet"]))
    n = t.numentries
    assert t.keys() == ["ts", "user_id", "event_type", "value", "props"] and "value" in t and "nope" not in t and t.numbranches == 5 and "value" in t.show()
    whole = t.arrays(["value", "user_id"], OrderedDict)
    assert type(whole) is OrderedDict and len(whole["value"]) == n
    for a, b in [(None, None), (1, None), (1, 2), (1, 10), (10, 11), (10, 20), (6, 12), (-5, None)]:
        lo, hi = entries.entry_range(n, a, b)
        assert t.arrays("value", list, a, b)[0].to_pylist() == whole["value"].slice(lo, hi - lo).to_pylist()
    for step in (n + 7, 6, 300, 7):
        got = list(t.iterate("user_id", step, tuple, reportentries=True, entrystop=700))
        assert [x[:2] for x in got] == steps.equal(step, 0, min(700, n)) and sum((x[2][0].to_pylist() for x in got), []) == whole["user_id"].slice(0, 700).to_pylist()
    assert [len(x["value"]) for x in t.iterate("value", [(5, 9), (0, 3)])] == [4, 3]
    assert t.clusters("value") == [(0, n)] and t.mempartitions("1 GB") == [(0, n)]
    with pytest.raises(ValueError):
        t.array("*")
    assert t.pandas_df("value", 2, 5).index.tolist() == [2, 3, 4]
    pair = namedtuple("pair", "value user_id")
    assert isinstance(t.arrays(["value", "user_id"], pair, 0, 3), pair) and t.arrays("value", "arrow", 0, 3).num_rows == 3


def test_stream(spark, tmp_path):
    from quarry.streaming import files

    src = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    axis = hist.Axis(5, 0.0, 50.0)
    q = files.running_hist(files.read_stream(spark, str(tmp_path / "in"), src.schema), "l_quantity", axis).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    got = {r.bin: r.sumw for r in spark.table("bins").collect()}
    assert got == {r.bin: r.sumw for r in hist.fill(src, "l_quantity", axis).collect()}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12 and set(e.oracle_sql()) <= set(e.queries())
