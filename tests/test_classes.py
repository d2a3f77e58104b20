"""Classes that files describe: objects, whole and split columns, older versions, pointers, hand-made bytes."""

import io
import struct

import numpy as np
import pyarrow as pa
import pytest

from quarry.sources.binary import In, Out
from quarry.sources.classes import ANY, ANY_POINTER, ARRAY, BASE_OBJECT, POINTED, Classes, Described, Entries, Member, cell, described
from quarry.sources.reader import File, Tree
from quarry.sources.writer import FileWriter

POINT = pa.struct([("x", pa.float64()), ("n", pa.int32()), ("ok", pa.bool_())])
MIXED = pa.struct([("key", pa.int64()), ("name", pa.string()), ("v", pa.list_(pa.float32())), ("words", pa.list_(pa.string())), ("pair", pa.list_(pa.int16(), 2))])


def basic(name, code, kind, **more):
    return Member("TStreamerBasicType", name, "", code, kind, **more)


def written(fill, **options):
    out = io.BytesIO()
    with FileWriter(out, **options) as f:
        fill(f)
    return File(out.getvalue())


def points(n):
    return [{"x": i / 4, "n": i, "ok": i % 3 == 0} for i in range(n)]


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7])
def test_columns_of_structs(split, n):
    mixed = [{"key": i, "name": "ü" * i, "v": [0.5] * (i % 3), "words": ["a", "b" * 300][: i % 3], "pair": [i, -i]} for i in range(n)]
    table = pa.table({"plain": pa.array(range(n), pa.int32()), "p": pa.array(points(n), POINT), "m": pa.array(mixed, MIXED)})

    def fill(f):
        t = f.tree("t", table.schema, split=split)
        for a in range(0, n, 3):
            t.extend(table.slice(a, 3))
        t.close()

    with written(fill) as f:
        t = f.tree("t")
        assert sorted(f.classes.own) == ["m", "p"] and "float" in f.showclasses() and "pair[2]" in f.showclasses(lambda c: c == "m")
        if not split:
            assert t.keys() == ["plain", "p", "m"] or n == 0
            got = t.read()
            assert got["plain"].to_pylist() == list(range(n))
            assert got["p"].to_pylist() == points(n) and got["m"].to_pylist() == mixed
        else:
            got = t.read([f"{b}.{m.name}" for b, s in (("p", POINT), ("m", MIXED)) for m in s])
            for b, rows, s in (("p", points(n), POINT), ("m", mixed, MIXED)):
                for m in s:
                    assert got[f"{b}.{m.name}"].to_pylist() == [r[m.name] for r in rows], (b, m.name)
            assert t.read(["p.x"], 2, 5)["p.x"].to_pylist() == [r["x"] for r in points(n)][2:5]


def test_lists_of_structs():
    lists = [points(i % 4) for i in range(11)]
    table = pa.table({"hits": pa.array(lists, pa.list_(POINT))})

    def fill(f):
        t = f.tree("t", table.schema)
        t.extend(table.slice(0, 5))
        t.extend(table.slice(5))
        t.close()

    with written(fill, compression="zstd") as f:
        t = f.tree("t")
        assert t.read(["hits"])["hits"].to_pylist() == [len(x) for x in lists]
        for m in POINT:
            assert t.read([f"hits.{m.name}"], 3, 9)[f"hits.{m.name}"].to_pylist() == [[p[m.name] for p in x] for x in lists[3:9]]
        assert t.branch("hits/hits.x").counter == "hits" and "t/hits/hits.n" in f
    with pytest.raises(NotImplementedError):
        written(lambda f: f.tree("t", table.schema, split=False))
    with pytest.raises(NotImplementedError):
        written(lambda f: f.tree("t", pa.schema([("a", pa.list_(pa.struct([("s", pa.string())])))])))
    with pytest.raises(ValueError, match="nulls"):
        written(lambda f: f.tree("t", pa.schema([("p", POINT)])).extend(pa.table({"p": pa.array([{"x": None, "n": 1, "ok": True}], POINT)})))


NODE = Described("Node", 3, 77, (
    Member("TStreamerBase", "TObject", "", BASE_OBJECT, "BASE", own=(1,)),
    basic("n", 6, "int"), Member("TStreamerBasicPointer", "values", "[n]", POINTED + 8, "double*", own=(3, "n", "Node")),
    basic("grid", ARRAY + 3, "int", length=6, dims=(2, 3)), Member("TStreamerObjectAnyPointer", "next", "", ANY_POINTER, "Node*"),
    Member("TStreamerObjectAny", "data", "", ANY, "TArrayF"), Member("TStreamerString", "label", "", 65, "TString"),
))


def node(n, then=None):
    return {"n": n, "values": [k / 2 for k in range(n)], "grid": [[n, 1, 2], [3, 4, 5]], "next": then, "data": [0.5] * n, "label": "x" * n}


def test_objects_and_pointers():
    twice = Described("Twice", 1, 5, (Member("TStreamerObjectAnyPointer", "a", "", ANY_POINTER, "Node*"), Member("TStreamerObjectAnyPointer", "b", "", ANY_POINTER, "Node*")))

    def fill(f):
        f.describe(NODE, twice)
        f.describe(NODE)
        f.object("chain", "Node", node(3, node(0, node(1))))
        one = node(2)
        f.object("twice", "Twice", {"a": one, "b": one})

    with written(fill) as f:
        got = f.object("chain")
        assert got["next"]["@class"] == "Node" and got["next"]["next"]["label"] == "x" and got["next"]["next"]["next"] is None
        assert {k: got[k] for k in ("n", "values", "grid", "data", "label")} == {k: v for k, v in node(3).items() if k != "next"} and got["fUniqueID"] == 0
        assert f.object("twice")["a"] is f.object("twice")["b"] or f.object("twice")["a"] == f.object("twice")["b"]
        cls = f.classes
        column = cls.column("Node", [got])
        assert column.type.field("next").type == pa.string() and '"label": ""' in column[0].as_py()["next"]
        assert f.classes.own["Node"][3] == NODE
    with pytest.raises(ValueError, match="described"):
        written(lambda f: f.describe(NODE, Described("Node", 3)))
    with pytest.raises(TypeError):
        written(lambda f: f.put("Strange", "x", "", lambda k: b"")).object("x")


def test_versions_and_unknown_classes():
    old, new = Described("P", 1, 1, (basic("x", 5, "float"),)), Described("P", 2, 2, (basic("x", 5, "float"), basic("y", 3, "int")))
    both = Classes([old, new])
    data = bytes(Classes([old]).write("P", {"x": 1.5}, Out()).parts) + bytes(Classes([new]).write("P", {"x": 2.5, "y": 4}, Out()).parts)
    got = Entries(both, "P").decode(data, np.array([0, 10, 24]))
    assert got.to_pylist() == [{"x": 1.5, "y": None}, {"x": 2.5, "y": 4}]
    bare = struct.pack(">fififi", 0.5, 1, 1.5, 2, 2.5, 3)
    assert Entries(Classes([new]), "P").decode(bare, np.arange(4) * 8).to_pylist() == [{"x": k + 0.5, "y": k + 1} for k in range(3)]
    foreign = struct.pack(">IHIf", 0x40000000 | 10, 0, 1, 9.0)
    assert both.read("P", In(foreign)) == {"x": 9.0}
    holder = Described("H", 1, 3, (Member("TStreamerObjectAny", "odd", "", ANY, "Nobody"), basic("z", 3, "int")))
    own = Out().object(1, lambda o: o.object(7, lambda x: x.put("qq", 1, 2)).put("i", 6))
    assert Classes([holder]).read("H", In(bytes(own.parts))) == {"odd": None, "z": 6}
    short = Classes([Described("P", 1, 1, (basic("x", 8, "double"),))])
    with pytest.raises(ValueError, match="fit"):
        short.read("P", In(data))


def test_vectors_of_objects_by_member():
    p = Described("P", 1, 9, (basic("x", 5, "float"), basic("y", 3, "int")))
    holder = Described("H", 1, 3, (Member("TStreamerSTL", "ps", "", 300, "vector<P>", own=(1, 61)), basic("z", 3, "int")))
    known = Classes([p, holder])
    want = {"ps": [{"x": 0.5, "y": 1}, {"x": 1.5, "y": 2}], "z": 7}
    assert known.read("H", In(bytes(known.write("H", want, Out()).parts))) == want
    split = Out().object(1, lambda o: o.object(0x4000 | 9, lambda x: x.put("hi", 1, 2).put("ffii", 0.5, 1.5, 1, 2)).put("i", 7))
    assert known.read("H", In(bytes(split.parts))) == want
    assert known.column("H", [want]).to_pylist() == [want]


def test_flat_objects():
    inner = Described("V", 1, 1, (Member("TStreamerBase", "TObject", "", BASE_OBJECT, "BASE", own=(1,)), basic("x", 8, "double"), basic("g", ARRAY + 2, "short", length=2, dims=(2,))))
    outer = Described("L", 1, 2, (Member("TStreamerObject", "p", "", 61, "V"), basic("e", 8, "double")))
    known = Classes([inner, outer])
    rows = [{"p": {"x": k / 2, "g": [k, -k]}, "e": float(k)} for k in range(4)]
    data = b"".join(bytes(known.write("L", r, Out()).parts) for r in rows)
    width = len(data) // 4
    assert known.flat("L") is not None and known.flat("L").itemsize + 6 == width
    got = Entries(known, "L").decode(data, np.arange(5) * width).to_pylist()
    one_by_one = [cell(known.read("L", In(data, k * width)), known.arrow("L")) for k in range(4)]
    assert got == one_by_one and [r["e"] for r in got] == [0.0, 1.0, 2.0, 3.0] and got[3]["p"]["g"] == [3, -3]


def test_many_members_of_a_kind():
    text = Member("TStreamerString", "s", "", 65, "TString")
    got = Entries(Classes(), member=text, many=True).decode(b"\x01a\x02bc\x00", np.array([0, 5, 6, 6]))
    assert got.to_pylist() == [["a", "bc"], [""], []]


def test_descriptions_of_structs():
    own = described("m", MIXED)
    assert [m.type for m in own.members] == ["Long64_t", "TString", "vector<float>", "vector<string>", "short"] and own.members[4].code == ARRAY + 2
    with pytest.raises(NotImplementedError):
        described("m", pa.struct([("d", pa.date32())]))


def test_spark_source_reads_split_and_whole_objects(spark, tmp_path):
    table = pa.table({"p": pa.array(points(20), POINT), "hits": pa.array([points(i % 3) for i in range(20)], pa.list_(POINT))})
    with FileWriter(tmp_path / "a.root") as f:
        t = f.tree("tree", table.schema)
        t.extend(table)
        t.close()
    from quarry.sources import datasource

    datasource.register(spark)
    df = spark.read.format("eventfile").option("path", str(tmp_path / "a.root")).load()
    rows = df.orderBy("entry").collect()
    assert [r["p.x"] for r in rows] == [i / 4 for i in range(20)]
    assert [r["hits.n"] for r in rows] == [list(range(i % 3)) for i in range(20)]
    assert isinstance(File(str(tmp_path / "a.root")).tree("tree"), Tree)
