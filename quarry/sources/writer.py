"""Writes files of the columnar format: trees, histograms and strings.

A file is written front to back: chunks first, then the objects that name
them, the key list and, last, the header's places.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from quarry.operators.hist import Histogram, HistogramND, Profile
from quarry.sources.binary import Out
from quarry.sources.classes import PLAIN, Classes, Described, described, write_descriptions
from quarry.sources.codec import compress
from quarry.sources.elements import pack_strings

# Fixed values of the format: element type -> leaf class, and its letter in titles.
LEAF_OF = {"i1": ("TLeafB", "B"), "i2": ("TLeafS", "S"), "i4": ("TLeafI", "I"), "i8": ("TLeafL", "L"), "f4": ("TLeafF", "F"), "f8": ("TLeafD", "D"), "b1": ("TLeafO", "O"), "S": ("TLeafC", "C")}
# Fixed values of the format: number of a compression in headers.
NUMBERS = {"zlib": 1, "lzma": 2, "lz4": 4, "zstd": 5, None: 0}
_BEGIN, _DATE = 100, 0


@dataclass
class Column:
    name: str
    kind: str
    shape: tuple[int, ...] = ()
    counter: str | None = None
    total: int = 0
    packed: int = 0
    seeks: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    edges: list[int] = field(default_factory=lambda: [0])
    longest: int = 0
    compression: str | None = None
    cls: Described | None = None
    member: int = -1
    role: int = 0
    parent: str | None = None

    @property
    def leaf(self) -> str:
        return "TLeafElement" if self.cls else LEAF_OF[self.kind][0]

    @property
    def branch(self) -> str:
        return "TBranchElement" if self.cls else "TBranch"


def _kind(t: pa.DataType, name: str) -> str:
    if pa.types.is_boolean(t):
        return "b1"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "S"
    if pa.types.is_signed_integer(t) or pa.types.is_floating(t) and t.bit_width >= 32:
        return f"{'f' if pa.types.is_floating(t) else 'i'}{t.bit_width // 8}"
    raise NotImplementedError(f"{name}: {t} can't be written")


class FileWriter:
    """mode "create" fails if the file exists, "recreate" overwrites it; "update" isn't possible. path: or a file object, which stays open."""

    def __init__(self, path, mode: str = "create", compression: str | None = "zlib", level: int = 1):
        if mode == "update":
            raise NotImplementedError("files can't be updated in place")
        if compression not in NUMBERS:
            raise ValueError(f"unknown compression {compression!r}")
        self.own = not hasattr(path, "write")
        self.f = open(path, "xb" if mode == "create" else "wb") if self.own else path
        self.compression, self.level, self.at, self.keys = compression, level, 0, []
        self.classes: list[Described] = []
        name = os.path.basename(str(path)) if self.own else "file.root"
        own = self._key_head("TFile", name, "", 0, 0, _BEGIN)[0]
        self.n_name = len(own) + len(Out().string(name).string("").parts)
        self.name = name
        self._write(bytes(_BEGIN + self.n_name + 64))

    def _write(self, data: bytes) -> int:
        self.f.write(data)
        self.at += len(data)
        return self.at - len(data)

    @staticmethod
    def _key_head(cls: str, name: str, title: str, objlen: int, nbytes: int, seek: int, cycle: int = 1, extra: int = 0) -> tuple[bytes, int]:
        names = Out().string(cls).string(name).string(title).parts
        keylen = struct.calcsize(">ihiIhhqq") + len(names) + extra
        return struct.pack(">ihiIhhqq", keylen + nbytes, 1004, objlen, _DATE, keylen, cycle, seek, _BEGIN) + names, keylen

    def put(self, cls: str, name: str, title: str, make, compression=False) -> None:
        """Writes an object: make(length of its key) gives its bytes. A name that is there gets the next cycle."""
        if "/" in name:
            raise NotImplementedError("directories can't be written")
        cycle = 1 + max((k[2] for k in self.keys if k[1] == name), default=0)
        keylen = self._key_head(cls, name, title, 0, 0, 0, cycle)[1]
        data = make(keylen)
        body = compress(data, self.compression if compression is False else compression, self.level)
        head = self._key_head(cls, name, title, len(data), len(body), self.at, cycle)[0]
        self._write(head + body)
        self.keys.append((head, name, cycle))

    def remove(self, name: str) -> None:
        """Takes a name, all its cycles or the one after ``;``, out of the key list; its bytes stay. KeyError if it isn't there."""
        bare, _, cycle = name.partition(";")
        gone = [k for k in self.keys if k[1] == bare and (not cycle or k[2] == int(cycle))]
        if not gone:
            raise KeyError(name)
        self.keys = [k for k in self.keys if k not in gone]

    def string(self, name: str, text: str) -> None:
        self.put("TObjString", name, "Collectable string class", lambda k: bytes(Out(k).object(1, lambda o: o.base_object().string(text)).parts))

    def hist(self, name: str, h: Histogram | HistogramND | Profile, kind: str = "D") -> None:
        """kind: how bins are stored, C, S, I, F or D; profiles are always D."""
        from quarry.sources.hists import class_of, write_hist

        self.put(class_of(h, kind), name, h.title, lambda k: write_hist(h, name, k, kind))

    def update(self, objects: dict | list) -> None:
        """Adds many objects that aren't trees: texts, histograms and profiles, by name."""
        for name, x in objects.items() if isinstance(objects, dict) else objects:
            self.string(name, x) if isinstance(x, str) else self.hist(name, x)

    def describe(self, *classes: Described) -> None:
        """Classes that the file's readers need to know; the same name and version comes once."""
        for c in classes:
            old = next((x for x in self.classes if (x.name, x.version) == (c.name, c.version)), None)
            if old is None:
                self.classes.append(c)
            elif old != c:
                raise ValueError(f"{c.name} is described already")

    def object(self, name: str, cls: str, value: dict, title: str = "") -> None:
        """An object of a described class, from a dict of its members."""
        self.put(cls, name, title, lambda k: bytes(Classes(self.classes).write(cls, value, Out(k)).parts))

    def tree(self, name: str, schema: pa.Schema, title: str = "", shapes: dict[str, tuple[int, ...]] | None = None, compressions: dict | None = None, split: bool = True) -> TreeWriter:
        """split: columns of structs, and of lists of them, get a branch a member; else the structs are whole objects."""
        return TreeWriter(self, name, schema, title, shapes or {}, compressions or {}, split)

    def close(self) -> None:
        keys = b"".join(k for k, _, _ in self.keys)
        body = struct.pack(">i", len(self.keys)) + keys
        head, keylen = self._key_head("TFile", self.name, "", len(body), len(body), self.at)
        seek_keys = self._write(head + body)
        keylen = self._key_head("TList", "StreamerInfo", "Doubly linked list", 0, 0, 0)[1]
        data = write_descriptions(self.classes, keylen)
        packed = compress(data, self.compression, self.level)
        seek_info = self._write(self._key_head("TList", "StreamerInfo", "Doubly linked list", len(data), len(packed), self.at)[0] + packed)
        n_info = self.at - seek_info
        directory = struct.pack(">hIIiiqqq", 1005, _DATE, _DATE, len(head) + len(body), self.n_name, _BEGIN, 0, seek_keys)
        uuid = struct.pack(">H", 1) + os.urandom(16)
        top = self._key_head("TFile", self.name, "", self.n_name, len(directory) + 18, _BEGIN)[0]
        names = Out().string(self.name).string("").parts
        front = struct.pack(">4siiqqiiiBiqi", b"root", 1_062_400, _BEGIN, self.at, 0, 0, 0, self.n_name, 8, NUMBERS[self.compression] * 100 + self.level, seek_info, n_info)
        self.f.seek(0)
        self.f.write(front)
        self.f.seek(_BEGIN)
        self.f.write(top + names + directory + uuid)
        if self.own:
            self.f.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class TreeWriter:
    """Adds a chunk to every column for each batch; a list column is counted by a column n<name> that is made for it."""

    def __init__(self, file: FileWriter, name: str, schema: pa.Schema, title: str, shapes: dict, compressions: dict, split: bool = True):
        self.file, self.name, self.title, self.rows, self.columns = file, name, title, 0, {}
        self.wanted, self.split = schema.names, split
        for kind in {*compressions.values()} - {*NUMBERS}:
            raise ValueError(f"unknown compression {kind!r}")
        for kind in {*compressions, *shapes} - {*schema.names}:
            raise KeyError(kind)
        for f in schema:
            t, dims, how = f.type, shapes.get(f.name, ()), compressions.get(f.name, file.compression)
            for _ in dims:
                t = t.value_type
            if pa.types.is_struct(t) or pa.types.is_list(t) and pa.types.is_struct(t.value_type):
                self._structs(f.name, t, how)
                continue
            counter = None
            if pa.types.is_list(t):
                counter, t = f"n{f.name}", t.value_type
                if pa.types.is_boolean(t) or pa.types.is_list(t) or pa.types.is_string(t):
                    raise NotImplementedError(f"{f.name}: lists of {t} can't be written")
                if counter in schema.names:
                    raise ValueError(f"{counter} is the counter of {f.name}")
                self.columns[counter] = Column(counter, "i4", compression=how)
            self.columns[f.name] = Column(f.name, _kind(t, f.name), tuple(dims), counter, compression=how)

    def _structs(self, name: str, t: pa.DataType, how: str | None) -> None:
        """The branches of a column of objects: a class is described by the column's name."""
        many = pa.types.is_list(t)
        own = described(name, t.value_type if many else t)
        self.file.describe(own)
        if many and not self.split:
            raise NotImplementedError(f"{name}: lists of whole objects can't be written")
        self.columns[name] = Column(name, "object", compression=how, cls=own, role=4 if many else 0)
        for i, m in enumerate(own.members if self.split else ()):
            if many and m.code not in PLAIN:
                raise NotImplementedError(f"{name}.{m.name}: lists of {m.type} can't be written")
            self.columns[f"{name}.{m.name}"] = Column(f"{name}.{m.name}", "object", compression=how, cls=own, member=i, role=41 if many else 0, parent=name)

    def extend(self, batch: pa.RecordBatch | pa.Table) -> None:
        """Appends rows to all columns. Nulls can't be stored."""
        table = pa.table(batch) if isinstance(batch, dict) else batch
        want = self.wanted
        if set(table.column_names if hasattr(table, "column_names") else table.schema.names) != set(want):
            raise ValueError(f"these columns have to come together: {want}")
        if not table.num_rows:
            return
        for c in want:
            col = table[c] if isinstance(table, pa.Table) else table.column(table.schema.get_field_index(c))
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks)
            if col.null_count:
                raise ValueError(f"{c}: nulls can't be stored")
            self._chunk(self.columns[c], col)
        self.rows += table.num_rows

    def _objects(self, c: Column, col: pa.Array) -> None:
        """A column of objects: whole, or a chunk for each member, after one of their counts where they are lists."""
        known, children = Classes(self.file.classes), [x for x in self.columns.values() if x.parent == c.name]
        rows, counts = col, np.ones(len(col), np.int64)
        if c.role == 4:
            counts = col.value_lengths().to_numpy().astype(np.int64)
            c.longest = max(c.longest, int(counts.max(initial=0)))
            self._put(c, counts.astype(">i4").tobytes(), None, len(col))
            rows = col.flatten()
        if rows.null_count or any(x.null_count for x in rows.flatten()):
            raise ValueError(f"{c.name}: nulls can't be stored")
        if c.role == 0 and not children:
            parts = [bytes(known.write(c.cls.name, x, Out()).parts) for x in rows.to_pylist()]
            self._put(c, b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), len(col))
        for child in children:
            m, values = c.cls.members[child.member], rows.field(c.cls.members[child.member].name)
            if m.code in PLAIN:
                flat = values.to_numpy(zero_copy_only=False).astype(PLAIN[m.code])
                edges = np.concatenate(([0], np.cumsum(counts))) * flat.itemsize if c.role == 4 else None
                self._put(child, flat.tobytes(), edges, len(col))
            else:
                parts = []
                for x in values.to_pylist():
                    known.write_member(m, x, out := Out())
                    parts.append(bytes(out.parts))
                self._put(child, b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), len(col))

    def _chunk(self, c: Column, col: pa.Array) -> None:
        n, offsets = len(col), None
        if c.cls:
            self._objects(c, col)
            return
        if c.kind == "S":
            data, offsets = pack_strings(col)
        else:
            width = int(c.kind[1:]) * (int(np.prod(c.shape)) if c.shape else 1)
            if c.counter:
                counts = col.value_lengths().to_numpy()
                self._chunk(self.columns[c.counter], pa.array(counts.astype(np.int32)))
                c.longest = max(c.longest, int(counts.max(initial=0)))
                self.columns[c.counter].longest = c.longest
                col, offsets = col.flatten(), np.concatenate(([0], np.cumsum(counts))) * width
            for size in c.shape:
                if (col.value_lengths().to_numpy() != size).any():
                    raise ValueError(f"{c.name}: a length differs from {size}")
                col = col.flatten()
            flat = col.to_numpy(zero_copy_only=False)
            data = flat.astype("?" if c.kind == "b1" else ">" + c.kind).tobytes()
        self._put(c, data, offsets, n)

    def _put(self, c: Column, data: bytes, offsets: np.ndarray | None, n: int) -> None:
        """Writes one chunk of n entries; offsets: where each starts, if they differ in width."""
        extra = 19
        keylen = FileWriter._key_head("TBasket", c.name, self.name, 0, 0, 0, extra=extra)[1]
        last = keylen + len(data)
        if offsets is not None:
            own = offsets[:n] + keylen
            data += struct.pack(">i", n + 1) + own.astype(">i4").tobytes() + struct.pack(">i", 0)
        body = compress(data, c.compression, self.file.level)
        head = FileWriter._key_head("TBasket", c.name, self.name, len(data), len(body), self.file.at, extra=extra)[0]
        info = struct.pack(">Hiiiib", 3, 32000, 1000 if offsets is not None else 4, n, last, 0)
        c.seeks.append(self.file._write(head + info + body))
        c.sizes.append(keylen + len(body))
        c.edges.append(c.edges[-1] + n)
        c.total += keylen + len(data)
        c.packed += keylen + len(body)

    def _leaf(self, c: Column):
        if c.cls:
            return self._leaf_element(c)
        each = int(np.prod(c.shape)) if c.shape else 1
        width = 1 if c.kind == "S" else int(c.kind[1:])
        tail = {"i1": "bb", "i2": "hh", "i4": "ii", "i8": "qq", "f4": "ff", "f8": "dd", "b1": "??", "S": "ii"}[c.kind]
        dims = (f"[{c.counter}]" if c.counter else "") + "".join(f"[{k}]" for k in c.shape)
        used = any(x.counter == c.name for x in self.columns.values())

        def base(o: Out):
            o.named(c.name, c.name + dims).put("iii??", each, width, 0, used, False)
            own = self.columns.get(c.counter) if c.counter else None
            o.pointer(("leaf", own.name) if own else None, *((LEAF_OF[own.kind][0], self._leaf(own)) if own else ()))

        return lambda o: o.object(1, lambda x: x.object(2, base).put(tail, 0, c.longest if used and c.kind[0] == "i" else 0))

    def _leaf_element(self, c: Column):
        """The leaf of a branch of objects; those of a collection's members are counted by its own."""
        dims = "".join(f"[{k}]" for k in c.cls.members[c.member].dims) if c.member >= 0 else ""
        code = c.cls.members[c.member].code if c.member >= 0 else -1
        title = f"{c.name}[{c.parent}_]" if c.role == 41 else f"{c.name}_" if c.role == 4 else f"{c.name}{dims}"

        def base(o: Out):
            o.named(f"{c.name}_" if c.role == 4 else c.name, title).put("iii??", 1, 4, 0, c.role == 4, False)
            if c.role == 41:
                o.pointer(("leaf", c.parent), "TLeafElement", self._leaf(self.columns[c.parent]))
            else:
                o.pointer(None)

        return lambda o: o.object(1, lambda x: x.object(2, base).put("ii", c.member, code))

    def _branch(self, c: Column):
        letter = "" if c.cls else f"/{LEAF_OF[c.kind][1]}"
        offsets = 1000 if c.counter or c.kind == "S" or c.role == 41 or c.cls and (c.member < 0 and not c.role or c.member >= 0 and c.cls.members[c.member].code not in PLAIN) else 0
        children = [x for x in self.columns.values() if x.parent == c.name]
        n = len(c.seeks)
        most = max(10, n + 1)
        dims = (f"[{c.counter}]" if c.counter else "") + "".join(f"[{k}]" for k in c.shape)
        pad = lambda xs: list(xs) + [0] * (most - len(xs))

        def own(o: Out):
            o.named(c.name, f"{c.name}{dims}{letter}").object(2, lambda x: x.put("hh", 0, 1001))
            o.put("iiii", NUMBERS[c.compression] * 100 + self.file.level, 32000, offsets, n).put("q", self.rows)
            o.object(1, lambda x: x.put("B", 0)).put("iIi", 0, most, 0).put("qqqq", self.rows, 0, c.total, c.packed)
            o.objects([(("branch", x.name), x.branch, self._branch(x)) for x in children]).objects([(("leaf", c.name), c.leaf, self._leaf(c))]).objects([])
            o.put("b", 1).put(f"{most}i", *pad(c.sizes)).put("b", 1).put(f"{most}q", *pad(c.edges)).put("b", 1).put(f"{most}q", *pad(c.seeks)).string("")

        def element(o: Out):
            o.object(13, own).string(f"vector<{c.cls.name}>" if c.role == 4 else c.cls.name).string(c.cls.name if c.parent else "").string(c.cls.name if c.role == 4 else "")
            code = c.cls.members[c.member].code if c.member >= 0 else -1
            o.put("Ihiiii", 0 if c.role == 4 else c.cls.checksum, 0 if c.role == 4 else c.cls.version, c.member, c.role, code, c.longest)
            o.pointer(("branch", c.parent) if c.role == 41 else None).pointer(None)

        return (lambda o: o.object(10, element)) if c.cls else (lambda o: o.object(13, own))

    def close(self) -> None:
        """Writes the tree's own object; its chunks are in the file already."""
        total, packed = sum(c.total for c in self.columns.values()), sum(c.packed for c in self.columns.values())

        def own(o: Out):
            o.named(self.name, self.title)
            o.object(2, lambda x: x.put("hhh", 602, 1, 1)).object(2, lambda x: x.put("hh", 0, 1001)).object(2, lambda x: x.put("hhf", 1, 1, 1.0))
            o.put("qqqqq", self.rows, total, packed, 0, 0).put("d", 1.0).put("iiiii", 0, 25, 0, 1000, 0)
            o.put("qqqqqq", 10**12, 10**12, 0, -300_000_000, -30_000_000, 10**6).put("bb", 0, 0)
            o.object(1, lambda x: x.put("B", 0))
            o.objects([(("branch", c.name), c.branch, self._branch(c)) for c in self.columns.values() if c.parent is None]).objects([(("leaf", c.name), c.leaf, self._leaf(c)) for c in self.columns.values()])
            o.pointer(None).put("i", 0).put("i", 0).pointer(None).pointer(None).pointer(None).pointer(None)

        self.file.put("TTree", self.name, self.title, lambda k: bytes(Out(k).object(20, own).parts))


def write_table(path, table: pa.Table, tree: str = "tree", rows: int = 100_000, mode: str = "create", compression: str | None = "zlib", level: int = 1, shapes=None) -> None:
    with FileWriter(path, mode, compression, level) as f:
        t = f.tree(tree, table.schema, shapes=shapes)
        for b in table.to_batches(max_chunksize=rows):
            t.extend(pa.Table.from_batches([b]))
        t.close()
