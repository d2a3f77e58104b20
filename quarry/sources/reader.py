"""Reads files of the columnar format: directories, keys, trees and histograms."""

from __future__ import annotations

import io
import re
import struct
import threading
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

from quarry.operators.entries import entry_range, expand, memory_size
from quarry.operators.steps import Chunk, steps
from quarry.sources.binary import In
from quarry.sources.classes import ARRAY, ARRAYS, DOUBLE32, FLOAT16, PLAIN, POINTED, STRING, Classes, Entries, Member, read_descriptions
from quarry.sources.codec import decompress
from quarry.sources.elements import Quantised, Record, arrow_of, bits_of, decode_bits, parse, unpack_strings

# Fixed values of the format: leaf class -> big-endian type of its elements.
LEAVES = {"TLeafB": ">i1", "TLeafS": ">i2", "TLeafI": ">i4", "TLeafL": ">i8", "TLeafG": ">i8", "TLeafF": ">f4", "TLeafD": ">f8", "TLeafO": "?", "TLeafC": "string", "TLeafF16": "short float", "TLeafD32": "short double"}
# Fixed values of the format: element types of vectors.
ELEMENTS = {
    "bool": "?", "char": ">i1", "short": ">i2", "int": ">i4", "long": ">i8", "long long": ">i8", "Long64_t": ">i8", "float": ">f4", "double": ">f8", "unsigned char": ">u1",
    "unsigned short": ">u2", "unsigned int": ">u4", "unsigned long": ">u8", "unsigned long long": ">u8", "ULong64_t": ">u8",
}


@dataclass
class Key:
    name: str
    cycle: int
    class_name: str
    title: str
    seek: int
    nbytes: int
    keylen: int
    objlen: int
    path: str = ""


@dataclass
class Branch:
    """A column: element type, fixed shape, and the branch that counts it if its lists vary in length."""

    name: str
    title: str
    kind: str | None = None
    element: object = None
    shape: tuple[int, ...] = ()
    counter: str | None = None
    skip: int = 0
    unsigned: bool = False
    entry_edges: list[int] = field(default_factory=list)
    seeks: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    total: int = 0
    packed: int = 0
    compress: int = 0
    children: list[Branch] = field(default_factory=list)
    class_name: str = ""
    class_version: int = 0
    checksum: int = 0
    member: int = -1
    role: int = -1
    counted_by: str | None = None

    def keys(self, recursive: bool = True) -> list[str]:
        """Names of the branches below this one, each followed by those below it where recursive holds."""
        return [n for c in self.children for n in (c.name, *(c.keys() if recursive else ()))]

    def planned(self) -> list[Chunk]:
        """Chunks from the tree's own lists alone; their uncompressed bytes are by the branch's ratio."""
        ratio = self.total / self.packed if self.packed else 1.0
        return [Chunk(self.name, a, b, round(n * ratio), n) for a, b, n in zip(self.entry_edges, self.entry_edges[1:], self.sizes, strict=False)]

    @property
    def jagged(self) -> bool:
        return self.counter is not None or self.skip > 0

    def arrow_type(self) -> pa.DataType | None:
        if self.kind is None or (not self.seeks and self.children):
            return None
        if self.kind == "string":
            return pa.string()
        if self.kind == "bits":
            return pa.list_(pa.bool_())
        if self.kind in ("composite", "record", "object"):
            return self.element.arrow
        out = self.element.arrow if self.element else arrow_of(self.kind)
        for _ in self.shape:
            out = pa.list_(out)
        return pa.list_(out) if self.jagged else out


class Cache(OrderedDict):
    """Byte-limited cache of decoded chunks, for threads too; the least recently used go first. limit: bytes, or a size as "64 MB"."""

    def __init__(self, limit: int | str):
        super().__init__()
        size = memory_size(limit) if isinstance(limit, str) else limit
        if size is None:
            raise ValueError(f"not a memory size: {limit!r}")
        self.limit, self.bytes, self.lock = size, 0, threading.RLock()

    def get_or(self, key, make):
        with self.lock:
            if key in self:
                self.move_to_end(key)
                return self[key]
        got = make()
        with self.lock:
            if key not in self:
                self[key] = got
                self.bytes += got.nbytes
            while self.bytes > self.limit and self:
                self.bytes -= self.popitem(last=False)[1].nbytes
        return got


class File:
    """An open file. source: a path, a URI that the arrow file systems know, bytes, or a file object.

    transport: "file", "http" or "arrow" whatever the scheme says. auth: user
    and password for HTTP.
    """

    def __init__(self, source, cache_bytes: int | str = 64 << 20, transport: str | None = None, auth: tuple[str, str] | None = None):
        self.f, self.cache = _open(source, transport, auth), Cache(cache_bytes)
        head = In(self.at(0, 64))
        if head.bytes(4) != b"root":
            raise ValueError(f"not a file of this format: {source!r:.80}")
        version, self.begin = head.take("ii")
        big = version >= 1_000_000
        self.version = version % 1_000_000
        self.end = head.take("q" if big else "i")
        head.take("qii" if big else "iii")
        n_name = head.take("i")
        head.take("B")
        self.compression = head.take("i")
        self.described_at = head.take("q" if big else "i")
        d = In(self.at(self.begin + n_name, 64))
        self.keys = self._directory(d, "")

    def at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def close(self) -> None:
        self.f.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _key(self, d: In) -> Key:
        nbytes, version, objlen, _, keylen, cycle = d.take("ihiIhh")
        seek, _ = d.take("qq" if version > 1000 else "ii")
        cls, name, title = d.string(), d.string(), d.string()
        return Key(name, cycle, cls, title, seek, nbytes, keylen, objlen)

    def _directory(self, d: In, path: str) -> list[Key]:
        version = d.take("h")
        d.take("II")
        d.take("ii")
        _, _, seek_keys = d.take("qqq" if version > 1000 else "iii")
        if not seek_keys:
            return []
        head = self._key(In(self.at(seek_keys, 1024)))
        body = In(self.at(seek_keys + head.keylen, max(4, head.nbytes - head.keylen)))
        out = []
        for _ in range(body.take("i")):
            k = self._key(body)
            k.path = f"{path}{k.name}"
            out.append(k)
            if k.class_name in ("TDirectory", "TDirectoryFile"):
                out += self._directory(In(self.at(k.seek + k.keylen, 64)), f"{k.path}/")
        return out

    @cached_property
    def classes(self) -> Classes:
        """The classes that the file describes."""
        if not self.described_at:
            return Classes()
        key = self._key(In(self.at(self.described_at, 1024)))
        return Classes(read_descriptions(In(self.payload(key), origin=key.keylen)))

    def showclasses(self, filtername=None) -> str:
        """The file's classes with their members, as text."""
        return self.classes.show(filtername)

    def object(self, name: str) -> dict:
        """Any object of a class that the file describes: its members by name, those behind pointers with their class as "@class"."""
        key = self.find(name)
        if not self.classes.known(key.class_name):
            raise TypeError(f"{name} is a {key.class_name}, which the file doesn't describe")
        return self.classes.read(key.class_name, In(self.payload(key), origin=key.keylen))

    def listing(self, recursive: bool = True, filtername=None, filterclass=None) -> list[Key]:
        return [k for k in self.keys if (recursive or "/" not in k.path) and (filtername is None or filtername(k.name)) and (filterclass is None or filterclass(k.class_name))]

    def find(self, name: str) -> Key:
        """By path and ``;cycle``; without a cycle the highest."""
        path, _, cycle = name.partition(";")
        own = [k for k in self.keys if k.path == path.strip("/") and (not cycle or k.cycle == int(cycle))]
        if not own:
            raise KeyError(name)
        return max(own, key=lambda k: k.cycle)

    def get(self, name: str) -> Key | Branch:
        """A key, or the branch of a tree, by a path through directories, the tree and its branches. KeyError if there is none."""
        parts = name.strip("/").split("/")
        for n in range(len(parts), 0, -1):
            try:
                key = self.find("/".join(parts[:n]))
            except KeyError:
                continue
            if n == len(parts):
                return key
            if key.class_name in ("TTree", "TNtuple", "TNtupleD"):
                return self.tree("/".join(parts[:n])).branch("/".join(parts[n:]))
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        try:
            return bool(self.get(name))
        except KeyError:
            return False

    def payload(self, key: Key) -> bytes:
        return decompress(self.at(key.seek + key.keylen, key.nbytes - key.keylen), key.objlen)

    def tree(self, name: str) -> Tree:
        key = self.find(name)
        if key.class_name not in ("TTree", "TNtuple", "TNtupleD"):
            raise TypeError(f"{name} is a {key.class_name}")
        return Tree(self, key)

    def string(self, name: str) -> str:
        d = In(self.payload(self.find(name)))
        d.header()
        d.base_object()
        return d.string()

    def histogram(self, name: str):
        from quarry.sources.hists import read_hist

        key = self.find(name)
        return read_hist(In(self.payload(key), origin=key.keylen), key.class_name)


def numentries(paths, tree: str, total: bool = True):
    """Entries of a tree over files, from its metadata alone; files without the tree count 0. total=False: by path, in order."""
    counts = {}
    for p in expand(paths):
        with File(p) as f:
            counts[p] = f.tree(tree).numentries if tree in f else 0
    return sum(counts[p] for p in expand(paths)) if total else counts


def _open(source, transport: str | None = None, auth: tuple[str, str] | None = None):
    if transport not in (None, "file", "http", "arrow"):
        raise NotImplementedError(f"no transport {transport!r} here")
    if isinstance(source, (bytes, bytearray)):
        return io.BytesIO(source)
    if hasattr(source, "read"):
        return source
    text = str(source)
    scheme = {"file": "file", "http": "http", "arrow": "arrow"}.get(transport) or (text.split("://", 1)[0] if "://" in text else "file")
    if scheme in ("http", "https"):
        from quarry.sources.remote import HttpFile

        return HttpFile(text, auth)
    if scheme == "file":
        return open(text.removeprefix("file://"), "rb")
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(text)
    except pa.ArrowInvalid as e:
        raise ValueError(f"unknown scheme {scheme!r}") from e
    return store.open_input_file(path)


def iterate(paths, tree: str, branches: list[str] | None = None, entrysteps=float("inf"), reportpath: bool = False, reportfile: bool = False, reportentries: bool = False, entrystart: int | None = None, entrystop: int | None = None, pandas: bool = False):
    """Steps over a tree in many files, in order; files without it are skipped.

    What is reported comes before the data: path, file, first and last entry,
    which run on over the files, as the bounds do. entrysteps: as of
    steps.steps, within each file. pandas: frames with the entry as index, by
    clusters unless entrysteps says otherwise.
    """
    entrysteps = None if pandas and entrysteps == float("inf") else entrysteps
    files, at = expand(paths), 0
    total = numentries(files, tree) if (entrystart or 0) < 0 or (entrystop or 0) < 0 else 1 << 62
    first, last = entry_range(total, entrystart, entrystop)
    for path in files:
        with File(path) as f:
            if tree not in f:
                continue
            t = f.tree(tree)
            names = branches if branches is not None else t.keys()
            low, high = max(0, first - at), min(t.numentries, last - at)
            chunks = t.chunks(names) if entrysteps is None or isinstance(entrysteps, str) else ()
            for a, b in steps(entrysteps, t.numentries, low, high, chunks, names) if low < high else ():
                got = t.read(names, a, b)
                if pandas:
                    got = got.to_pandas()
                    got.index = range(at + a, at + b)
                    got.index.name = "entry"
                told = (*([path] if reportpath else []), *([f] if reportfile else []), *([at + a, at + b] if reportentries else []))
                yield (*told, got) if told else got
            at += t.numentries


class Tree:
    """A tree's metadata; reads its columns over entry ranges as Arrow arrays."""

    def __init__(self, file: File, key: Key):
        self.file, self.key = file, key
        d = In(file.payload(key), origin=key.keylen)
        version, _ = d.header()
        if key.class_name != "TTree":
            version, _ = d.header()
        self.name, self.title = d.named()
        for _ in range(3):
            d.skip()
        self.numentries, *_ = d.take("qqqq")
        if version >= 18:
            d.take("q")  # flushed bytes
        d.take("d")
        d.take("iii")
        if version >= 18:
            d.take("i")
        clusters = d.take("i") if version >= 19 else 0
        d.take("qqqqqq" if version >= 18 else "qqqqq")
        if version >= 19:
            for _ in range(2):
                if d.take("b"):
                    d.bytes(8 * clusters)
        if version >= 20:
            d.skip()
        self.branches = d.objects(self._branch)
        self._all: dict[str, Branch] = {}
        todo = list(self.branches)
        for b in todo:
            self._all.setdefault(b.name, b)
            todo += b.children
        for b in todo:
            if b.kind is None and b.role >= 0:
                self._settle(b)

    def _branch(self, cls: str, d: In, end: int | None, note) -> Branch:
        if cls not in ("TBranch", "TBranchElement", "TBranchObject", "TBranchClones"):
            return Branch("", cls)
        outer = d.header()[0] if cls == "TBranchElement" else 0
        version, inner = d.header()
        name, title = d.named()
        b = Branch(name, title)
        note(b)
        d.skip()  # fill attributes
        b.compress, _, _ = d.take("iii")
        n = d.take("i")
        d.take("q")
        if version >= 13:
            d.skip()
        d.take("i")
        most = d.take("I")
        d.take("i")
        d.take("q")
        if version >= 11:
            d.take("q")
        b.total, b.packed = d.take("qq")
        b.children = [c for c in d.objects(self._branch) if c is not None]
        leaves = [x for x in d.objects(self._leaf) if x is not None]
        d.objects(lambda c, i, e, note: c)
        arrays = []
        for form in "iqq":
            arrays.append(list(struct.unpack(f">{most}{form}", d.bytes(most * struct.calcsize(">" + form)))) if d.take("b") else [])
        b.sizes, b.entry_edges, b.seeks = arrays[0][:n], arrays[1][: n + 1], arrays[2][:n]
        d.at = inner if inner is not None else d.at
        if len(leaves) == 1:
            leaf = leaves[0]
            b.kind, b.unsigned, b.counter = leaf["kind"], leaf["unsigned"], leaf["counter"]
            b.shape = tuple(int(x) for x in re.findall(r"\[(\d+)\]", leaf["title"])) or ((leaf["len"],) if leaf["len"] > 1 and not b.counter and b.kind != "string" else ())
            if b.kind in ("short float", "short double"):
                b.element = Quantised.of_title(title if "," in title else leaf["title"], b.kind == "short double")
        elif leaves and all(x["kind"] and (x["kind"] == "?" or x["kind"][0] == ">") and not x["counter"] for x in leaves):
            shape = lambda x: tuple(int(k) for k in re.findall(r"\[(\d+)\]", x["title"])) or ((x["len"],) if x["len"] > 1 else ())
            b.kind, b.element = "record", Record(tuple((x["name"], x["kind"], shape(x)) for x in leaves))
        if cls == "TBranchElement":
            self._element(b, d, outer)
        return b

    def _settle(self, b: Branch) -> None:
        """What a branch of objects holds, by the file's descriptions: whole objects, one member of them, or of each in a collection."""
        known, b.counter, b.shape = self.file.classes, None, ()
        many = b.role in (31, 41)
        if b.role in (3, 4):
            b.kind = ">i4"
        elif b.member < 0 and not b.children and known.known(b.class_name):
            b.kind, b.element = "object", Entries(known, b.class_name)
        elif b.member >= 0 and not b.children and b.class_name in known:
            members = known.of(b.class_name, b.class_version, b.checksum).members
            if b.member < len(members) and not members[b.member].base:
                self._settle_member(b, members[b.member], many)
        b.counter = b.counted_by if many and b.kind != "object" else None

    def _settle_member(self, b: Branch, m: Member, many: bool) -> None:
        dims = (m.dims or (m.length,)) if ARRAY <= m.code < POINTED else ()
        code = m.code - ARRAY if dims else m.code
        vector = re.fullmatch(r"(?:std::)?vector<\s*(.+?)\s*>", m.type)
        if code in PLAIN:
            b.kind, b.shape = PLAIN[code], dims
        elif code in (DOUBLE32, FLOAT16):
            b.kind, b.shape, b.element = "short float", dims, Quantised.of_title(m.title, code == DOUBLE32)
        elif not many and m.code - POINTED in PLAIN:
            b.kind, b.skip = PLAIN[m.code - POINTED], 1
        elif not many and m.code == STRING:
            b.kind = "string"
        elif not many and m.type in ARRAYS:
            b.kind, b.skip = ARRAYS[m.type], 4
        elif not many and vector and vector[1] in ELEMENTS:
            b.kind, b.skip = ELEMENTS[vector[1]], 10
        else:
            b.kind, b.element = "object", Entries(self.file.classes, member=m, many=many)

    def _element(self, b: Branch, d: In, version: int) -> None:
        name = d.string()
        if version >= 8:
            b.class_name, _, _ = name, d.string(), d.string()
            b.checksum = d.take("I")
            own = self.file.classes
            wide = "TBranchElement" in own and any(m.name == "fClassVersion" and m.code == 3 for m in own.of("TBranchElement").members)
            b.class_version, b.member, b.role, _, _ = d.take("iiiii" if wide else "hiiii")
            count = d.pointer(self._branch)
            b.counted_by = count.name if count else None
        m = re.fullmatch(r"vector<(.+?)>", name)
        if m and m[1] in ELEMENTS and not b.children:
            b.kind, b.skip, b.counter, b.shape = ELEMENTS[m[1]], 10, None, ()
        elif name in ("string", "TString") and not b.children:
            b.kind = "string"
        elif bits_of(name) and not b.children:
            b.kind, b.element, b.counter, b.shape = "bits", bits_of(name), None, ()
        elif not b.children and parse(name, ELEMENTS) is not None:
            b.kind, b.element, b.counter, b.shape = "composite", parse(name, ELEMENTS), None, ()

    def _leaf(self, cls: str, d: In, end: int | None, note) -> dict:
        own: dict = {"kind": LEAVES.get(cls), "unsigned": False, "counter": None, "len": 1, "title": "", "name": ""}
        note(own)
        d.header()
        _, inner = d.header()
        own["name"], own["title"] = d.named()
        own["len"], _, _ = d.take("iii")
        _, own["unsigned"] = d.take("??")
        count = d.pointer(self._leaf)
        if count:
            own["counter"] = count["name"]
        if own["unsigned"] and own["kind"] and own["kind"][1:2] == "i":
            own["kind"] = ">u" + own["kind"][2:]
        d.at = inner if inner is not None else d.at
        return own

    def keys(self) -> list[str]:
        """Columns that can be read."""
        return [n for n, b in self._all.items() if b.arrow_type() is not None]

    def branch(self, path: str) -> Branch:
        """By name, or by a path of names from the top. KeyError if there is none."""
        own, found = self.branches, None
        for part in path.split("/"):
            found = next((b for b in own if b.name in (part, path)), None)
            if found is None:
                break
            own = found.children
        found = found or self._all.get(path)
        if found is None:
            raise KeyError(path)
        return found

    def numbaskets(self, name: str) -> int:
        return len(self.branch(name).seeks)

    def _at(self, name: str, i: int) -> Branch:
        b = self.branch(name)
        if not 0 <= i < len(b.seeks):
            raise IndexError(f"{name} has {len(b.seeks)} chunks, no {i}")
        return b

    def basket_range(self, name: str, i: int) -> tuple[int, int]:
        """Entries [start, stop) of one chunk; IndexError if there is no such chunk, as in all that follow."""
        b = self._at(name, i)
        return b.entry_edges[i], b.entry_edges[i + 1]

    def basket_bytes(self, name: str, i: int) -> tuple[int, int]:
        """Uncompressed and compressed bytes of one chunk."""
        head = self.file._key(In(self.file.at(self._at(name, i).seeks[i], 1024)))
        return head.objlen, head.nbytes - head.keylen

    def basket(self, name: str, i: int, start: int = 0, stop: int | None = None) -> pa.Array:
        """What one chunk holds of entries [start, stop)."""
        a, z = self.basket_range(name, i)
        low, high = max(a, start), z if stop is None else min(z, stop)
        return self._chunk(name, i).slice(low - a, max(0, high - low))

    def baskets(self, name: str, start: int = 0, stop: int | None = None, reportentries: bool = False):
        """The chunks of a column that overlap [start, stop), one after another."""
        b = self.branch(name)
        for i in range(len(b.seeks)):
            a, z = b.entry_edges[i], b.entry_edges[i + 1]
            if z > start and (stop is None or a < stop):
                got = self.basket(name, i, start, stop)
                yield (max(a, start), max(a, start) + len(got), got) if reportentries else got

    def compression(self, name: str) -> tuple[str | None, int]:
        """Codec and level of a branch, or the file's where the branch says none."""
        code = self.branch(name).compress or self.file.compression
        return {1: "zlib", 2: "lzma", 4: "lz4", 5: "zstd"}.get(code // 100), code % 100

    def raw(self, name: str, i: int) -> pa.Array:
        """The bytes of each entry of one chunk, as they are stored."""
        b = self._at(name, i)
        data, offsets, n, _ = self._basket(b, i)
        if offsets is None:
            offsets = np.arange(n + 1) * (len(data) // n if n else 0)
        return pa.array([data[x:y] for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary())

    def schema(self) -> pa.Schema:
        return pa.schema([(n, self._all[n].arrow_type()) for n in self.keys()])

    def _basket(self, b: Branch, i: int):
        """The data of one chunk with the offsets of its entries, if stored."""
        head = self.file._key(In(self.file.at(b.seeks[i], 1024)))
        payload = self.file.payload(Key("", 0, "", "", b.seeks[i], head.nbytes, head.keylen, head.objlen))
        info = In(self.file.at(b.seeks[i], head.keylen), head.keylen - 19)
        _, _, _, n, last, _ = info.take("Hiiiib")
        border = last - head.keylen
        offsets = None
        if len(payload) > border:
            raw = np.frombuffer(payload, ">i4", 1 + n, border)[1:].astype(np.int64) - head.keylen
            offsets = np.append(raw, border)
        return payload[:border], offsets, n, head

    def chunks(self, names: list[str] | None = None) -> list[Chunk]:
        out = []
        for n in names or self.keys():
            b = self._all[n]
            for i in range(len(b.seeks)):
                head = self.file._key(In(self.file.at(b.seeks[i], 1024)))
                a, z = b.entry_edges[i], b.entry_edges[i + 1]
                out.append(Chunk(n, a, z, head.objlen, head.nbytes - head.keylen, self._items(b, i, z - a)))
        return out

    def _items(self, b: Branch, i: int, rows: int) -> int:
        """Elements in a chunk: those of its lists, or one or a shape's number a row."""
        if b.jagged and b.arrow_type() is not None:
            return len(self._chunk(b.name, i).flatten())
        return rows * int(np.prod(b.shape)) if b.shape else rows

    def _chunk(self, name: str, i: int) -> pa.Array:
        return self.file.cache.get_or((self.key.seek, name, i), lambda: self._decode(name, i))

    def _decode(self, name: str, i: int) -> pa.Array:
        b = self._all[name]
        data, offsets, _, _ = self._basket(b, i)
        if b.kind == "string":
            return unpack_strings(data, offsets if offsets is not None else np.zeros(1, np.int64))
        if b.kind == "bits":
            flags = decode_bits(data, b.element)
            return pa.ListArray.from_arrays(np.arange(len(flags) + 1, dtype=np.int32) * b.element, pa.array(flags.ravel()))
        if b.kind == "record":
            return b.element.decode(data)
        if b.kind == "object":
            rows = b.entry_edges[i + 1] - b.entry_edges[i]
            return b.element.decode(data, offsets if offsets is not None else np.arange(rows + 1) * (len(data) // max(1, rows)))
        if b.kind == "composite":
            # six bytes, a length and a version, come before each entry
            return pa.array([b.element.read(In(data, int(at) + 6)) for at in offsets[:-1]], b.element.arrow)
        width = b.element.width if b.element else np.dtype(b.kind).itemsize
        each = int(np.prod(b.shape)) if b.shape else 1
        if b.skip:
            raw = np.frombuffer(data, np.uint8)
            keep = np.ones(len(raw), bool)
            keep[(offsets[:-1, None] + np.arange(b.skip)).ravel()] = False
            flat, counts = np.frombuffer(raw[keep].tobytes(), b.kind), (np.diff(offsets) - b.skip) // width
        else:
            flat = b.element.decode(data) if b.element else np.frombuffer(data, b.kind)
            if b.counter is not None:
                counts = self._counts(b, b.entry_edges[i], b.entry_edges[i + 1]) if offsets is None else np.diff(offsets) // (width * each)
        values = _values(flat)
        for size in reversed(b.shape):
            values = pa.ListArray.from_arrays(np.arange(0, len(values) + 1, size, dtype=np.int32), values)
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), values) if b.jagged else values

    def _counts(self, b: Branch, start: int, stop: int) -> np.ndarray:
        """Lengths from the counter column, for files that leave the offsets out."""
        return self.read([b.counter], start, stop)[b.counter].to_numpy().astype(np.int64)

    def read(self, names: list[str] | None = None, start: int = 0, stop: int | None = None) -> pa.Table:
        """Columns over entries [start, stop); chunks outside the range aren't touched."""
        stop = self.numentries if stop is None else min(stop, self.numentries)
        cols = {}
        for n in names if names is not None else self.keys():
            if n not in self._all:
                raise KeyError(n)
            b = self._all[n]
            if b.arrow_type() is None:
                raise ValueError(f"{n} can't be read")
            parts, edges = [], b.entry_edges
            for i in range(bisect_right(edges, start, 1) - 1, min(bisect_left(edges, stop), len(b.seeks))):
                a, z = edges[i], edges[i + 1]
                if a < stop and z > start:
                    parts.append(self._chunk(n, i).slice(max(0, start - a), min(z, stop) - max(a, start)))
            cols[n] = pa.chunked_array(parts, b.arrow_type())
        return pa.table(cols)


def _values(flat: np.ndarray) -> pa.Array:
    """Native-endian Arrow values; unsigned numbers in the next wider type."""
    if flat.dtype.kind == "u":
        return pa.array(flat.astype(flat.dtype.newbyteorder("="))).cast(arrow_of(f">u{flat.dtype.itemsize}"))
    return pa.array(flat.astype(flat.dtype.newbyteorder("=")))
