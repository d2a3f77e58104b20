"""Classes as files describe them, and objects read and written by these descriptions.

A description lists a class's members in the order in which they are stored.
Reading is driven by that table; nothing from a file is executed. An object
becomes a dict of its members, those of its bases included. As an Arrow column
it is a struct; members whose class is only known from the data (pointers,
lists of objects) are JSON texts there.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from quarry.sources.binary import In, Out
from quarry.sources.elements import Quantised, arrow_of, bits_of, parse

# Fixed values of the format: code of a plain member -> big-endian type.
PLAIN = {1: ">i1", 2: ">i2", 3: ">i4", 4: ">i8", 5: ">f4", 6: ">i4", 8: ">f8", 10: ">i1", 11: ">u1", 12: ">u2", 13: ">u4", 14: ">u8", 15: ">u4", 16: ">i8", 17: ">u8", 18: "?"}
# Fixed values of the format: other codes; ARRAY and POINTED are added to a plain one.
CHARS, DOUBLE32, FLOAT16, ARRAY, POINTED = 7, 9, 19, 20, 40
OBJECT, ANY, OWNED, POINTER, STRING, BASE_OBJECT, BASE_NAMED, ANY_OWNED, ANY_POINTER = 61, 62, 63, 64, 65, 66, 67, 68, 69
# Fixed values of the format: classes that hold a number and then as many values.
ARRAYS = {"TArrayC": ">i1", "TArrayS": ">i2", "TArrayI": ">i4", "TArrayL": ">i8", "TArrayL64": ">i8", "TArrayF": ">f4", "TArrayD": ">f8"}
# Fixed values of the format: names of plain types in templates.
TYPES = {
    "bool": "?", "Bool_t": "?", "char": ">i1", "Char_t": ">i1", "signed char": ">i1", "short": ">i2", "Short_t": ">i2", "int": ">i4", "Int_t": ">i4", "long": ">i8", "Long_t": ">i8",
    "long long": ">i8", "Long64_t": ">i8", "float": ">f4", "Float_t": ">f4", "double": ">f8", "Double_t": ">f8", "unsigned char": ">u1", "UChar_t": ">u1", "Byte_t": ">u1",
    "unsigned short": ">u2", "UShort_t": ">u2", "unsigned int": ">u4", "UInt_t": ">u4", "unsigned long": ">u8", "ULong_t": ">u8", "unsigned long long": ">u8", "ULong64_t": ">u8",
}
# Fixed values of the format: collections of objects, their own numbers before the objects.
COLLECTIONS = {"TList", "THashList", "TObjArray", "TClonesArray"}
# Fixed values of the format: a collection's items are stored member by member.
_BY_MEMBER = 0x4000
_HEADER = ("head", "V6")


@dataclass(frozen=True)
class Member:
    """kind: class of the description; own: what that class adds (a base's version; a counter's version, name and class; codes of a collection)."""

    kind: str
    name: str
    title: str
    code: int
    type: str
    size: int = 0
    length: int = 0
    dims: tuple[int, ...] = ()
    own: tuple = ()

    @property
    def base(self) -> bool:
        return self.kind == "TStreamerBase"

    @property
    def target(self) -> str:
        return self.type.rstrip("*").strip()


@dataclass(frozen=True)
class Described:
    name: str
    version: int
    checksum: int = 0
    members: tuple[Member, ...] = field(default=())

    def show(self) -> str:
        head = f"{self.name}, version {self.version}, checksum 0x{self.checksum:08x}"
        return "\n".join([head, *(f"  {m.type:<24} {m.name}{''.join(f'[{k}]' for k in m.dims)}  // {m.title}" for m in self.members)])


def read_descriptions(d: In) -> list[Described]:
    """The list of descriptions that a file holds; entries that describe no class are passed over."""
    d.header()
    d.base_object()
    d.string()
    out = []
    for _ in range(d.take("i")):
        out.append(d.pointer(_described))
        d.string()
    return [x for x in out if isinstance(x, Described)]


def _described(cls: str, d: In, end: int | None, note) -> Described | None:
    if cls != "TStreamerInfo":
        return None
    d.header()
    name, _ = d.named()
    checksum, version = d.take("Ii")
    members = d.pointer(lambda c, x, e, n: x.objects(_member))
    return Described(name, version, checksum, tuple(m for m in members or () if m is not None))


def _member(cls: str, d: In, end: int | None, note) -> Member:
    outer, _ = d.header()
    if cls == "TStreamerSTLstring":
        d.header()
    version, last = d.header()
    name, title = d.named()
    code, size, length, n = d.take("iiii")
    dims = list(d.take("iiiii")) if version > 1 else np.frombuffer(d.bytes(4 * d.take("i")), ">i4").tolist()
    kind = d.string()
    d.at = last if last is not None else d.at
    own: tuple = ()
    if cls == "TStreamerBase" and outer > 2:
        own = (d.take("i"),)
    elif cls in ("TStreamerBasicPointer", "TStreamerLoop"):
        own = (d.take("i"), d.string(), d.string())
    elif cls in ("TStreamerSTL", "TStreamerSTLstring"):
        own = d.take("ii")
    return Member(cls, name, title, code, kind, size, length, tuple(dims[:n]), own)


def write_descriptions(classes: list[Described], origin: int) -> bytes:
    def member(m: Member):
        def element(o: Out):
            o.named(m.name, m.title).put("iiii", m.code, m.size, m.length, len(m.dims)).put("iiiii", *m.dims, *[0] * (5 - len(m.dims))).string(m.type)

        def fill(o: Out):
            o.object(4, element)
            if m.base:
                o.put("i", *m.own)
            elif m.kind in ("TStreamerBasicPointer", "TStreamerLoop"):
                o.put("i", m.own[0]).string(m.own[1]).string(m.own[2])
            elif m.kind == "TStreamerSTL":
                o.put("ii", *m.own)

        return lambda o: o.object(3 if m.kind in ("TStreamerBase", "TStreamerSTL") else 2, fill)

    def items(c: Described):
        return lambda o: o.objects([((c.name, c.version, i), m.kind, member(m)) for i, m in enumerate(c.members)])

    def info(c: Described):
        def fill(o: Out):
            o.named(c.name, "").put("Ii", c.checksum, c.version).pointer(("members", c.name, c.version), "TObjArray", items(c))

        return lambda o: o.object(9, fill)

    def every(o: Out):
        o.base_object().string("").put("i", len(classes))
        for c in classes:
            o.pointer(("class", c.name, c.version), "TStreamerInfo", info(c)).string("")

    return bytes(Out(origin).object(5, every).parts)


def checksum(name: str, members) -> int:
    """A number that changes with the class's name and its members' names, types and dimensions."""
    text = name + "".join(m.name if m.base else m.name + m.type + "".join(map(str, m.dims)) for m in members)
    out = 0
    for c in text.encode():
        out = (out * 3 + c) & 0xFFFFFFFF
    return out


class Pointed:
    """Items of a collection of pointers."""

    arrow = pa.string()

    def __init__(self, classes: Classes):
        self.classes = classes

    def read(self, d: In):
        return d.pointer(self.classes.pointed)


@dataclass(frozen=True)
class Item:
    """Objects of a class within a collection or a column."""

    name: str
    classes: Classes = field(compare=False)

    @property
    def arrow(self) -> pa.DataType:
        return self.classes.arrow(self.name)

    def read(self, d: In):
        return self.classes.read(self.name, d)


class Classes:
    """The descriptions of a file, by class and version."""

    def __init__(self, described: list[Described] = ()):
        self.own: dict[str, dict[int, Described]] = {}
        for c in described:
            self.own.setdefault(c.name, {})[c.version] = c

    def __contains__(self, name: str) -> bool:
        return name in self.own

    def known(self, name: str) -> bool:
        return name in self.own or name in ARRAYS or name in COLLECTIONS or name in ("TObject", "TNamed", "TString", "TObjString", "TRef", "TRefArray", "TDatime")

    def of(self, name: str, version: int | None = None, checksum: int | None = None) -> Described:
        """The description of that version or checksum, else the newest. KeyError if the class isn't described."""
        own = self.own[name]
        by_sum = next((c for c in own.values() if c.checksum == checksum), None) if checksum else None
        return by_sum or own.get(version) or own[max(own)]

    def show(self, filtername=None) -> str:
        return "\n\n".join(c.show() for n, own in sorted(self.own.items()) if filtername is None or filtername(n) for c in own.values())

    def element(self, name: str):
        """How a class name in a template is read, or None if a part of it isn't known."""
        return parse(name, TYPES, lambda n: Pointed(self) if n.endswith("*") else Item(n, self) if self.known(n) else None)

    # reading

    def pointed(self, cls: str, d: In, end: int | None, note):
        """What a pointer leads to, with its class as "@class"; None if the class isn't known."""
        got: dict = {"@class": cls}
        note(got)
        own = self.read(cls, d, end) if self.known(cls) else None
        got.update(own if isinstance(own, dict) else {"value": own})
        return got

    def read(self, name: str, d: In, end: int | None = None):
        """The object here. An object of a class that isn't described is stepped over and None."""
        if name in ARRAYS:
            return np.frombuffer(d.bytes(d.take("i") * int(ARRAYS[name][2])), ARRAYS[name]).tolist()
        if name == "TString":
            return d.string()
        if name == "TDatime":
            return d.take("I")
        if name == "TObject":
            return self._tobject(d)
        if name == "TRef":
            got = self._tobject(d)
            d.take("H")
            return got
        if not self.known(name):
            d.skip()
            return None
        start = d.at
        version, last = d.header()
        try:
            got = self._body(name, version, d)
        except NotImplementedError:
            if last is None:
                raise
            got = None
        if last is not None and d.at > last:
            raise ValueError(f"{name} at {start} doesn't fit its description")
        d.at = last if last is not None else d.at
        return got

    def entry(self, name: str, d: In, end: int):
        """The object that an entry of a column holds, with or without its length and version before it."""
        start = d.at
        if end - start >= 6:
            _, last = d.header()
            d.at = start
            if last == end or not self.known(name):
                return self.read(name, d)
        return self._fields(self.of(name), d, {}) if name in self.own else self.read(name, d)

    def _body(self, name: str, version: int, d: In):
        if name == "TNamed":
            return self._named(d)
        if name == "TObjString":
            return {**self._tobject(d), "fString": d.string()}
        if name == "TRefArray":
            got = {**self._tobject(d), "fName": d.string()}
            n, low, _ = d.take("iiH")
            return {**got, "fLowerBound": low, "fUIDs": np.frombuffer(d.bytes(4 * n), ">u4").tolist()}
        if name in COLLECTIONS:
            return self._collection(name, version, d)
        number = d.take("I") if version == 0 else None
        return self._fields(self.of(name, version, number), d, {})

    def _collection(self, name: str, version: int, d: In):
        self._tobject(d)
        title = d.string()
        if name == "TClonesArray":
            item = re.sub(r";\d+$", "", d.string())
            n, _ = d.take("ii")
            if item not in self.own:
                raise NotImplementedError(item)
            if version & _BY_MEMBER:
                return {"fName": title, "items": self._by_member(self.of(item), n, d)}
            return {"fName": title, "items": [self.read(item, d) if d.take("B") else None for _ in range(n)]}
        n = d.take("i") if name != "TObjArray" else d.take("ii")[0]
        items = []
        for _ in range(n):
            items.append(d.pointer(self.pointed))
            if name != "TObjArray":
                d.string()
        return {"fName": title, "items": items}

    @staticmethod
    def _tobject(d: In) -> dict:
        at = d.at
        d.base_object()
        skip = 4 if d.data[at] & 0x40 else 0
        unique, bits = np.frombuffer(d.data, ">u4", 2, at + 2 + skip).tolist()
        return {"fUniqueID": unique, "fBits": bits}

    def _named(self, d: In) -> dict:
        return {**self._tobject(d), "fName": d.string(), "fTitle": d.string()}

    def _fields(self, c: Described, d: In, own: dict) -> dict:
        for m in c.members:
            if m.base:
                got = self.read(m.name, d)
                own.update(got if isinstance(got, dict) else {m.name: got})
            else:
                own[m.name] = self.member(m, d, own)
        return own

    def _by_member(self, c: Described, n: int, d: In) -> list[dict]:
        if any(m.base for m in c.members):
            raise NotImplementedError(f"{c.name}: bases stored member by member")
        items: list[dict] = [{} for _ in range(n)]
        for m in c.members:
            for x in items:
                x[m.name] = self.member(m, d, x)
        return items

    def member(self, m: Member, d: In, own: dict):
        """The value of a member that isn't a base; own: the members before it, for counters."""
        code, n = m.code, 1
        if ARRAY <= code < POINTED or ARRAY + OBJECT <= code <= ARRAY + ANY_POINTER:
            flat = self._several(m, code - ARRAY, d, m.length)
            for size in reversed(m.dims[1:]):
                flat = [flat[i : i + size] for i in range(0, len(flat), size)]
            return flat
        if POINTED <= code < POINTED + ARRAY:
            n = own[m.own[1]]
            return self._several(m, code - POINTED, d, n) if d.take("B") else []
        if m.kind in ("TStreamerSTL", "TStreamerSTLstring"):
            return self._stl(m, d)
        if m.kind == "TStreamerLoop":
            d.header()
            return [self.read(m.target, d) for _ in range(own[m.own[1]])]
        return self._several(m, code, d, 1)[0]

    def _several(self, m: Member, code: int, d: In, n: int) -> list:
        if code in PLAIN:
            return np.frombuffer(d.bytes(n * np.dtype(PLAIN[code]).itemsize), PLAIN[code]).tolist()
        if code in (DOUBLE32, FLOAT16):
            q = Quantised.of_title(m.title, code == DOUBLE32)
            return q.decode(d.bytes(n * q.width)).tolist()
        if code == CHARS:
            return [d.bytes(d.take("i")).decode("utf-8", "replace") for _ in range(n)]
        if code == STRING:
            return [d.string() for _ in range(n)]
        if code == BASE_OBJECT:
            return [self._tobject(d) for _ in range(n)]
        if code in (OBJECT, ANY, OWNED, ANY_OWNED, BASE_NAMED):
            return [self.read(m.target, d) for _ in range(n)]
        if code in (POINTER, ANY_POINTER):
            return [d.pointer(self.pointed) for _ in range(n)]
        raise NotImplementedError(f"{m.name}: members of code {m.code} can't be read")

    def _stl(self, m: Member, d: In):
        version, end = d.header()
        item = re.fullmatch(r"(?:std::)?vector\s*<\s*(.+?)\s*>", m.target)
        if version & _BY_MEMBER:
            number = d.take("h")
            total = d.take("I") if number == 0 else None
            got = self._by_member(self.of(item[1], number, total), d.take("i"), d) if item and item[1] in self.own else None
        elif bits_of(m.target):
            got = (np.frombuffer(d.bytes(d.take("i")), np.uint8) != 0).tolist()
        else:
            element = self.element(m.target)
            got = element.read(d) if element is not None else None
        if end is not None:
            d.at = end
        return got

    # as columns

    def arrow(self, name: str, above: tuple[str, ...] = ()) -> pa.DataType:
        """The type of a column of such objects; JSON texts where it isn't settled before reading."""
        if name in ARRAYS:
            return pa.list_(arrow_of(ARRAYS[name]))
        if name == "TString":
            return pa.string()
        if name == "TDatime":
            return pa.int64()
        fixed = [("fUniqueID", pa.int64()), ("fBits", pa.int64())]
        more = {"TObject": [], "TRef": [], "TNamed": [("fName", pa.string()), ("fTitle", pa.string())], "TObjString": [("fString", pa.string())]}
        if name in more and name not in self.own:
            return pa.struct(fixed + more[name])
        if name not in self.own or name in above:
            return pa.string()
        out: dict[str, pa.DataType] = {}
        for m in self.of(name).members:
            if m.base:
                base = self.arrow(m.name, (*above, name))
                out.update({f.name: f.type for f in base} if pa.types.is_struct(base) else {m.name: base})
            else:
                out[m.name] = self.arrow_member(m, (*above, name))
        return pa.struct(list(out.items()))

    def arrow_member(self, m: Member, above: tuple[str, ...] = ()) -> pa.DataType:
        code, dims = m.code, m.dims
        if POINTED <= code < POINTED + ARRAY and code - POINTED in (*PLAIN, DOUBLE32, FLOAT16):
            code, dims = code - POINTED, (0,)
        elif ARRAY <= code < POINTED or ARRAY + OBJECT <= code <= ARRAY + ANY_POINTER:
            code, dims = code - ARRAY, dims or (m.length,)
        else:
            dims = ()
        if m.kind in ("TStreamerSTL", "TStreamerSTLstring"):
            out = pa.list_(pa.bool_()) if bits_of(m.target) else self._collected(m.target, above)
        elif m.kind == "TStreamerLoop":
            out = pa.list_(self.arrow(m.target, above))
        elif code in PLAIN:
            out = arrow_of(PLAIN[code])
        elif code in (DOUBLE32, FLOAT16):
            out = pa.float64() if code == DOUBLE32 else pa.float32()
        elif code == BASE_OBJECT:
            out = self.arrow("TObject")
        elif code in (OBJECT, ANY, OWNED, ANY_OWNED, BASE_NAMED):
            out = self.arrow(m.target, above)
        else:
            out = pa.string()
        for _ in dims:
            out = pa.list_(out)
        return out

    def _collected(self, name: str, above: tuple[str, ...]) -> pa.DataType:
        m = re.fullmatch(r"(?:std::)?vector\s*<\s*(.+?)\s*>", name)
        if m and m[1] in self.own:
            return pa.list_(self.arrow(m[1], above))
        element = parse(name, TYPES)
        return element.arrow if element is not None else pa.string()

    def column(self, name: str, values: list, kind: pa.DataType | None = None) -> pa.Array:
        kind = kind or self.arrow(name)
        return pa.array([cell(x, kind) for x in values], kind)

    def flat(self, name: str) -> np.dtype | None:
        """The layout of an object that always takes the same bytes, its header left out; None if it doesn't."""
        if name not in self.own or len(self.own[name]) > 1:
            return None
        fields: list[tuple] = []
        for i, m in enumerate(self.of(name).members):
            if m.base and m.name == "TObject":
                fields += [(f"head{i}", "V2"), ("fUniqueID", ">u4"), ("fBits", ">u4")]
            elif m.base:
                base = self.flat(m.name)
                if base is None:
                    return None
                fields += [(f"head{i}", "V6"), *((n if not n.startswith("head") else f"{n}.{i}", base[n]) for n in base.names)]
            elif m.code in PLAIN:
                fields.append((m.name, PLAIN[m.code]))
            elif m.code - ARRAY in PLAIN:
                fields.append((m.name, PLAIN[m.code - ARRAY], m.dims or (m.length,)))
            elif m.code in (OBJECT, ANY) and self.flat(m.target) is not None:
                fields.append((m.name, np.dtype([_HEADER, *((n, self.flat(m.target)[n]) for n in self.flat(m.target).names)])))
            else:
                return None
        names = [f[0] for f in fields]
        return np.dtype(fields) if len(set(names)) == len(names) else None

    # writing

    def write(self, name: str, value, o: Out) -> Out:
        """An object of a described class, from a dict of its members."""
        if name in ARRAYS:
            return o.put("i", len(value)).raw(np.asarray(value, ARRAYS[name]).tobytes())
        if name == "TString":
            return o.string(value)
        if name == "TObject":
            return o.base_object()
        if name == "TNamed" and name not in self.own:
            return o.named(value["fName"], value["fTitle"])
        c = self.of(name)

        def fill(x: Out):
            for m in c.members:
                if m.base:
                    self.write(m.name, value, x)
                else:
                    self.write_member(m, value[m.name], x)

        return o.object(c.version, fill)

    def write_member(self, m: Member, value, o: Out) -> None:
        code = m.code
        if POINTED <= code < POINTED + ARRAY:
            o.put("B", 1).raw(np.asarray(value, PLAIN[code - POINTED]).tobytes())
        elif ARRAY <= code < POINTED:
            o.raw(np.asarray(value, PLAIN[code - ARRAY]).tobytes())
        elif code in PLAIN:
            o.raw(np.asarray(value, PLAIN[code]).tobytes())
        elif code == STRING:
            o.string(value)
        elif m.kind == "TStreamerSTL":
            o.object(9, lambda x: self._write_stl(m.target, value, x))
        elif code in (OBJECT, ANY, OWNED, ANY_OWNED):
            self.write(m.target, value, o)
        elif code in (POINTER, ANY_POINTER):
            o.pointer(None if value is None else ("object", id(value)), m.target, lambda x: self.write(m.target, value, x))
        else:
            raise NotImplementedError(f"{m.name}: members of code {code} can't be written")

    def _write_stl(self, kind: str, value, o: Out) -> None:
        if kind == "string":
            o.string(value)
            return
        item = re.fullmatch(r"vector<(.+)>", kind)
        if not item:
            raise NotImplementedError(f"{kind} can't be written")
        o.put("i", len(value))
        for x in value:
            if item[1] in TYPES:
                o.raw(np.asarray(x, TYPES[item[1]]).tobytes())
            elif item[1] in self.own:
                self.write(item[1], x, o)
            else:
                self._write_stl(item[1], x, o)


class Entries:
    """How a column's entries are objects of a class, or a member of one; many: as many of it as the entry has room for."""

    def __init__(self, classes: Classes, name: str | None = None, member: Member | None = None, many: bool = False):
        self.classes, self.name, self.member, self.many = classes, name, member, many

    @property
    def arrow(self) -> pa.DataType:
        one = self.classes.arrow(self.name) if self.member is None else self.classes.arrow_member(self.member)
        return pa.list_(one) if self.many else one

    def decode(self, data: bytes, edges: np.ndarray) -> pa.Array:
        """edges: where each entry starts, and the end of the last."""
        if self.member is None and len(edges) > 1:
            flat, widths = self.classes.flat(self.name), np.diff(edges)
            if flat is not None and (widths == widths[0]).all() and widths[0] - flat.itemsize in (0, 6):
                own = np.dtype([_HEADER, *((n, flat[n]) for n in flat.names)]) if widths[0] > flat.itemsize else flat
                return _structs(np.frombuffer(data, own, len(widths), int(edges[0])), self.arrow)
        kind = self.arrow
        return pa.array([cell(self._one(In(data, a), z), kind) for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False)], kind)

    def _one(self, d: In, end: int):
        if self.member is None:
            return self.classes.entry(self.name, d, end)
        if not self.many:
            return self.classes.member(self.member, d, {})
        out = []
        while d.at < end:
            out.append(self.classes.member(self.member, d, {}))
        return out


def _structs(raw: np.ndarray, kind: pa.StructType) -> pa.Array:
    return pa.StructArray.from_arrays([_column(raw[f.name], f.type) for f in kind], fields=list(kind))


def _column(raw: np.ndarray, kind: pa.DataType) -> pa.Array:
    if raw.dtype.names:
        return _structs(raw, kind)
    if raw.ndim > 1:
        flat = _column(raw.reshape(-1, *raw.shape[2:]), kind.value_type)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, raw.shape[1], dtype=np.int32), flat)
    return pa.array(raw.astype(raw.dtype.newbyteorder("="))).cast(kind)


def cell(value, kind: pa.DataType):
    """A value read by a description as one of an Arrow type: unsettled ones become JSON, missing members null."""
    if value is None:
        return None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(_closed(value, ()))
    if pa.types.is_struct(kind):
        return {f.name: cell(value.get(f.name), f.type) for f in kind}
    if pa.types.is_list(kind):
        return [cell(x, kind.value_type) for x in value]
    return value


def _closed(value, above: tuple[int, ...]):
    """Objects that lead back to themselves end in their class's name."""
    if isinstance(value, dict):
        if id(value) in above:
            return {"@class": value.get("@class")}
        return {k: _closed(x, (*above, id(value))) for k, x in value.items()}
    return [_closed(x, above) for x in value] if isinstance(value, (list, tuple)) else value


# Fixed values of the format: codes and sizes of the plain members that columns of structs are written as.
_WRITTEN = {"?": (18, "bool"), "i1": (1, "char"), "i2": (2, "short"), "i4": (3, "int"), "i8": (16, "Long64_t"), "f4": (5, "float"), "f8": (8, "double")}


def described(name: str, kind: pa.StructType, version: int = 1) -> Described:
    """A description of the class that a struct type makes: plain members, texts, vectors of them, and fixed lists."""
    members = []
    for f in kind:
        t, dims = f.type, ()
        while pa.types.is_fixed_size_list(t):
            dims, t = (*dims, t.list_size), t.value_type
        if pa.types.is_string(t) and not dims:
            members.append(Member("TStreamerString", f.name, "", STRING, "TString", 24))
        elif pa.types.is_list(t) and not dims:
            item = "string" if pa.types.is_string(t.value_type) else _plain(t.value_type, f.name)[1]
            members.append(Member("TStreamerSTL", f.name, "", 300, f"vector<{item}>", 24, own=(1, 365 if item == "string" else _plain(t.value_type, f.name)[0])))
        else:
            code, type_ = _plain(t, f.name)
            length = int(np.prod(dims)) if dims else 0
            members.append(Member("TStreamerBasicType", f.name, "", code + (ARRAY if dims else 0), type_, np.dtype(PLAIN[code]).itemsize * max(1, length), length, dims))
    return Described(name, version, checksum(name, members), tuple(members))


def _plain(t: pa.DataType, name: str) -> tuple[int, str]:
    key = "?" if pa.types.is_boolean(t) else f"{'f' if pa.types.is_floating(t) else 'i'}{t.bit_width // 8}" if pa.types.is_signed_integer(t) or pa.types.is_floating(t) else ""
    if key not in _WRITTEN:
        raise NotImplementedError(f"{name}: {t} can't be a member")
    return _WRITTEN[key]
