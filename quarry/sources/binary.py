"""Big-endian buffers of the file format."""

from __future__ import annotations

import struct

COUNTED, NEW_CLASS, CLASS_MASK = 0x40000000, 0xFFFFFFFF, 0x80000000


class In:
    """Reads fields from bytes; refs: objects and class names seen, by place (origin added)."""

    def __init__(self, data: bytes, at: int = 0, origin: int = 0, refs: dict | None = None):
        self.data, self.at, self.origin, self.refs = data, at, origin, {} if refs is None else refs

    def take(self, form: str):
        got = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return got if len(got) > 1 else got[0]

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def string(self) -> str:
        n = self.data[self.at]
        self.at += 1
        if n == 255:
            n = self.take("I")
        return self.bytes(n).decode("utf-8", "surrogateescape")

    def cstring(self) -> str:
        end = self.data.index(0, self.at)
        got = self.data[self.at : end].decode()
        self.at = end + 1
        return got

    def header(self) -> tuple[int, int | None]:
        """Version of the object here, and where it ends if that is known."""
        n = self.take("I")
        if n & COUNTED:
            return self.take("H"), self.at - 2 + (n & ~COUNTED)
        self.at -= 4
        return self.take("H"), None

    def skip(self) -> None:
        """Steps over an object that has its length."""
        _, end = self.header()
        if end is None:
            raise ValueError("an object without a length can't be skipped")
        self.at = end

    def base_object(self) -> None:
        version = self.take("H")
        if version & (COUNTED >> 16):
            self.at += 4
        _, flags = self.take("II")
        if flags & 0x10:
            self.at += 2

    def named(self) -> tuple[str, str]:
        _, end = self.header()
        self.base_object()
        got = self.string(), self.string()
        self.at = end if end is not None else self.at
        return got

    def pointer(self, read):
        """An object behind a pointer: read(class name, self, end, note), None of a null, or one seen before."""
        start = self.at
        n = self.take("I")
        if n & COUNTED and n != NEW_CLASS:
            end, tag, first = start + 4 + (n & ~COUNTED), self.take("I"), start + 4
        else:
            end, tag, first = None, n, start
        if not tag & CLASS_MASK:
            return None if tag == 0 else self.refs.get(tag)
        if tag == NEW_CLASS:
            name = self.cstring()
            self.refs[first + self.origin + 2] = name
        else:
            name = self.refs.get(tag & ~CLASS_MASK)
        place = start + self.origin + 2
        got = read(name, self, end, lambda x: self.refs.__setitem__(place, x))
        self.refs[place] = got
        if end is not None:
            self.at = end
        return got

    def objects(self, read) -> list:
        """An object array."""
        _, end = self.header()
        self.base_object()
        self.string()
        n, _ = self.take("ii")
        got = [self.pointer(read) for _ in range(n)]
        self.at = end if end is not None else self.at
        return got


class Out:
    """Builds a buffer; places of classes and objects are noted for later pointers."""

    def __init__(self, origin: int = 0):
        self.parts, self.n, self.origin, self.seen = bytearray(), 0, origin, {}

    def put(self, form: str, *values) -> Out:
        self.parts += struct.pack(">" + form, *values)
        return self

    def raw(self, data: bytes) -> Out:
        self.parts += data
        return self

    def string(self, text: str) -> Out:
        raw = text.encode("utf-8", "surrogateescape")
        return self.raw((bytes([len(raw)]) if len(raw) < 255 else b"\xff" + struct.pack(">I", len(raw))) + raw)

    def object(self, version: int, fill) -> Out:
        """An object with its length and version before it."""
        at = len(self.parts)
        self.put("IH", 0, version)
        fill(self)
        struct.pack_into(">I", self.parts, at, COUNTED | (len(self.parts) - at - 4))
        return self

    def base_object(self, flags: int = 0x03000000) -> Out:
        return self.put("HII", 1, 0, flags)

    def named(self, name: str, title: str) -> Out:
        return self.object(1, lambda o: o.base_object().string(name).string(title))

    def pointer(self, key, cls: str | None = None, fill=None) -> Out:
        """A null (key None), a pointer to an object written before, or the object itself."""
        if key is None:
            return self.put("I", 0)
        if key in self.seen:
            return self.put("I", self.seen[key])
        at = len(self.parts)
        self.seen[key] = at + self.origin + 2
        self.put("I", 0)
        if cls in self.seen:
            self.put("I", CLASS_MASK | self.seen[cls])
        else:
            self.seen[cls] = len(self.parts) + self.origin + 2
            self.put("I", NEW_CLASS).raw(cls.encode() + b"\0")
        fill(self)
        struct.pack_into(">I", self.parts, at, COUNTED | (len(self.parts) - at - 4))
        return self

    def objects(self, items: list) -> Out:
        """An object array of (key, class, fill)."""

        def fill(o: Out):
            o.base_object().string("").put("ii", len(items), 0)
            for key, cls, own in items:
                o.pointer(key, cls, own)

        return self.object(3, fill)
