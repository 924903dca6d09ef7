"""The parts of the HDF5 format that gridded NetCDF-4 files use, after the public format description.

Read: superblocks 0 to 3; object headers 1 and 2; links and attributes in headers, symbol tables and fractal heaps; fixed-point,
floating-point and string types; compact, contiguous and chunked data with the version 1 B-tree as chunk index; the deflate, shuffle and
fletcher32 filters.  Anything else is refused by name.  Only metadata is read here but for :meth:`Dataset.read`, which
takes a box and reads the chunks that meet it.

Written (:func:`file_head`): the oldest, checksum-free form of each of these, for files whose chunks tasks put in their own places.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
#: Message types of object headers.
SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
#: Filters.
DEFLATE, SHUFFLE, FLETCHER32 = 1, 2, 3

Box = tuple[tuple[int, int], ...]


def _ints(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


@dataclass
class Type:
    """A numpy type, or what else a value is: ``text`` (variable length), ``list`` (of ``base``), ``other``."""

    size: int
    kind: str
    base: Type | None = None


def _type(raw: bytes) -> Type:
    cls, bits, size = raw[0] & 15, raw[1], _ints(raw, 4, 4)
    order = ">" if bits & 1 else "<"
    if cls == 0:
        return Type(size, f"{order}{'i' if bits & 8 else 'u'}{size}")
    if cls == 1:
        return Type(size, f"{order}f{size}")
    if cls == 3:
        return Type(size, f"S{size}")
    if cls == 7:
        return Type(size, "<u8")
    if cls == 9:
        return Type(size, "text" if bits & 15 == 1 else "list", _type(raw[8:]))
    if cls == 8:
        return _type(raw[8:])
    return Type(size, "other")


@dataclass
class Dataset:
    """An array: shape, type, attributes, and where its data lies."""

    file: File
    address: int
    shape: tuple[int, ...]
    type: Type
    attrs: dict
    #: (layout, its parameters), chunk shape, filters in the order they were applied in, fill value
    layout: tuple = ()
    chunk: tuple[int, ...] | None = None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    fill: bytes | None = None

    def read(self, box: Box | None = None) -> np.ndarray:
        """The box as an array in native byte order; chunks that were never written hold the fill value."""
        box = box or tuple((0, n) for n in self.shape)
        kind = np.dtype(self.type.kind)
        sides = tuple(max(0, hi - lo) for lo, hi in box)
        if self.layout[0] != "chunked":
            return self._plain(box, kind).astype(kind.newbyteorder("=")).reshape(sides)
        out = np.full(sides, np.frombuffer(self.fill, kind)[0] if self.fill else np.zeros((), kind), kind)
        with open(self.file.path, "rb") as f:
            for offset, address, size, mask in self.chunks(box):
                f.seek(self.file.base + address)
                cells = np.frombuffer(self._decoded(f.read(size), mask), kind, int(np.prod(self.chunk))).reshape(self.chunk)
                inside = [(max(lo, o), min(hi, o + c)) for (lo, hi), o, c in zip(box, offset, self.chunk, strict=True)]
                to = tuple(slice(a - lo, b - lo) for (a, b), (lo, _) in zip(inside, box, strict=True))
                out[to] = cells[tuple(slice(a - o, b - o) for (a, b), o in zip(inside, offset, strict=True))]
        return out.astype(kind.newbyteorder("="))

    def _plain(self, box: Box, kind: np.dtype) -> np.ndarray:
        rest = tuple(slice(lo, hi) for lo, hi in box[1:])
        lo, hi = box[0] if box else (0, 1)
        if self.layout[0] == "compact":
            return np.frombuffer(self.layout[1], kind).reshape(self.shape or (1,))[(slice(lo, hi), *rest)]
        row = int(np.prod(self.shape[1:]))
        if self.layout[1] == UNDEFINED:
            return np.full((hi - lo, *self.shape[1:]), np.frombuffer(self.fill, kind)[0] if self.fill else 0, kind)[(slice(None), *rest)]
        # of the rows of the first dimension those of the box; of the second, too, where the first is one row
        raw = self.file.bytes(self.layout[1] + lo * row * kind.itemsize, (hi - lo) * row * kind.itemsize)
        return np.frombuffer(raw, kind).reshape(hi - lo, *self.shape[1:])[(slice(None), *rest)]

    def _decoded(self, raw: bytes, mask: int) -> bytes:
        for i in range(len(self.filters) - 1, -1, -1):
            code, values = self.filters[i]
            if mask >> i & 1:
                continue
            if code == FLETCHER32:
                raw = raw[:-4]
            elif code == DEFLATE:
                raw = zlib.decompress(raw)
            elif code == SHUFFLE:
                size = values[0] if values else self.type.size
                n = len(raw) // size
                raw = np.frombuffer(raw, np.uint8)[: n * size].reshape(size, n).T.tobytes() + raw[n * size :]
            else:
                raise ValueError(f"{self.file.path}: filter {code} is not read; deflate, shuffle and fletcher32 are")
        return raw

    def chunks(self, box: Box) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offset, address, bytes, filter mask) of the chunks that meet a box; index nodes before and after it are not read."""
        rank = len(self.shape)

        def walk(address: int) -> Iterator:
            head = self.file.bytes(address, 24)
            if head[:4] != b"TREE" or head[4] != 1:
                raise ValueError(f"{self.file.path}: no chunk index at {address}")
            level, used, step = head[5], _ints(head, 6, 2), 8 + 8 * (rank + 1)
            raw = self.file.bytes(address + 24, used * (step + 8) + step)
            keys = [tuple(_ints(raw, i * (step + 8) + 8 + 8 * d, 8) for d in range(rank)) for i in range(used + 1)]
            for i in range(used):
                at = i * (step + 8)
                child = _ints(raw, at + step, 8)
                if level:
                    # offsets ascend: those of the child lie from its key to the next
                    if keys[i][0] < box[0][1] and keys[i + 1][0] + self.chunk[0] > box[0][0]:
                        yield from walk(child)
                elif all(o < hi and o + c > lo for o, c, (lo, hi) in zip(keys[i], self.chunk, box, strict=True)):
                    yield keys[i], child, _ints(raw, at, 4), _ints(raw, at + 4, 4)

        if self.layout[1] != UNDEFINED and all(hi > lo for lo, hi in box):
            yield from walk(self.layout[1])


class File:
    """The groups and datasets of a file, by name."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._open = open(path, "rb")
        try:
            self.base = next((at for at in (0, *(512 << k for k in range(20))) if self._at(at, 8) == SIGNATURE), None)
            if self.base is None:
                raise ValueError(f"{path} is no HDF5 file")
            head = self._at(self.base, 128)
            if len(head) < 48:
                raise ValueError(f"{path} is cut short: no HDF5 superblock")
            version = head[8]
            sizes = head[13:15] if version < 2 else head[9:11]
            if version > 3 or sizes != b"\x08\x08":
                raise ValueError(f"{path}: superblock {version} with addresses of {sizes[0]} bytes is not read")
            root = _ints(head, (24 if version == 0 else 28) + 32 + 8, 8) if version < 2 else _ints(head, 12 + 24, 8)
            self.datasets, self.attrs = {}, {}
            messages = self._messages(root)
            self.attrs = self._attributes(messages)
            for name, address in self._links(messages):
                inner = self._messages(address)
                if any(t == LAYOUT for t, _ in inner):
                    self.datasets[name] = self._dataset(address, inner)
        finally:
            self._open.close()
            self._open = None

    def _at(self, place: int, size: int) -> bytes:
        self._open.seek(place)
        return self._open.read(size)

    def bytes(self, address: int, size: int) -> bytes:
        if self._open is None:
            with open(self.path, "rb") as f:
                f.seek(self.base + address)
                return f.read(size)
        return self._at(self.base + address, size)

    # -- object headers ----------------------------------------------------------------------------

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        head = self.bytes(address, 16)
        out = []
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + (16 if head[5] & 32 else 0) + (4 if head[5] & 16 else 0)
            width = 1 << (flags & 3)
            size = _ints(self.bytes(address + at, width), 0, width)
            blocks = [(address + at + width, size)]
        elif head[0] == 1:
            flags, blocks = None, [(address + 16, _ints(head, 8, 4))]
        else:
            raise ValueError(f"{self.path}: no object header at {address}")
        while blocks:
            start, size = blocks.pop(0)
            raw, at = self.bytes(start, size), 0
            step = 8 if flags is None else 6 if flags & 4 else 4
            while at + step <= len(raw):
                kind, n, marks = (_ints(raw, at, 2), _ints(raw, at + 2, 2), raw[at + 4]) if flags is None else (raw[at], _ints(raw, at + 1, 2), raw[at + 3])
                body = raw[at + step : at + step + n]
                at += step + n
                if kind == CONTINUED:
                    place, length = _ints(body, 0, 8), _ints(body, 8, 8)
                    # of version 2 between a signature and a checksum
                    blocks.append((place, length) if flags is None else (place + 4, length - 8))
                elif marks & 2 and kind in (TYPE, SPACE, FILTERS, ATTRIBUTE):
                    raise ValueError(f"{self.path}: shared messages are not read")
                elif kind:
                    out.append((kind, body))
        return out

    def _dataset(self, address: int, messages: list[tuple[int, bytes]]) -> Dataset:
        of = dict(messages)
        kind, layout = _type(of[TYPE]), of[LAYOUT]
        shape = self._space(of[SPACE])
        found = Dataset(self, address, shape, kind, self._attributes(messages))
        if layout[0] != 3:
            raise ValueError(f"{self.path}: data layout {layout[0]} (files of the newest library version only) is not read")
        if layout[1] == 0:
            found.layout = ("compact", layout[4 : 4 + _ints(layout, 2, 2)])
        elif layout[1] == 1:
            found.layout = ("contiguous", _ints(layout, 2, 8))
        else:
            found.layout = ("chunked", _ints(layout, 3, 8))
            found.chunk = tuple(_ints(layout, 11 + 4 * d, 4) for d in range(layout[2] - 1))
        found.filters = self._filters(of[FILTERS]) if FILTERS in of else []
        fill = of.get(FILL)
        if fill:
            defined, at = (fill[1] & 32, 2) if fill[0] == 3 else (fill[3], 4)
            size = _ints(fill, at, 4) if defined else 0
            found.fill = fill[at + 4 : at + 4 + size] if size == kind.size else None
        return found

    @staticmethod
    def _space(raw: bytes) -> tuple[int, ...]:
        at = 8 if raw[0] == 1 else 4
        return tuple(_ints(raw, at + 8 * d, 8) for d in range(raw[1]))

    @staticmethod
    def _filters(raw: bytes) -> list[tuple[int, list[int]]]:
        out, at, first = [], (8 if raw[0] == 1 else 2), raw[0] == 1
        for _ in range(raw[1]):
            code = _ints(raw, at, 2)
            at += 2
            name = 0
            if first or code >= 256:
                name = _ints(raw, at, 2)
                at += 2
            n = _ints(raw, at + 2, 2)
            at += 4 + (-(-name // 8) * 8 if first else name)
            out.append((code, [_ints(raw, at + 4 * i, 4) for i in range(n)]))
            at += 4 * (n + n % 2 if first else n)
        return out

    # -- attributes --------------------------------------------------------------------------------

    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict:
        raws = [body for kind, body in messages if kind == ATTRIBUTE]
        for kind, body in messages:
            if kind == ATTRIBUTE_INFO:
                at = 2 + (2 if body[1] & 1 else 0)
                raws += self._dense(_ints(body, at, 8), _ints(body, at + 8, 8), 0, 8)
        return dict(self._attribute(raw) for raw in raws)

    def _attribute(self, raw: bytes) -> tuple[str, object]:
        version = raw[0]
        sizes, at = [_ints(raw, 2 + 2 * i, 2) for i in range(3)], 9 if version == 3 else 8
        parts = []
        for n in sizes:
            parts.append(raw[at : at + n])
            at += -(-n // 8) * 8 if version == 1 else n
        name, kind, shape = parts[0].split(b"\0")[0].decode(), _type(parts[1]), self._space(parts[2])
        return name, self._value(raw[at:], kind, int(np.prod(shape, dtype=np.int64)), bool(shape))

    def _value(self, raw: bytes, kind: Type, n: int, listed: bool) -> object:
        if kind.kind == "other":
            return None
        if kind.kind in ("text", "list"):
            values = []
            for i in range(n):
                at = i * kind.size
                inner = self._heap_object(_ints(raw, at + 4, 8), _ints(raw, at + 12, 4))
                size = _ints(raw, at, 4)
                values.append(inner[:size].decode(errors="replace") if kind.kind == "text" else np.frombuffer(inner, kind.base.kind, size).tolist())
        elif kind.kind[0] == "S":
            values = [raw[i * kind.size : (i + 1) * kind.size].split(b"\0")[0].decode(errors="replace") for i in range(n)]
        else:
            values = np.frombuffer(raw, kind.kind, n).tolist()
        return values[0] if n == 1 and (not listed or kind.kind != "list") else values

    def _heap_object(self, address: int, index: int) -> bytes:
        if not address or address == UNDEFINED:
            return b""
        head = self.bytes(address, 16)
        raw, at = self.bytes(address, _ints(head, 8, 8)), 16
        while at + 16 <= len(raw):
            number, size = _ints(raw, at, 2), _ints(raw, at + 8, 8)
            if number == index:
                return raw[at + 16 : at + 16 + size]
            if number == 0:
                break
            at += 16 + -(-size // 8) * 8
        return b""

    # -- links -------------------------------------------------------------------------------------

    def _links(self, messages: list[tuple[int, bytes]]) -> list[tuple[str, int]]:
        out = []
        for kind, body in messages:
            if kind == LINK:
                out.append(self._link(body))
            elif kind == LINK_INFO:
                at = 2 + (8 if body[1] & 1 else 0)
                out += [self._link(raw) for raw in self._dense(_ints(body, at, 8), _ints(body, at + 8, 8), 4, 7)]
            elif kind == SYMBOLS:
                heap = self.bytes(_ints(body, 8, 8), 32)
                names = self.bytes(_ints(heap, 24, 8), _ints(heap, 8, 8))
                out += [(names[at : names.index(b"\0", at)].decode(), address) for at, address in self._symbols(_ints(body, 0, 8))]
        return [link for link in out if link[1] is not None]

    @staticmethod
    def _link(raw: bytes) -> tuple[str, int | None]:
        flags, at, kind = raw[1], 2, 0
        if flags & 8:
            kind, at = raw[at], at + 1
        at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n, at = _ints(raw, at, width), at + width
        # soft and external links point to what has a place of its own
        return raw[at : at + n].decode(), _ints(raw, at + n, 8) if kind == 0 else None

    def _symbols(self, address: int) -> Iterator[tuple[int, int]]:
        head = self.bytes(address, 24)
        used = _ints(head, 6, 2)
        raw = self.bytes(address + 24, used * 16 + 8)
        for i in range(used):
            child = _ints(raw, 8 + 16 * i, 8)
            if head[5]:
                yield from self._symbols(child)
                continue
            n = _ints(self.bytes(child, 8), 6, 2)
            entries = self.bytes(child + 8, 40 * n)
            yield from ((_ints(entries, 40 * k, 8), _ints(entries, 40 * k + 8, 8)) for k in range(n))

    # -- fractal heaps -----------------------------------------------------------------------------

    def _dense(self, heap: int, tree: int, skip: int, length: int) -> list[bytes]:
        """The objects of a fractal heap that a version 2 B-tree names: heap ids stand after ``skip`` bytes of its records."""
        if heap == UNDEFINED or tree == UNDEFINED:
            return []
        head = self.bytes(heap, 142)
        # flags, limits and the doubling table
        largest, width, start, most, bits = _ints(head, 10, 4), _ints(head, 110, 2), _ints(head, 112, 8), _ints(head, 120, 8), _ints(head, 128, 2)
        root, rows = _ints(head, 132, 8), _ints(head, 140, 2)
        if _ints(head, 7, 2):
            raise ValueError(f"{self.path}: filtered heaps are not read")
        wide = -(-bits // 8)
        counted = min((most.bit_length() - 1) // 8 + 1, (largest.bit_length() + 6) // 8)
        direct = {}

        def block(address: int, rows: int) -> None:
            if address == UNDEFINED:
                return
            if rows == 0:
                raw = self.bytes(address, 13 + wide)
                direct[_ints(raw, 13, wide)] = address
                return
            raw, at, size = self.bytes(address, 13 + wide + rows * width * 8), 13 + wide, start
            for row in range(rows):
                size = start if row < 2 else start << (row - 1)
                for _ in range(width):
                    # a row of blocks beyond the largest direct one is one of indirect blocks
                    block(_ints(raw, at, 8), 0 if size <= most else (size // start // width).bit_length())
                    at += 8

        block(root, rows)
        starts = sorted(direct)
        out = []
        for record in self._records(tree):
            key = record[skip : skip + length]
            if key[0] >> 4 & 3 == 2:
                out.append(key[1 : 2 + (key[0] & 15)])
                continue
            if key[0] >> 4 & 3:
                raise ValueError(f"{self.path}: huge heap objects are not read")
            offset, size = _ints(key, 1, wide), _ints(key, 1 + wide, counted)
            own = starts[np.searchsorted(starts, offset, "right") - 1]
            out.append(self.bytes(direct[own] + offset - own, size))
        return out

    def _records(self, tree: int) -> Iterator[bytes]:
        head = self.bytes(tree, 38)
        node, size, depth = _ints(head, 6, 4), _ints(head, 10, 2), _ints(head, 12, 2)
        fits = [(node - 10) // size]
        own = -(-fits[0].bit_length() // 8)
        total = [0]
        for level in range(1, depth + 1):
            pointer = 8 + own + total[level - 1]
            fits.append((node - 10 - pointer) // (size + pointer))
            total.append(-(-((fits[level] + 1) * fits[0]).bit_length() // 8))

        def walk(address: int, n: int, level: int) -> Iterator[bytes]:
            raw = self.bytes(address, node)
            yield from (raw[6 + size * i : 6 + size * (i + 1)] for i in range(n))
            at = 6 + size * n
            for _ in range(n + 1 if level else 0):
                yield from walk(_ints(raw, at, 8), _ints(raw, at + 8, own), level - 1)
                at += 8 + own + (total[level - 1] if level > 1 else 0)

        if _ints(head, 16, 8) != UNDEFINED:
            yield from walk(_ints(head, 16, 8), _ints(head, 24, 2), depth)


# -- writing ---------------------------------------------------------------------------------------

#: A double and a 32-bit integer, little-endian, as datatype messages.
DOUBLE = bytes([0x11, 0x20, 0x3F, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)
INT32 = bytes([0x10, 0x08, 0, 0]) + struct.pack("<IHH", 4, 0, 32)
#: Children of a node of a group's index, entries of a symbol table, children of a node of a chunk index.
GROUP_NODE, SYMBOL_NODE, CHUNK_NODE = 32, 32, 64


@dataclass
class Spec:
    """A dataset to be written: with its doubles (``data``), or in chunks whose index comes later."""

    name: str
    dims: list[str]
    shape: tuple[int, ...]
    attrs: dict
    data: np.ndarray | None = None
    chunk: tuple[int, ...] | None = None
    level: int = 4
    fill: float | None = None


def _eight(raw: bytes) -> bytes:
    return raw.ljust(-(-len(raw) // 8) * 8, b"\0")


def _message(kind: int, body: bytes) -> bytes:
    body = _eight(body)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _shape(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


def _attribute_message(name: str, value: object) -> bytes:
    shape: tuple[int, ...] = ()
    if isinstance(value, str):
        raw = value.encode() + b"\0"
        kind = bytes([0x13, 0 if value.isascii() else 0x10, 0, 0]) + struct.pack("<I", len(raw))
    elif isinstance(value, bytes):  # references to dimensions, as they lie in a heap
        kind, raw, shape = bytes([0x19, 0, 0, 0]) + struct.pack("<I", 16) + bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8), value, (len(value) // 16,)
    elif isinstance(value, int):
        kind, raw = INT32, struct.pack("<i", value)
    else:
        values = np.atleast_1d(np.asarray(value, "<f8"))
        kind, raw, shape = DOUBLE, values.tobytes(), (() if np.ndim(value) == 0 else values.shape)
    key, space = name.encode() + b"\0", _shape(shape)
    return _message(ATTRIBUTE, struct.pack("<BxHHH", 1, len(key), len(kind), len(space)) + _eight(key) + _eight(kind) + _eight(space) + raw)


def _header(messages: list[bytes]) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def chunk_index(entries: list[tuple[tuple[int, ...], int, int, int]], shape: tuple[int, ...], chunk: tuple[int, ...], place: int) -> bytes:
    """The B-tree of (offset, address, stored bytes, filter mask), its root first, at ``place``."""
    rank = len(shape)
    step = 8 + 8 * (rank + 1)
    size = 24 + CHUNK_NODE * (step + 8) + step
    key = lambda offset, stored=0, mask=0: struct.pack(f"<II{rank + 1}Q", stored, mask, *offset, 0)
    beyond = key(tuple(-(-n // c) * c for n, c in zip(shape, chunk, strict=True)))
    levels = [[(key(o, stored, mask), address) for o, address, stored, mask in sorted(entries)]]
    while len(levels[-1]) > CHUNK_NODE:
        levels.append([(levels[-1][i][0], None) for i in range(0, len(levels[-1]), CHUNK_NODE)])
    # the root is first, then level after level down
    counts = [max(1, -(-len(level) // CHUNK_NODE)) for level in levels]
    first = {len(levels) - 1: 0}
    for k in range(len(levels) - 2, -1, -1):
        first[k] = first[k + 1] + counts[k + 1]
    out = []
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        at = lambda i: place + (first[k] + i) * size if 0 <= i < counts[k] else UNDEFINED  # noqa: B023, E731
        for i in range(counts[k]):
            own = level[i * CHUNK_NODE : (i + 1) * CHUNK_NODE]
            body = b"".join(raw + struct.pack("<Q", address if k == 0 else place + (first[k - 1] + i * CHUNK_NODE + j) * size) for j, (raw, address) in enumerate(own))
            after = level[(i + 1) * CHUNK_NODE][0] if (i + 1) * CHUNK_NODE < len(level) else beyond
            out.append((b"TREE" + struct.pack("<BBHQQ", 1, k, len(own), at(i - 1), at(i + 1)) + body + after).ljust(size, b"\0"))
    return b"".join(out)


def index_size(shape: tuple[int, ...], chunk: tuple[int, ...]) -> int:
    """Bytes of the index of all chunks."""
    n = int(np.prod([-(-s // c) for s, c in zip(shape, chunk, strict=True)]))
    nodes = 0
    while True:
        n = max(1, -(-n // CHUNK_NODE))
        nodes += n
        if n == 1:
            return nodes * (24 + CHUNK_NODE * (8 * (len(shape) + 2) + 8) + 8 * (len(shape) + 2))


def file_head(specs: list[Spec], attrs: dict) -> tuple[bytes, dict[str, int], int]:
    """Everything but chunks and their indexes: (bytes, where each chunk index belongs, where chunks may begin).

    Dimensions are datasets of their own names (scales); a dimension without values gets an empty one.
    """
    names = {s.name for s in specs}
    length = {d: n for s in specs for d, n in zip(s.dims, s.shape, strict=True)}
    bare = "This is a netCDF dimension without a variable. Often its length is %10d"
    every = sorted([*specs, *(Spec(d, [d], (n,), {"NAME": bare % n}, np.zeros(n)) for d, n in length.items() if d not in names)], key=lambda s: s.name)
    number = {d: i for i, d in enumerate(length)}
    spots: dict[str, int] = {}

    def lay_out(addresses: dict[str, int]) -> tuple[bytes, int]:
        parts: list[bytes] = []
        spot = lambda: sum(map(len, parts))

        def put(name: str, raw: bytes) -> None:
            spots[name] = spot()
            parts.append(_eight(raw))

        at = lambda name: addresses.get(name, 0)
        put("super", SIGNATURE + struct.pack("<3Bx3BxHHI4Q2QI4x2Q", 0, 0, 0, 0, 8, 8, SYMBOL_NODE // 2, GROUP_NODE // 2, 0, 0, UNDEFINED, at("end"), UNDEFINED, 0, at("root"), 1, at("tree"), at("heap")))
        put("root", _header([_message(SYMBOLS, struct.pack("<QQ", at("tree"), at("heap"))), *(_attribute_message(k, v) for k, v in attrs.items())]))
        offsets, words = [], b"\0" * 8
        for s in every:
            offsets.append(len(words))
            words += _eight(s.name.encode() + b"\0")
        put("tree", (b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, at("symbols"), offsets[-1])).ljust(24 + GROUP_NODE * 16 + 8, b"\0"))
        put("symbols", (b"SNOD" + struct.pack("<BxH", 1, len(every)) + b"".join(struct.pack("<QQII16x", o, at("head " + s.name), 0, 0) for o, s in zip(offsets, every, strict=True))).ljust(8 + SYMBOL_NODE * 40, b"\0"))
        put("heap", b"HEAP" + struct.pack("<B3xQQQ", 0, len(words), 1, at("words")))
        put("words", words)
        refs = b"".join(struct.pack("<HHIQQ", i + 1, 1, 0, 8, at("head " + d)) for d, i in number.items())
        room = max(4096, 16 + len(refs) + 16)
        put("refs", b"GCOL" + struct.pack("<B3xQ", 1, room) + (refs + struct.pack("<HHIQ", 0, 0, 0, room - 16 - len(refs))).ljust(room - 16, b"\0"))
        for s in every:
            own = dict(s.attrs)
            if s.dims == [s.name]:
                own = {"CLASS": "DIMENSION_SCALE", "NAME": s.name, **own, "_Netcdf4Dimid": number[s.name]}
            else:
                own["DIMENSION_LIST"] = b"".join(struct.pack("<IQI", 1, at("refs"), number[d] + 1) for d in s.dims)
            messages = [_message(SPACE, _shape(s.shape)), _message(TYPE, DOUBLE)]
            messages.append(_message(FILL, struct.pack("<BBBB", 2, 3 if s.chunk else 2, 2, 1) + (struct.pack("<Id", 8, s.fill) if s.fill is not None else struct.pack("<I", 0))))
            if s.chunk:
                messages.append(_message(LAYOUT, struct.pack(f"<BBBQ{len(s.chunk) + 1}I", 3, 2, len(s.chunk) + 1, at("index " + s.name), *s.chunk, 8)))
                messages.append(_message(FILTERS, struct.pack("<BB6xHHHHI4xHHHHI4x", 1, 2, SHUFFLE, 0, 1, 1, 8, DEFLATE, 0, 1, 1, s.level)))
            else:
                messages.append(_message(LAYOUT, struct.pack("<BBQQ", 3, 1, at("data " + s.name), s.data.size * 8)))
            put("head " + s.name, _header(messages + [_attribute_message(k, v) for k, v in own.items()]))
        for s in every:
            if s.data is not None:
                put("data " + s.name, s.data.astype("<f8").tobytes())
        end = spot()
        for s in every:
            if s.chunk:
                spots["index " + s.name] = end
                end += index_size(s.shape, s.chunk)
        return b"".join(parts), end

    if len(every) > SYMBOL_NODE:
        raise ValueError("too many variables for one symbol table")
    lay_out({})
    last = max(spots["index " + s.name] + index_size(s.shape, s.chunk) for s in every if s.chunk)
    chunks = sum(int(np.prod([-(-n // c) for n, c in zip(s.shape, s.chunk, strict=True)]) * np.prod(s.chunk)) * 8 for s in every if s.chunk)
    head, _ = lay_out({**spots, "end": last + chunks})
    return head, {s.name: spots["index " + s.name] for s in every if s.chunk}, last
