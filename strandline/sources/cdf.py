"""Reader and writer of the classic self-describing array format (versions 1, 2 and 5), from its public
specification: big-endian header (dimensions, attributes, variables), then fixed and record data."""

from __future__ import annotations

import mmap
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

# Fixed values of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    dims: list[str]
    data: np.ndarray
    attrs: dict[str, object] = field(default_factory=dict)


@dataclass
class Dataset:
    """dims: name -> size; the record dimension is named in `unlimited`."""

    dims: dict[str, int]
    variables: dict[str, Variable]
    attrs: dict[str, object] = field(default_factory=dict)
    unlimited: str | None = None


class _In:
    def __init__(self, data: bytes) -> None:
        if data[:3] != b"CDF" or len(data) < 8 or data[3] not in (1, 2, 5):
            raise ValueError("not a classic array file (CDF-1, CDF-2 or CDF-5)")
        self.data, self.at, self.version = data, 4, data[3]

    def number(self, wide: bool) -> int:
        n = 8 if wide else 4
        if self.at + n > len(self.data):
            raise ValueError("the header is cut short")
        value = int.from_bytes(self.data[self.at : self.at + n], "big", signed=not wide)
        self.at += n
        return value

    def count(self) -> int:
        return self.number(self.version == 5)

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n + (-n) % 4
        return out

    def name(self) -> str:
        return self.raw(self.count()).decode("utf-8")

    def items(self, tag: int) -> range:
        found, n = self.number(False), self.count()
        if found not in (0, tag):
            raise ValueError("the header has an unknown list")
        return range(n)

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in self.items(ATTRIBUTE):
            name, kind = self.name(), self.number(False)
            n = self.count()
            dtype = np.dtype(TYPES[kind])
            raw = self.raw(n * dtype.itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out


def load(path: str) -> Dataset:
    """Map a file: its header is parsed, its data are views that read the disk when they are used."""
    extra = {"trackfd": False} if sys.version_info >= (3, 13) else {}  # no file stays open
    with open(path, "rb") as f:
        return read(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **extra))


def read(data: bytes | mmap.mmap, only: set[str] | None = None) -> Dataset:
    """Parse a file; the variables' data are views of `data`. `only`: the variables whose data are wanted (others get
    an empty array of their shape's type)."""
    src = _In(data)
    records = src.number(src.version == 5)
    dims = [(src.name(), src.count()) for _ in src.items(DIMENSION)]
    attrs = src.attributes()
    heads = []
    for _ in src.items(VARIABLE):
        name = src.name()
        ids = [src.count() for _ in range(src.count())]
        own = src.attributes()
        dtype, size = np.dtype(TYPES[src.number(False)]), src.count()
        heads.append((name, ids, own, dtype, size, src.number(src.version != 1)))
    unlimited = next((n for n, size in dims if size == 0), None)
    rolling = [h for h in heads if h[1] and dims[h[1][0]][1] == 0]
    padded = lambda h: int(np.prod([dims[i][1] for i in h[1][1:]], dtype=np.int64)) * h[3].itemsize
    stride = padded(rolling[0]) if len(rolling) == 1 else sum(padded(h) + (-padded(h)) % 4 for h in rolling)
    variables = {}
    for h in heads:
        name, ids, own, dtype, _, begin = h
        shape = [records if dims[i][1] == 0 else dims[i][1] for i in ids]
        if only is not None and name not in only:
            values = np.lib.stride_tricks.as_strided(np.zeros(1, dtype), shape, [0] * len(shape)) if np.prod(shape, dtype=np.int64) else np.zeros(shape, dtype)
        elif h in rolling:
            n = padded(h)
            need = begin + (records - 1) * stride + n if records else begin
            if need > len(data):
                raise ValueError(f"the data of {name} are cut short")
            within = [dtype.itemsize * int(np.prod(shape[i + 1 :], dtype=np.int64)) for i in range(1, len(shape))]
            values = np.ndarray(shape, dtype, data, begin, [stride, *within]) if n and records else np.zeros(shape, dtype)
        else:
            n = int(np.prod(shape, dtype=np.int64))
            if begin + n * dtype.itemsize > len(data):
                raise ValueError(f"the data of {name} are cut short")
            values = np.frombuffer(data, dtype, n, begin).reshape(shape) if n else np.zeros(shape, dtype)
        variables[name] = Variable([dims[i][0] for i in ids], values, own)
    return Dataset({n: records if size == 0 else size for n, size in dims}, variables, attrs, unlimited)


def _kind(dtype: np.dtype) -> int:
    for k, t in TYPES.items():
        if np.dtype(t) == dtype.newbyteorder(">") or (k == 2 and dtype.kind == "S"):
            return k
    raise ValueError(f"the format has no type for {dtype}")


def write(ds: Dataset, version: int = 5) -> bytes:
    """The bytes of a file. Types beyond the six oldest need version 5."""
    return b"".join(pieces(ds, version))


def write_to(file: BinaryIO, ds: Dataset, version: int = 5) -> None:
    """The same into an open file, a record at a time."""
    for piece in pieces(ds, version):
        file.write(piece)


def pieces(ds: Dataset, version: int = 5) -> Iterator[bytes]:
    """Header, fixed variables, then the record variables' steps: each is asked for once, when its turn comes."""
    wide = version == 5
    num = lambda n: struct.pack(">Q" if wide else ">I", n)
    pad = lambda b: b + b"\0" * ((-len(b)) % 4)
    text = lambda s: num(len(s.encode())) + pad(s.encode())

    def attributes(attrs: dict[str, object]) -> bytes:
        if not attrs:
            return struct.pack(">I", 0) + num(0)
        out = struct.pack(">I", ATTRIBUTE) + num(len(attrs))
        for name, value in attrs.items():
            if isinstance(value, str):
                out += text(name) + struct.pack(">I", 2) + num(len(value.encode())) + pad(value.encode())
            else:
                a = np.atleast_1d(np.asarray(value))
                k = _kind(a.dtype)
                out += text(name) + struct.pack(">I", k) + num(a.size) + pad(a.astype(TYPES[k]).tobytes())
        return out

    names = list(ds.dims)
    records = ds.dims.get(ds.unlimited, 0) if ds.unlimited else 0
    head = b"CDF" + bytes([version]) + num(records)
    head += struct.pack(">I", DIMENSION if names else 0) + num(len(names))
    for n in names:
        head += text(n) + num(0 if n == ds.unlimited else ds.dims[n])
    head += attributes(ds.attrs)
    parts, size_at = [], []
    for name, v in ds.variables.items():
        k = _kind(v.data.dtype)
        rolling = bool(v.dims) and v.dims[0] == ds.unlimited
        per = int(np.prod(v.data.shape[1:] if rolling else v.data.shape, dtype=np.int64)) * np.dtype(TYPES[k]).itemsize
        parts.append((text(name) + num(len(v.dims)) + b"".join(num(names.index(d)) for d in v.dims) + attributes(v.attrs) + struct.pack(">I", k), rolling, per, k, v))
        size_at.append(per)
    begin_size = 8 if version != 1 else 4
    length = len(head) + 4 + len(num(0)) + sum(len(p[0]) + len(num(0)) + begin_size for p in parts)
    rolling = [p for p in parts if p[1]]
    step = lambda per: per if len(rolling) == 1 else per + (-per) % 4
    at, begins = length, {}
    for i, p in enumerate(parts):
        if not p[1]:
            begins[i] = at
            at += p[2] + (-p[2]) % 4
    for i, p in enumerate(parts):
        if p[1]:
            begins[i] = at
            at += step(p[2])
    head += struct.pack(">I", VARIABLE if parts else 0) + num(len(parts))
    for i, p in enumerate(parts):
        head += p[0] + num(p[2] + (-p[2]) % 4) + begins[i].to_bytes(begin_size, "big")
    yield head
    for p in parts:
        if not p[1]:
            yield pad(p[4].data.astype(TYPES[p[3]]).tobytes())
    for r in range(records):
        for p in rolling:
            raw = np.asarray(p[4].data[r], TYPES[p[3]]).tobytes()
            yield raw if len(rolling) == 1 else pad(raw)
