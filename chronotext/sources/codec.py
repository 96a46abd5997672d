"""MessagePack in plain Python (the published format), and fitting decoded values to a schema."""

from __future__ import annotations

import struct

from pyspark.sql import types as T


def dumps(x) -> bytes:
    out = bytearray()
    _put(x, out)
    return bytes(out)


def _head(n: int, out: bytearray, fix: int | None, most: int, codes: dict[str, int]) -> None:
    if fix is not None and n <= most:
        out.append(fix | n)
        return
    for kind, size in (("B", 8), ("H", 16), ("I", 32)):
        if kind in codes and n < 1 << size:
            out.append(codes[kind])
            out.extend(struct.pack(">" + kind, n))
            return
    raise ValueError("too long")


def _put(x, out: bytearray) -> None:
    if x is None:
        out.append(0xC0)
    elif isinstance(x, bool):
        out.append(0xC3 if x else 0xC2)
    elif isinstance(x, int):
        if 0 <= x < 128:
            out.append(x)
        elif -32 <= x < 0:
            out.append(x & 0xFF)
        elif x >= 0:
            code, kind = next(c for c in ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")) if x < 1 << 8 * struct.calcsize(c[1]))
            out.append(code)
            out.extend(struct.pack(">" + kind, x))
        else:
            code, kind = next(c for c in ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")) if x >= -(1 << 8 * struct.calcsize(c[1]) - 1))
            out.append(code)
            out.extend(struct.pack(">" + kind, x))
    elif isinstance(x, float):
        out.append(0xCB)
        out.extend(struct.pack(">d", x))
    elif isinstance(x, str):
        b = x.encode()
        _head(len(b), out, 0xA0, 31, {"B": 0xD9, "H": 0xDA, "I": 0xDB})
        out.extend(b)
    elif isinstance(x, (bytes, bytearray)):
        _head(len(x), out, None, 0, {"B": 0xC4, "H": 0xC5, "I": 0xC6})
        out.extend(x)
    elif isinstance(x, (list, tuple)):
        _head(len(x), out, 0x90, 15, {"H": 0xDC, "I": 0xDD})
        for v in x:
            _put(v, out)
    elif isinstance(x, dict):
        _head(len(x), out, 0x80, 15, {"H": 0xDE, "I": 0xDF})
        for k, v in x.items():
            _put(k, out)
            _put(v, out)
    else:
        raise TypeError(f"can't encode {type(x).__name__}")


def loads(data: bytes):
    value, end = _get(memoryview(data), 0)
    if end != len(data):
        raise ValueError("bytes after the end")
    return value


_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
_SIZED = {0xD9: ("B", "s"), 0xDA: ("H", "s"), 0xDB: ("I", "s"), 0xC4: ("B", "b"), 0xC5: ("H", "b"), 0xC6: ("I", "b"), 0xDC: ("H", "l"), 0xDD: ("I", "l"), 0xDE: ("H", "m"), 0xDF: ("I", "m")}


def _get(b: memoryview, i: int):
    c = b[i]
    i += 1
    if c < 0x80:
        return c, i
    if c >= 0xE0:
        return c - 256, i
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], i
    if c in _NUMBERS:
        n = struct.calcsize(_NUMBERS[c])
        return struct.unpack(">" + _NUMBERS[c], b[i : i + n])[0], i + n
    if c in _SIZED:
        kind, what = _SIZED[c]
        n = struct.calcsize(kind)
        size = struct.unpack(">" + kind, b[i : i + n])[0]
        i += n
    elif c < 0x90:
        size, what = c & 0x0F, "m"
    elif c < 0xA0:
        size, what = c & 0x0F, "l"
    elif c < 0xC0:
        size, what = c & 0x1F, "s"
    else:
        raise ValueError(f"unknown byte {c:#x}")
    if what in "sb":
        if i + size > len(b):
            raise ValueError("cut short")
        raw = bytes(b[i : i + size])
        return (raw.decode() if what == "s" else raw), i + size
    if what == "l":
        out = []
        for _ in range(size):
            v, i = _get(b, i)
            out.append(v)
        return out, i
    table = {}
    for _ in range(size):
        k, i = _get(b, i)
        table[k], i = _get(b, i)
    return table, i


def fit(x, kind: T.DataType):
    """A decoded value in the shape of a Spark type: missing fields are null, numbers become strings where strings are asked for."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: fit(x.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [fit(v, kind.elementType) for v in x]
    if isinstance(kind, T.MapType):
        return [(str(k), fit(v, kind.valueType)) for k, v in x.items()]
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else str(x)
    if isinstance(kind, T.DoubleType):
        return float(x)
    return int(x)
