"""The TIFF 6.0, BigTIFF and GeoTIFF formats, on the bytes of one file or on ranges of them.

Strips, tiles, both byte orders, both planar layouts, no compression, LZW and deflate are read, with the horizontal and
the floating point predictor. Of a file that is read by ranges only the header and the parts that are asked for are
fetched; parts that were unpacked are kept while they fit, so that windows next to one another share them.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from itertools import chain
from typing import Protocol

import numpy as np

from ..errors import InvalidImage

#: Field types as (code, bytes), and tags by name.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEOKEYS, NODATA, RPC_TAG = 33550, 33922, 34264, 34735, 42113, 50844


#: Codes of LZW that clear the table and end the data; the table's first free place, and how many codes fit behind a clear code.
CLEAR, END, FREE, MOST = 256, 257, 258, 3836


def _widths(n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: they widen one code early."""
    return np.digitize(np.arange(n), [254, 766, 1790]) + 9


SCHEDULE = _widths(MOST + 4)


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW. Where codes lie depends on their number after a clear code alone, so they are cut out many at a time."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    ends, out, at, last = np.cumsum(SCHEDULE), [], 0, len(data) * 8
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    while at < last:
        n = int(np.searchsorted(ends, last - at, "right"))
        width = SCHEDULE[:n]
        place = at + ends[:n] - width
        byte = place >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (place & 7) - width) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        k = int(stop[0]) if len(stop) else n
        table, prev = first.copy(), b""
        for code in codes[:k].tolist():
            entry = table[code] if code < len(table) else prev + prev[:1]
            out.append(entry)
            if prev:
                table.append(prev + entry[:1])
            prev = entry
        if k == n or codes[k] == END:
            break
        at += int(ends[k])
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """The inverse of unlzw()."""
    codes, table, seen, free = [CLEAR], {}, -1, FREE
    for b in data:
        if seen < 0:
            seen = b
            continue
        key = seen << 8 | b
        code = table.get(key)
        if code is not None:
            seen = code
            continue
        codes.append(seen)
        table[key] = free
        free += 1
        if free == FREE + MOST:
            codes.append(CLEAR)
            table, free = {}, FREE
        seen = b
    codes += [seen, END] if seen >= 0 else [END]
    c = np.array(codes)
    i = np.arange(len(c))
    before = np.maximum.accumulate(np.where(c == CLEAR, i, 0))
    width = SCHEDULE[np.where(i > 0, i - np.concatenate([[0], before[:-1]]) - 1, 0)]
    ends = np.cumsum(width)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(12):
        on = width > k
        bits[ends[on] - 1 - k] = c[on] >> k & 1
    return np.packbits(bits).tobytes()


class Bytes(Protocol):
    """What a file is read from: its length, and slices of it."""

    def __len__(self) -> int: ...

    def __getitem__(self, part: slice) -> bytes: ...


#: Bytes of unpacked parts that are kept.
KEPT = 64 << 20


class Tiff:
    """The first image of a file."""

    def __init__(self, data: Bytes):
        self.data = data
        head = data[0:16]
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(self.order + "H", head, 2)[0] if self.order and len(head) >= 8 else 0
        if magic not in (42, 43) or (magic == 43 and len(head) < 16):
            raise InvalidImage("not a TIFF file")
        # Counts and places are wider in the big format.
        count, place, entry = ("H", "I", 12) if magic == 42 else ("Q", "Q", 20)
        inline = struct.calcsize(place)
        at = struct.unpack_from(self.order + place, head, 4 if magic == 42 else 8)[0]
        self.tags: dict[int, tuple] = {}
        n = struct.calcsize(self.order + count)
        fields = self._at(count, at)[0]
        table = data[at + n : at + n + entry * fields]
        for k in range(fields):
            tag, kind, size = struct.unpack_from(self.order + "HH" + place, table, entry * k)
            if kind not in TYPES:
                continue
            code, width = TYPES[kind]
            own = table[entry * (k + 1) - inline : entry * (k + 1)]
            raw = own if width * size <= inline else data[(where := struct.unpack(self.order + place, own)[0]) : where + width * size]
            self.tags[tag] = (raw[:size],) if code == "s" else struct.unpack_from(f"{self.order}{size * len(code)}{code[0]}", raw)
        get = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = get(WIDTH), get(HEIGHT), get(SAMPLES, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(get(FORMAT, 1))
        if not self.width or not self.height or kind is None or get(BITS, 1) % 8:
            raise InvalidImage("unsupported samples")
        self.dtype = np.dtype(f"{self.order}{kind}{get(BITS, 8) // 8}")
        self.compression, self.planar, self.predictor = get(COMPRESSION, 1), get(PLANAR, 1), get(PREDICTOR, 1)
        if self.predictor not in (1, 2, 3) or (self.predictor == 3 and kind != "f"):
            raise InvalidImage(f"unsupported predictor: {self.predictor}")
        self.tiled = TILE_W in self.tags
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.kept_bytes = 0
        self.block = (get(TILE_H), get(TILE_W)) if self.tiled else (min(get(ROWS, self.height), self.height), self.width)

    def _at(self, code: str, at: int) -> tuple:
        size = struct.calcsize(self.order + code)
        return struct.unpack(self.order + code, self.data[at : at + size])

    def transform(self) -> tuple[float, ...]:
        """a, b, c, d, e, f."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0

    def crs(self) -> str | None:
        found = dict(self.geokeys())
        code = found.get(3072) or found.get(2048)
        return f"EPSG:{code}" if code and code != 32767 else None

    def geokeys(self) -> list[tuple[int, int]]:
        """The geographic keys whose values are in the directory itself."""
        keys = self.tags.get(GEOKEYS, ())
        return [(keys[i], keys[i + 3]) for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0]

    def nodata(self) -> str | None:
        text = self.tags.get(NODATA, (b"",))[0].split(b"\0")[0].decode("ascii", "replace").strip()
        return text or None

    def _floats(self, raw: bytes, bands: int) -> np.ndarray:
        """Undoes the floating point predictor: byte differences along a row, whose bytes lie in planes, the highest first."""
        n, size = self.block[1] * bands, self.dtype.itemsize
        rows = len(raw) // (n * size)
        a = np.frombuffer(raw, np.uint8)[: rows * n * size].reshape(rows, n * size // bands, bands)
        planes = np.cumsum(a, axis=1, dtype=np.uint8).reshape(rows, size, n)
        big = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}")
        return big.reshape(rows, self.block[1], bands).astype(self.dtype)

    def _part(self, index: int) -> np.ndarray:
        if index in self.kept:
            self.kept.move_to_end(index)
            return self.kept[index]
        part = self.kept[index] = self._unpacked(index)
        self.kept_bytes += part.nbytes
        while self.kept_bytes > KEPT and len(self.kept) > 1:
            self.kept_bytes -= self.kept.popitem(last=False)[1].nbytes
        return part

    def _unpacked(self, index: int) -> np.ndarray:
        offsets, counts = (self.tags[t] for t in ((TILE_OFFSETS, TILE_COUNTS) if self.tiled else (OFFSETS, COUNTS)))
        if not counts[index]:  # a part that was never written stands for zeros
            return np.zeros((*self.block, self.bands if self.planar == 1 else 1), self.dtype)
        raw = self.data[offsets[index] : offsets[index] + counts[index]]
        if self.compression == 5:
            raw = unlzw(raw)
        elif self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression != 1:
            raise InvalidImage(f"unsupported compression: {self.compression}")
        bands = self.bands if self.planar == 1 else 1
        if self.predictor == 3:
            return self._floats(raw, bands)
        a = np.frombuffer(raw, self.dtype)
        a = a[: len(a) // (self.block[1] * bands) * self.block[1] * bands].reshape(-1, self.block[1], bands)
        return np.cumsum(a, axis=1, dtype=self.dtype) if self.predictor == 2 else a

    def read(self, row: int, col: int, height: int, width: int, bands: list[int] | None = None) -> np.ndarray:
        """(bands, height, width) of a window; only the parts that it touches are unpacked."""
        bands = list(range(self.bands)) if bands is None else bands
        out = np.zeros((len(bands), height, width), self.dtype.newbyteorder("="))
        bh, bw = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        for r in range(row // bh, min(down, -(-(row + height) // bh))):
            for c in range(col // bw, min(across, -(-(col + width) // bw))):
                y0, x0 = max(row, r * bh), max(col, c * bw)
                y1, x1 = min(row + height, (r + 1) * bh, self.height), min(col + width, (c + 1) * bw, self.width)
                parts = {0: self._part(r * across + c)} if self.planar == 1 else {b: self._part((b * down + r) * across + c) for b in bands}
                for k, b in enumerate(bands):
                    a = parts[0][:, :, b] if self.planar == 1 else parts[b][:, :, 0]
                    out[k, y0 - row : y1 - row, x0 - col : x1 - col] = a[y0 - r * bh : y1 - r * bh, x0 - c * bw : x1 - c * bw]
        return out


#: Ranges of codes of systems in degrees, and of the projected ones that lie inside.
DEGREES = ((4001, 4490), (4555, 4977), (4979, 4979))
PROJECTED = ((4026, 4026), (4037, 4038), (4048, 4051), (4056, 4063), (4071, 4071), (4082, 4083), (4087, 4088), (4093, 4096), (4217, 4217), (4390, 4399), (4400, 4462), (4467, 4467), (4471, 4471), (4484, 4489), (4559, 4559), (4568, 4589), (4647, 4647), (4652, 4656), (4766, 4800), (4822, 4822), (4826, 4826), (4839, 4839), (4855, 4880))


def geographic(epsg: int) -> bool:
    """Whether a code is of degrees, by the ranges that the register keeps for them. A file's own keys say so for sure."""
    within = lambda ranges: any(a <= epsg <= b for a, b in ranges)
    return within(DEGREES) and not within(PROJECTED)


def geokeys_of(crs: str | None) -> list[tuple[int, int]]:
    """Keys for a code: the kind of model, pixels as areas, the system."""
    epsg = int(crs.split(":")[1]) if crs and crs.upper().startswith("EPSG:") else None
    degrees = epsg is not None and geographic(epsg)
    return [(1024, 2 if degrees else 1), (1025, 1)] + ([(2048 if degrees else 3072, epsg)] if epsg else [])


PACKERS = {"lzw": (5, lzw), "deflate": (8, zlib.compress), None: (1, bytes)}
UNITS = {"u": 1, "i": 2, "f": 3}


def _tags(bands: int, height: int, width: int, dtype: np.dtype, transform: tuple[float, ...], compress: str | None, nodata: str | None, keys: list[tuple[int, int]]) -> list[tuple]:
    """What strips and tiles have in common, as (tag, type, values)."""
    ta, tb, tc, td, te, tf = transform
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [dtype.itemsize * 8] * bands), (COMPRESSION, 3, [PACKERS[compress][0]]), (PHOTOMETRIC, 3, [2 if bands >= 3 else 1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]), (FORMAT, 3, [UNITS[dtype.kind]] * bands)]
    if bands > 3:
        fields.append((338, 3, [0] * (bands - 3)))
    fields += [(SCALE, 12, [ta, -te, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, tc, tf, 0.0])] if not tb and not td else [(TRANSFORM, 12, [ta, tb, 0.0, tc, td, te, 0.0, tf, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    fields.append((GEOKEYS, 3, [1, 1, 0, len(keys), *chain.from_iterable((k, 0, 1, v) for k, v in keys)]))
    if nodata:
        fields.append((NODATA, 2, nodata.encode("ascii") + b"\0"))
    return fields


def directory(fields: list[tuple], at: int, big: bool = False, placed: dict[int, int] = {}) -> bytes:  # noqa: B006
    """An image's directory that begins at a place; placed: where the values of tags lie that are written elsewhere, given by their number in fields."""
    count, place, inline = ("Q", "Q", 8) if big else ("H", "I", 4)
    end, head, tail = at + struct.calcsize("<" + count) + (20 if big else 12) * len(fields) + inline, b"", b""
    for tag, t, values in sorted(fields, key=lambda f: f[0]):
        n = values if tag in placed else len(values)
        raw = struct.pack("<" + place, placed[tag]) if tag in placed else values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[t][0]}", *values)
        head += struct.pack("<HH" + place, tag, t, n) + (raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + place, end + len(tail)))
        tail += raw + b"\0" * (-len(raw) % 8) if len(raw) > inline else b""
    return struct.pack("<" + count, len(fields)) + head + b"\0" * inline + tail


def opening(at: int, big: bool = False) -> bytes:
    """A file's first bytes, which name its directory's place."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)


def encode(a: np.ndarray, transform: tuple[float, ...], crs: str | None, compress: bool = True, rows: int = 64, nodata: str | None = None, geokeys: list[tuple[int, int]] | None = None) -> bytes:
    """A GeoTIFF of (bands, height, width), pixel-interleaved, in LZW strips."""
    bands, height, width = a.shape
    a = np.ascontiguousarray(a.transpose(1, 2, 0)).astype(a.dtype.newbyteorder("<"))
    kind = "lzw" if compress else None
    strips = [PACKERS[kind][1](a[r : r + rows].tobytes()) for r in range(0, height, rows)]
    sizes = [len(s) for s in strips]
    fields = _tags(bands, height, width, a.dtype, transform, kind, nodata, geokeys or geokeys_of(crs))
    fields += [(OFFSETS, 4, [8 + sum(sizes[:k]) for k in range(len(sizes))]), (ROWS, 4, [rows]), (COUNTS, 4, sizes)]
    at = 8 + sum(sizes) + sum(sizes) % 2
    return opening(at) + b"".join(strips) + b"\0" * (sum(sizes) % 2) + directory(fields, at)


def tile(a: np.ndarray, side: int, compress: str | None) -> bytes:
    """A tile of (bands, height, width), filled up by its last row and column, pixel-interleaved and packed."""
    full = np.pad(a, ((0, 0), (0, side - a.shape[1]), (0, side - a.shape[2])), mode="edge")
    return PACKERS[compress][1](np.ascontiguousarray(full.transpose(1, 2, 0)).astype(full.dtype.newbyteorder("<")).tobytes())


#: Files up to this size have places of 32 bits.
SMALL = (1 << 32) - (1 << 20)


def tiled_layout(bands: int, height: int, width: int, dtype: np.dtype, side: int, packed: int, transform: tuple[float, ...], compress: str | None = "lzw", nodata: str | None = None, geokeys: list[tuple[int, int]] = (), big: bool | None = None) -> tuple[bytes, int, int, int, bytes, bool]:
    """Of a tiled file with packed bytes of tiles: (opening, where tiles begin, where the places and where the sizes of tiles are listed, the directory that ends the file, whether it is a big one).

    The opening comes first, then the tiles, then the lists, then the directory.
    """
    count = -(-height // side) * -(-width // side)
    big = packed + 16 * count > SMALL if big is None else big
    word, start = (8, 16) if big else (4, 8)
    offsets = start + packed + -packed % 8
    sizes = offsets + word * count
    at = sizes + word * count + -(word * count * 2) % 8
    fields = _tags(bands, height, width, dtype, transform, compress, nodata, list(geokeys)) + [(TILE_W, 4, [side]), (TILE_H, 4, [side])]
    kind = 16 if big else 4
    if count == 1:  # one value lies in the directory itself
        fields += [(TILE_OFFSETS, kind, [start]), (TILE_COUNTS, kind, [packed])]
        return opening(at, big), start, offsets, sizes, directory(fields, at, big), big
    fields += [(TILE_OFFSETS, kind, count), (TILE_COUNTS, kind, count)]
    return opening(at, big), start, offsets, sizes, directory(fields, at, big, {TILE_OFFSETS: offsets, TILE_COUNTS: sizes}), big
