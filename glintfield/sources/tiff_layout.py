"""What a GeoTIFF file says about its samples: header tags, where each line's bytes are, names and places.

Uncompressed files of the classic and the big kind, in strips or tiles, bands interleaved or apart. Only headers are read
here; `lines` turns byte ranges into arrays.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from typing import Any, BinaryIO, NamedTuple
from xml.sax.saxutils import escape, quoteattr

import numpy as np

# Fixed values of the format: tag numbers, and sizes and codes of the field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, EXTRA, SAMPLE_FORMAT = 284, 322, 323, 324, 338, 339
PIXEL_SCALE, TIE_POINTS, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, GDAL_ITEMS, GDAL_NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


class Layout(NamedTuple):
    """One image: samples[band - 1] of line r are found by `lines`."""

    width: int
    height: int
    bands: int
    dtype: str
    interleaved: bool
    block: tuple[int, int]  # lines and columns of a strip or tile
    offsets: list[int]
    tags: dict[int, Any]
    items: dict[str, str]
    band_items: dict[int, dict[str, str]]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])

    def transform(self) -> list[float] | None:
        """Origin x, step right, turn, origin y, turn, step down; null where the file has control points instead."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        if PIXEL_SCALE in self.tags and TIE_POINTS in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINTS][:5]
            return [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
        return None

    def control_points(self) -> list[tuple[float, ...]]:
        """(pixel, line, x, y, z) of each tie point of a file that is placed by them."""
        t = self.tags.get(TIE_POINTS, ()) if PIXEL_SCALE not in self.tags else ()
        return [(t[k], t[k + 1], *t[k + 3 : k + 6]) for k in range(0, len(t), 6)]

    def nodata(self) -> float | None:
        text = self.tags.get(GDAL_NODATA)
        return float(text) if text else None


def _items(xml: str | None) -> tuple[dict[str, str], dict[int, dict[str, str]]]:
    """Items of the dataset and of each band; scale and offset by their roles."""
    whole: dict[str, str] = {}
    bands: dict[int, dict[str, str]] = {}
    for item in ET.fromstring(xml).iter("Item") if xml else ():
        into = whole if item.get("sample") is None else bands.setdefault(int(item.get("sample", "0")) + 1, {})
        into[(item.get("role") if item.get("role") in ("scale", "offset") else item.get("name", "")) or ""] = item.text or ""
    return whole, bands


def read_layout(file: BinaryIO) -> Layout:
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack(order + "H", head[2:4])
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    (at,) = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])
    word, slot, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    file.seek(at)
    (count,) = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))
    table, tags = file.read(count * entry), {}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", table, k * entry)
        (n,) = struct.unpack_from(order + word, table, k * entry + 4)
        if kind not in FIELD:
            continue
        size = n * struct.calcsize("<" + FIELD[kind])
        raw = table[k * entry + entry - slot : k * entry + entry]
        if size > slot:
            file.seek(struct.unpack(order + word, raw)[0])
            raw = file.read(size)
        tags[tag] = raw[:n].rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{order}{n}{FIELD[kind]}", raw[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(COMPRESSION, 1) != 1:
        raise ValueError(f"compression {one(COMPRESSION, 1)} is not read")
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, form = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if len(bits) > 1 or len(form) > 1 or bits & {1, 2, 4} or not form <= set(KINDS):
        raise ValueError(f"samples of {sorted(bits)} bits and format {sorted(form)} are not read")
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    items, band_items = _items(tags.get(GDAL_ITEMS))
    return Layout(width, height, bands, f"{order}{KINDS[form.pop()]}{bits.pop() // 8}", one(PLANAR, 1) == 1, block, list(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]), tags, items, band_items)


def lines(file: BinaryIO, layout: Layout, bands: list[int], block_row: int, first: int, last: int) -> np.ndarray:
    """samples[band, line, column] of lines first to last - 1, all within one row of strips or tiles; reads those lines' bytes."""
    tall, wide = layout.block
    per = layout.bands if layout.interleaved else 1
    item = np.dtype(layout.dtype)
    top = first - block_row * tall
    out = np.empty((len(bands), last - first, layout.across * wide), item.newbyteorder("="))
    for x in range(layout.across):
        for plane in sorted({0 if layout.interleaved else b - 1 for b in bands}):
            file.seek(layout.offsets[(plane * layout.down + block_row) * layout.across + x] + top * wide * per * item.itemsize)
            need = (last - first) * wide * per
            data = np.frombuffer(file.read(need * item.itemsize), item)
            if len(data) < need:
                raise ValueError("the file ends within a strip or tile")
            data = data.reshape(last - first, wide, per)
            for k, b in enumerate(bands):
                if layout.interleaved or b - 1 == plane:
                    out[k, :, x * wide : (x + 1) * wide] = data[:, :, b - 1 if layout.interleaved else 0]
    return out[:, :, : layout.width]


def _item_xml(items: dict[str, str], band_items: dict[int, dict[str, str]]) -> str:
    out = [f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in items.items()]
    for band, own in sorted(band_items.items()):
        for k, v in own.items():
            role = f" role={quoteattr(k)}" if k in ("scale", "offset") else ""
            out.append(f'<Item name={quoteattr(k.upper() if role else k)} sample="{band - 1}"{role}>{escape(str(v))}</Item>')
    return "<GDALMetadata>" + "".join(out) + "</GDALMetadata>"


class Plan(NamedTuple):
    """A big TIFF file of 32-bit floats, bands apart, one strip a line: its header and where each line goes."""

    header: bytes
    start: int
    width: int
    height: int
    bands: int

    def place(self, band: int, r: int) -> int:
        return self.start + ((band - 1) * self.height + r) * self.width * 4

    @property
    def size(self) -> int:
        return self.place(self.bands + 1, 0)


def plan_file(width: int, height: int, bands: int, *, transform: list[float] | None = None, control_points: list[list[float]] | None = None, geo_keys: dict[int, list] | None = None, items: dict[str, str] | None = None, band_items: dict[int, dict[str, str]] | None = None, nodata: float | None = 0) -> Plan:
    """The header and the places of all lines; control points win over a transform, as tie points without a scale."""
    entries: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, 16, [0] * (height * bands)), (SAMPLES, 3, [bands]),
        (ROWS_PER_STRIP, 4, [1]), (STRIP_COUNTS, 16, [4 * width] * (height * bands)), (PLANAR, 3, [2]), (SAMPLE_FORMAT, 3, [3] * bands),
    ]
    if bands > 1:
        entries.append((EXTRA, 3, [0] * (bands - 1)))
    if control_points:
        entries.append((TIE_POINTS, 12, [x for p in control_points for x in (p[0], p[1], 0.0, *p[2:5])]))
    elif transform:
        x, a, b, y, c, d = transform
        entries.append((TRANSFORM, 12, [a, b, 0.0, x, c, d, 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    for tag, values in (geo_keys or {}).items():
        entries.append((int(tag), 3 if int(tag) == GEO_KEYS else 12 if int(tag) == GEO_DOUBLES else 2, values.encode() + b"\0" if isinstance(values, str) else values))
    if items or band_items:
        entries.append((GDAL_ITEMS, 2, _item_xml(items or {}, {int(k): v for k, v in (band_items or {}).items()}).encode() + b"\0"))
    if nodata is not None:
        entries.append((GDAL_NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    entries.sort(key=lambda e: e[0])
    packed = lambda kind, values: values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
    beyond = 16 + 8 + 20 * len(entries) + 8
    place, at = {}, beyond
    for tag, kind, values in entries:
        if (size := len(packed(kind, values))) > 8:
            place[tag], at = at, at + size + size % 8
    start = -(-at // 4096) * 4096
    plan = Plan(b"", start, width, height, bands)
    table, tail = b"", b""
    for tag, kind, values in entries:
        if tag == STRIP_OFFSETS:
            values = [plan.place(b + 1, r) for b in range(bands) for r in range(height)]
        data = packed(kind, values)
        table += struct.pack("<HHQ", tag, kind, len(values)) + (struct.pack("<Q", place[tag]) if len(data) > 8 else data.ljust(8, b"\0"))
        if len(data) > 8:
            tail += data + b"\0" * (len(data) % 8)
    header = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + table + struct.pack("<Q", 0) + tail
    return plan._replace(header=header.ljust(start, b"\0"))
