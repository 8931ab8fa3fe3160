"""Media columns: find magic bytes with Aho-Corasick, confirm by structure, correct and carve.

`sniff` runs one automaton of all signatures over the bytes and hands each hit to its format's
validator, which walks the structure and returns the length it really has, or None. The type at
offset 0 replaces a wrong declared type; confirmed media at other offsets are embedded.
`wav_bytes` stores any payload losslessly as 8-bit mono PCM samples.

Defined cases: null bytes are sniffed as empty (no type, nothing embedded); truncated or
corrupted media are not confirmed; equal bytes give equal results; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Found(NamedTuple):
    kind: str
    offset: int
    length: int


def _riff(data: bytes, at: int) -> int | None:
    """RIFF of a known form whose chunks fill it exactly."""
    if len(data) < at + 12 or data[at + 8 : at + 12] not in RIFF_FORMS:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    names, here = [], at + 12
    while here + 8 <= end:
        names.append(data[here : here + 4])
        here += 8 + (size := struct.unpack_from("<I", data, here + 4)[0]) + size % 2
    return end - at if here in (end, end + 1) and RIFF_FORMS[data[at + 8 : at + 12]] <= set(names) and names else None


def _png(data: bytes, at: int) -> int | None:
    here = at + 8
    while here + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, here)
        end = here + 12 + size
        if end > len(data) or zlib.crc32(data[here + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0] or (here == at + 8) != (kind == b"IHDR"):
            return None
        if kind == b"IEND":
            return end - at
        here = end
    return None


def _gif(data: bytes, at: int) -> int | None:
    if len(data) < at + 13:
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(here: int) -> int | None:
        while here < len(data):
            if not data[here]:
                return here + 1
            here += 1 + data[here]
        return None

    here: int | None = at + 13 + table(data[at + 10])
    while here is not None and here < len(data):
        if data[here] == 0x3B:
            return here + 1 - at
        if data[here] == 0x21:
            here = blocks(here + 2)
        elif data[here] == 0x2C and here + 10 < len(data):
            here = blocks(here + 11 + table(data[here + 9]))
        else:
            return None
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    here = at + 2
    while here + 2 <= len(data) and data[here] == 0xFF:
        marker = data[here + 1]
        if marker == 0xD9:
            return here + 2 - at
        if here + 4 > len(data):
            return None
        here += 2 + struct.unpack_from(">H", data, here + 2)[0]
        if marker == 0xDA:
            while (here := data.find(b"\xff", here)) >= 0 and here + 1 < len(data) and (data[here + 1] == 0 or 0xD0 <= data[here + 1] <= 0xD7):
                here += 2
            if here < 0:
                return None
    return None


def _bmp(data: bytes, at: int) -> int | None:
    if len(data) < at + 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    return size if not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(data) - at else None


@lru_cache(maxsize=4)
def _places(data: bytes, mark: bytes) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(mark), data)]


def _pdf(data: bytes, at: int) -> int | None:
    """To the last %%EOF before another PDF begins whose startxref points at a cross-reference of this file."""
    heads, ends = _places(data, b"%PDF-"), _places(data, b"%%EOF")
    following = bisect_right(heads, at)
    past = heads[following] if following < len(heads) else len(data)
    for end in reversed(ends[bisect_left(ends, at) : bisect_left(ends, past)]):
        told = re.search(rb"startxref\s+(\d{1,18})\s+$", data[max(at, end - 64) : end])
        if told and re.match(rb"xref\b|\d+\s+\d+\s+obj\b", data[at + int(told[1]) : at + int(told[1]) + 32]):
            return end + 5 - at
    return None


def _gzip(data: bytes, at: int) -> int | None:
    unpacker, here = zlib.decompressobj(31), at
    try:
        while not unpacker.eof and here < len(data):
            unpacker.decompress(data[here : here + 65536], 1 << 20)
            while unpacker.unconsumed_tail:
                unpacker.decompress(unpacker.unconsumed_tail, 1 << 20)
            here += 65536
    except zlib.error:
        return None
    return min(here, len(data)) - len(unpacker.unused_data) - at if unpacker.eof else None


@lru_cache(maxsize=2)
def _archives(data: bytes) -> dict[int, int]:
    """Where archives begin, as their end records say, and the places behind those records; the longest for each."""
    found = {}
    for end in _places(data, b"PK\x05\x06"):
        if end + 22 <= len(data):
            size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
            if data[end - size : end - size + 4] == b"PK\x01\x02" and end + 22 + comment <= len(data):
                found[end - size - offset] = end + 22 + comment
    return found


def _zip(data: bytes, at: int) -> int | None:
    """Up to the end record whose directory stands before it and counts from here."""
    return _archives(data)[at] - at if at in _archives(data) else None


def _ogg(data: bytes, at: int) -> int | None:
    """Pages of one stream in order, from its first to its last."""
    here, stream, number = at, None, 0
    while data[here : here + 5] == b"OggS\0" and here + 27 <= len(data):
        flags, serial, page, segments = data[here + 5], *struct.unpack_from("<II", data, here + 14), data[here + 26]
        end = here + 27 + segments + sum(data[here + 27 : here + 27 + segments])
        if end > len(data) or (stream is None) != bool(flags & 2) or stream not in (None, serial) or page != number:
            return None
        stream, number, here = serial, page + 1, end
        if flags & 4:
            return here - at
    return None


def _flac(data: bytes, at: int) -> int | None:
    """Metadata blocks, the first a stream description, then a frame; the length is to the end, for frames tell none."""
    here, first = at + 4, True
    while here + 4 <= len(data):
        kind, size = data[here], int.from_bytes(data[here + 1 : here + 4], "big")
        if first and (kind & 127, size) != (0, 34):
            return None
        here, first = here + 4 + size, False
        if kind & 128:
            return len(data) - at if data[here : here + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


def _mp4(data: bytes, at: int) -> int | None:
    """Boxes in a row, ftyp first, with an mdat and a moov or moof among them. The signature is the box's name, four bytes in."""
    here, names = at, set()
    while here + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, here)
        if size == 1 and here + 16 <= len(data):
            size = struct.unpack_from(">Q", data, here + 8)[0]
        if size < 8 or here + size > len(data) or not name.isalnum():
            break
        names.add(name)
        here += size
    return here - at if b"mdat" in names and names & {b"moov", b"moof"} else None


def _tiff(data: bytes, at: int) -> int | None:
    """Directories that lie inside, up to the last byte that any of their values or strips takes."""
    order = "<" if data[at : at + 2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    past, seen = at + 8, set()
    here = at + struct.unpack_from(order + "I", data, at + 4)[0] if at + 8 <= len(data) else at
    while here != at:
        if here in seen or here + 2 > len(data) or here < at + 8:
            return None
        seen.add(here)
        n = struct.unpack_from(order + "H", data, here)[0]
        end = here + 6 + 12 * n
        if not n or end > len(data):
            return None
        strips: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, here + 2 + 12 * k)
            size = sizes.get(kind, 0) * count
            place = at + struct.unpack_from(order + "I", data, here + 10 + 12 * k)[0] if size > 4 else here + 10 + 12 * k
            if not size or place + size > len(data):
                return None
            past = max(past, place + size if size > 4 else 0)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                strips[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, place)
        for a, b in ((273, 279), (324, 325)):
            past = max([past, *(at + x + y for x, y in zip(strips.get(a, ()), strips.get(b, ())))])
        past = max(past, end)
        here = at + struct.unpack_from(order + "I", data, end - 4)[0]
    return past - at if seen and past <= len(data) else None


def _mp3(data: bytes, at: int) -> int | None:
    """An ID3v2 tag and the MPEG frames behind it, three at least."""
    if len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return None
    size = 0
    for x in data[at + 6 : at + 10]:
        size = size << 7 | x
    here, frames = at + 10 + size, 0
    while here + 4 <= len(data) and data[here] == 0xFF and data[here + 1] & 0xE6 == 0xE2:
        newest, rate, hertz, pad = data[here + 1] & 0x18 == 0x18, data[here + 2] >> 4, data[here + 2] >> 2 & 3, data[here + 2] >> 1 & 1
        if data[here + 1] & 0x18 == 0x08 or rate in (0, 15) or hertz == 3:
            break
        scale = {0x18: 1, 0x10: 2, 0x00: 4}[data[here + 1] & 0x18]
        length = (144 if newest else 72) * 1000 * MP3_RATES[newest][rate - 1] // ((44100, 48000, 32000)[hertz] // scale) + pad
        if here + length > len(data):
            break
        here, frames = here + length, frames + 1
    return here - at if frames >= 3 else None


#: Fixed values of the public format: kbit/s of layer III in MPEG-1 (True) and MPEG-2 and 2.5 (False).
MP3_RATES = {
    True: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    False: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: RIFF forms and their chunks that must be there.
RIFF_FORMS = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set(), b"AVI ": {b"LIST"}}


#: (signature, type, validator). Fixed values of the public formats.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int | None]]] = [
    (b"RIFF", "riff", _riff),
    (b"\x89PNG\r\n\x1a\n", "png", _png),
    (b"GIF87a", "gif", _gif),
    (b"GIF89a", "gif", _gif),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"BM", "bmp", _bmp),
    (b"%PDF-", "pdf", _pdf),
    (b"\x1f\x8b\x08", "gzip", _gzip),
    (b"PK\x03\x04", "zip", _zip),
    (b"OggS\x00\x02", "ogg", _ogg),
    (b"fLaC", "flac", _flac),
    (b"ftyp", "mp4", _mp4),
    (b"II*\x00", "tiff", _tiff),
    (b"MM\x00*", "tiff", _tiff),
    (b"ID3", "mp3", _mp3),
]
#: Signatures that stand this far inside their medium.
LEAD = {b"ftyp": 4}
#: MIME types of the kinds that `sniff` tells.
MIME = {
    "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg",
    "bmp": "image/bmp", "pdf": "application/pdf", "gzip": "application/gzip", "zip": "application/zip", "ogg": "audio/ogg",
    "flac": "audio/flac", "mp4": "video/mp4", "tiff": "image/tiff", "mp3": "audio/mpeg",
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


_SIGNATURES: list[ahocorasick.Automaton] = []


def sniff(data: bytes) -> list[Found]:
    """Every confirmed medium in data, by offset."""
    if not _SIGNATURES:
        _SIGNATURES.append(_automaton())
    found, packed = [], 0  # packed bytes hold no gzip of their own
    for end, k in _SIGNATURES[0].iter(data.decode("latin-1")):
        magic, kind, validate = FORMATS[k]
        at = end + 1 - len(magic) - LEAD.get(magic, 0)
        if at < 0 or kind == "gzip" and at < packed:
            continue
        if length := validate(data, at):
            packed = at + length if kind == "gzip" else packed
            found.append(Found(data[at + 8 : at + 12].strip().decode("latin-1").lower().replace("wave", "wav") if kind == "riff" else kind, at, length))
    return sorted(found, key=lambda f: (f.offset, f.kind))


def sniff_media(df: DataFrame, *, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """Per row: id, declared, detected (kind at offset 0), corrected (the MIME type to use: the detected kind's, else the declared one), embedded (type, offset, length, bytes)."""

    @F.arrow_udf("struct<detected: string, length: bigint, embedded: array<struct<kind: string, offset: bigint, length: bigint, content: binary>>>")
    def look(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            data = value.as_py() or b""
            found = sniff(data)
            whole = next((f for f in found if f.offset == 0), None)
            rows.append({"detected": whole and whole.kind, "length": whole and whole.length, "embedded": [f._asdict() | {"content": data[f.offset : f.offset + f.length]} for f in found if f.offset]})
        return pa.array(rows, pa.struct([("detected", pa.string()), ("length", pa.int64()), ("embedded", pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])))]))

    mime = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    seen = df.select(F.col(id_col), declared.alias("declared"), look(F.col(bytes_col)).alias("seen"))
    return seen.select(id_col, "declared", F.col("seen.detected").alias("detected"), F.coalesce(F.try_element_at(mime, F.col("seen.detected")), F.col("declared")).alias("corrected"), F.col("seen.length").alias("length"), F.col("seen.embedded").alias("embedded"))


def wav_bytes(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the samples of an 8-bit mono PCM file."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(data: bytes, found: Found) -> bytes:
    """The sample bytes of a confirmed WAV, from its data chunk."""
    here = found.offset + 12
    while data[here : here + 4] != b"data":
        here += 8 + (size := struct.unpack_from("<I", data, here + 4)[0]) + size % 2
    return data[here + 8 : here + 8 + struct.unpack_from("<I", data, here + 4)[0]]


STORED = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _stored_digest(text: str | None, block: int) -> dict:
    raw = (text or "").encode()
    media = wav_bytes(raw.ljust(max(block, -(-len(raw) // block) * block), b"\0"))
    found = sniff(media)
    payload = wav_samples(media, found[0])
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    turns = int(np.count_nonzero(np.diff(samples >= 128)))
    inner = ",".join(f"{f.kind}@{f.offset}+{f.length}" for f in found[1:])
    return {
        "n_bytes": len(raw),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{found[0].kind};samples={len(samples)};sum={int(counts @ np.arange(256))};distinct={np.count_nonzero(counts)};turns={turns};embedded={inner}",
    }


def store_as_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """Each text as the samples of a WAV, read back through `sniff`: id, sizes, digests and features.

    The text's UTF-8 bytes are padded with zero bytes to a positive multiple of `block`; a null
    text is an empty one.
    """

    @F.arrow_udf("struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string>")
    def store(texts: pa.Array) -> pa.Array:
        return pa.array([_stored_digest(x.as_py(), block) for x in texts], STORED)

    kept = df.select(F.col(id_col), store(F.col(text_col)).alias("stored"))
    return kept.select(id_col, *(F.col("stored")[f.name].alias(f.name) for f in STORED))
