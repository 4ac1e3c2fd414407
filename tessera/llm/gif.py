"""GIF media columns: an encoder for 8-bit samples and a decoder of timed frames.

The decoder reads GIF87a and GIF89a: LZW code streams with growing codes, clear
codes and deferred clears, global and local palettes, interlacing, transparency
and the disposal rules (keep, clear, restore what was there before).  Frames come
as composed RGBA canvases with their time; columns hold colour histograms.

``store`` keeps bytes as palette numbers of a GIF whose palette spreads them over
red, green and blue, ``WIDTH`` samples a row and at most ``ROWS`` rows a frame, each
frame cleared behind it.  Reading goes through the composed canvases: the opaque
pixels of a frame are its part of the payload, and their colours, turned back into
palette numbers, its bytes.

Defined cases: null text counts as empty and becomes one row of padding; null or
malformed GIF bytes, and canvases of colours that stand for no byte, give nulls;
equal bytes give equal columns; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import column, slices, small_batches

WIDTH, ROWS, UNIT, PAD = 576, 1024, 576, 255
#: Equal parts of each colour channel in a histogram.
BINS = 4
LEAST_BITS = 8


# ------------------------------------------------------------------ LZW


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given bit widths, low bits first, packed into bytes."""
    at = np.cumsum(widths) - widths
    total = int(at[-1] + widths[-1]) if len(codes) else 0
    out = np.zeros((total + 7) // 8 + 4, np.uint32)
    low = (at & 7).astype(np.uint32)
    word = codes.astype(np.uint32) << low  # 12 bits shifted by 7 at most: three bytes
    byte = at >> 3
    for k in range(3):  # no two codes share a bit, so sums are unions
        out[: len(out)] += np.bincount(byte + k, (word >> np.uint32(8 * k)) & np.uint32(255), len(out)).astype(np.uint32)
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


@cache
def _widths(least: int) -> np.ndarray:
    """Bits of the k-th code behind a clear code: the decoder adds an entry behind every code but the first."""
    entries = (1 << least) + 2 + np.maximum(np.arange(4096) - 2, 0)
    return np.array([min(int(n).bit_length(), 12) for n in entries])


def lzw_encode(data: bytes, least: int = LEAST_BITS) -> bytes:
    """The LZW code stream of samples below ``2 ** least``; the table is cleared when full."""
    clear = 1 << least
    codes: list[int] = [clear]
    put = codes.append
    resets: list[int] = [0]  # positions of clear codes
    table: dict[int, int] = {}  # prefix code and sample to code, shifted for the next sample
    following = clear + 2
    samples = iter(data)
    for prefix in samples:
        prefix <<= 8
        for b in samples:
            key = prefix | b
            if key in table:
                prefix = table[key]
                continue
            put(prefix >> 8)
            prefix = b << 8
            if following < 4096:
                table[key] = following << 8
                following += 1
            else:
                resets.append(len(codes))
                put(clear)
                table = {}
                following = clear + 2
        put(prefix >> 8)
    put(clear + 1)
    c = np.array(codes, np.int64)
    since = np.arange(len(c)) - np.repeat(resets, np.diff([*resets, len(c)]))
    widths = _widths(least)[np.minimum(since, 4095)]
    widths[0] = least + 1
    widths[resets[1:]] = 12  # a clear has the width before it
    return _bits(c, widths)


def _stood_for(codes: np.ndarray, clear: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, ``most`` at least if there are so many, of the codes behind a clear code; where each code's begin, and how many they are.

    The k-th entry is what the k-th code stands for and one sample more, which is the one that follows in the output.  So
    each sample is a literal or a copy of one before it, and chains of copies are followed by doubling steps."""
    n = len(codes)
    ref = codes - (clear + 2)
    copies = ref >= 0
    if (ref >= np.arange(n)).any():
        raise ValueError("a code is not in the table")
    up = np.append(np.where(copies, ref, n), n)  # the n-th stands for nothing
    length = np.append(np.ones(n, np.int64), 0)
    while up.min(initial=n) < n:
        length += length[up]
        up = up[up]
    length = length[:n]
    ends = np.cumsum(length)
    first = ends - length
    if n and ends[-1] > most:
        n = int(np.searchsorted(ends, most)) + 1
    literal = ~copies[:n]
    back = np.where(literal, 0, first[np.maximum(ref[:n], 0)] - first[:n])
    total = int(ends[n - 1]) if n else 0
    source = np.arange(total) + np.repeat(back, length[:n])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = np.zeros(total, np.uint8)
    samples[first[:n][literal]] = codes[:n][literal]
    return samples[source], first, length


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """Samples of a code stream, ``most`` at most; a stream that ends early gives what it holds."""
    clear, end = 1 << least, (1 << least) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, since = 8 * len(stream), 0, 1  # `since`: codes since a clear code, with it
    whole: list[bytes] | None = None  # the table, once it is full
    out: list[bytes] = []
    made = 0
    while made < most and at < bits:
        # where the codes up to the next clear code stand follows from their number alone
        width = _widths(least)[np.minimum(np.arange(since, since + 4096), 4095)]
        ends = at + np.cumsum(width)
        n = int(np.searchsorted(ends, bits, side="right"))
        if not n:
            break
        start, width, ends = ends[:n] - width[:n], width[:n], ends[:n]
        byte = start >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7)) & ((1 << width) - 1)
        special = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(special[0]) if len(special) else n
        if since == 1:
            samples, first, length = _stood_for(codes[:stop], clear, most - made)
            out.append(samples.tobytes())
            if stop == 4096 and len(samples) < most - made:
                own = out[-1]
                whole = [bytes([k]) if k < clear else b"" for k in range(clear + 2)]
                whole += [own[a : a + k + 1] for a, k in zip(first[: 4096 - len(whole)].tolist(), length.tolist(), strict=False)]
        else:
            out.append(b"".join(map(whole.__getitem__, codes[:stop].tolist())))
        made += len(out[-1])
        if stop == n:
            at, since = int(ends[-1]), since + n
        elif codes[stop] == end:
            break
        else:
            at, since = int(ends[stop]), 1
    return b"".join(out)[:most]


# ------------------------------------------------------------------ container


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    samples: bytes  # palette numbers, top row first
    palette: np.ndarray  # (n, 3)
    transparent: int  # -1: none
    disposal: int
    delay_ms: int


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray) -> bytes:
    """A GIF89a with one global palette of 2 to 256 colours, a power of two of them."""
    size = max(len(palette).bit_length() - 1, 1)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 7 << 4 | size - 1, 0, 0), np.ascontiguousarray(palette, np.uint8).tobytes()]
    for f in frames:
        seen = f.transparent >= 0
        out += [b"\x21\xf9\x04", struct.pack("<BHB", f.disposal << 2 | seen, f.delay_ms // 10, f.transparent if seen else 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0)]
        least = max(size, 2)
        out += [bytes([least]), _blocks(lzw_encode(f.samples, least))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Gif:
    """The parts of a GIF file; ValueError if it is none."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF header")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise ValueError("a palette is cut off")
        out = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    palette, frames = colours(flags), []
    transparent, disposal, delay = -1, 0, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                own, delay, seen = struct.unpack("<BHB", body[:4])
                transparent, disposal = seen if own & 1 else -1, own >> 2 & 7
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise ValueError("a frame is cut off")
            left, top, w, h, own = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            local = colours(own)
            used = local if local is not None else palette
            if used is None:
                raise ValueError("a frame has no palette")
            least = data[at] if at < len(data) else 0
            at += 1
            if not 1 <= least <= 8:
                raise ValueError("a code size is out of range")
            stream = blocks()
            if w * h > 4096 * (8 * len(stream) // (least + 1) + 1):
                raise ValueError("a frame is larger than its codes can fill")  # none stands for more than 4096 samples
            samples = lzw_decode(stream, least, w * h)
            samples += bytes(w * h - len(samples))
            if own & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                rows = np.empty((h, w), np.uint8)
                rows[order] = np.frombuffer(samples, np.uint8).reshape(h, w)
                samples = rows.tobytes()
            frames.append(Frame(left, top, w, h, samples, used, transparent, disposal, delay * 10))
            transparent, disposal, delay = -1, 0, 0
        else:
            raise ValueError("an unknown block")
    if not frames:
        raise ValueError("no frame")
    if width * height > max(1 << 24, 16 * max(f.width * f.height for f in frames)):
        raise ValueError("the screen is out of proportion to its frames")
    return Gif(width, height, background, palette, frames)


def canvases(gif: Gif) -> Iterator[tuple[int, np.ndarray]]:
    """Start in ms and composed RGBA canvas of each frame."""
    canvas, at = np.zeros((gif.height, gif.width, 4), np.uint8), 0
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        numbers = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[:h, :w]
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = 0
        colours[: len(f.palette), :3] = f.palette
        shown, whole = colours.view(np.uint32)[:, 0][numbers], area.view(np.uint32)[..., 0]  # a pixel is one number
        if f.transparent < 0:
            whole[:] = shown
        else:
            np.copyto(whole, shown, where=numbers != f.transparent)
        yield at, canvas.copy()
        at += f.delay_ms
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of the opaque pixels by equal parts of red, green and blue."""
    seen = _opaque(canvas)
    part = (np.arange(256) * bins // 256).astype(np.uint32)
    return np.bincount((part * bins * bins)[seen[:, 0]] + (part * bins)[seen[:, 1]] + part[seen[:, 2]], minlength=bins**3)


def _opaque(canvas: np.ndarray) -> np.ndarray:
    """The pixels that something was drawn on, in rows of four bytes."""
    pixels = canvas.reshape(-1, 4)
    seen = pixels[:, 3] > 0
    return pixels if seen.all() else pixels[seen]


def decode_column(media: DataFrame, name: str = "media") -> DataFrame:
    """One row per frame of the GIF bytes in ``name``, keyed by ``doc_id``:
    ``frame, start_ms, delay_ms, width, height, histogram``; malformed bytes give one row of nulls."""
    small_batches(media.sparkSession)
    schema = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(b.num_rows):
                doc, data = b.column("doc_id")[one].as_py(), b.column(name)[one].as_py()
                try:
                    gif = decode(data or b"")
                    rows = [(doc, k, at, gif.frames[k].delay_ms, gif.width, gif.height, histogram(c).tolist()) for k, (at, c) in enumerate(canvases(gif))]
                except ValueError:
                    rows = [(doc, *[None] * 6)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", name).mapInArrow(frames, schema)


# ------------------------------------------------------------------ payloads

_K = np.arange(256)
#: Three bits of a byte for red, three for green, two for blue; each channel's parts are those of ``histogram``.
COLOURS = np.stack([(_K >> 5) * 36, (_K >> 2 & 7) * 36, (_K & 3) * 85], axis=1).astype(np.uint8)
#: What a channel's value adds to the byte, and the opaque pixel of each byte as one number.
_RED, _GREEN, _BLUE = ((_K // 36 << 5).astype(np.uint8), (_K // 36 << 2).astype(np.uint8), (_K // 85).astype(np.uint8))
_PIXELS = np.concatenate([COLOURS, np.full((256, 1), 255, np.uint8)], axis=1).view(np.uint32)[:, 0]


def store(payload: bytes) -> bytes:
    """A payload of whole rows as a GIF."""
    step = WIDTH * ROWS
    frames = [Frame(0, 0, WIDTH, len(part) // WIDTH, part, COLOURS, -1, 2, 100) for part in (payload[k : k + step] for k in range(0, len(payload), step))]
    return encode(frames, WIDTH, max(f.height for f in frames), COLOURS)


def read(data: bytes) -> tuple[bytes, np.ndarray, list[int]]:
    """Payload, colour histogram and start of each frame of a stored GIF, from its composed canvases."""
    gif = decode(data)
    parts, counts, starts = [], np.zeros(BINS**3, np.int64), []
    for at, canvas in canvases(gif):
        seen = _opaque(canvas)
        number = _RED[seen[:, 0]] + _GREEN[seen[:, 1]] + _BLUE[seen[:, 2]]
        if (_PIXELS[number] != np.ascontiguousarray(seen).view(np.uint32)[:, 0]).any():
            raise ValueError("a colour stands for no byte")
        parts.append(number.tobytes())
        counts += histogram(canvas)
        starts.append(at)
    return b"".join(parts), counts, starts


def pad(data: bytes) -> bytes:
    n = max(-(-len(data) // UNIT), 1) * UNIT
    return data + bytes([PAD]) * (n - len(data))


def store_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded, as a GIF."""
    small_batches(docs.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                texts = [t or b"" for t in column(part, "text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def read_column(media: DataFrame) -> DataFrame:
    """What the stored GIFs hold: payload digests, and the feature, shares of the colour histogram in per mille of the pixels."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, last_ms long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        own = (len(data), hashlib.sha256(data).hexdigest())
        try:
            payload, counts, starts = read(data)
        except ValueError:
            return (None, None, None, *own, None, None, None)
        feature = ",".join(map(str, (counts * 1000 // max(len(payload), 1)).tolist()))
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, feature, len(starts), starts[-1])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, n, *one(data)) for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(digests, schema)
