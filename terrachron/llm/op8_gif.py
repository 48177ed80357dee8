"""GIF columns: LZW code streams, palettes, disposal and transparency; timed frames with colour histograms.

``decode`` reads any GIF87a or GIF89a; ``decode_gifs`` makes a row for each frame of a binary column. ``store_texts``
writes bytes as the samples of 64-pixel rows of 8-bit frames, decodes the stored form again, frames composed with
palette, disposal and transparency, and derives all columns from that: the payload from the samples, timed frames and
their colour histograms from the composed canvases. Codes are packed and unpacked by numpy; only dictionary strings
are followed one by one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, prepare

WIDTH, MOST_ROWS, DELAY_CS, MOST_CODES = 64, 65_535, 10, 4096
#: Pixels of a picture or frame (256 MB of RGBA) beyond which it counts as broken: headers can ask for 17 GB.
MOST_PIXELS = 1 << 26
#: The stored form's palette: three bits each of red and green, two of blue, so that samples are parted by colour.
PALETTE = bytes(v for i in range(256) for v in (i & 0xE0, i << 3 & 0xE0, i << 6 & 0xC0))


@lru_cache
def all_widths(size: int) -> np.ndarray:
    entries = np.arange(MOST_CODES, dtype=np.int64) + (1 << size) + 1  # there are as many, at most, when code k is read
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1, 12)


def widths(size: int, start: int, count: int) -> np.ndarray:
    """Bits of the ``count`` codes from number ``start`` on after a clear code, for a minimum code size."""
    known = all_widths(size)[start : start + count]
    return known if len(known) == count else np.concatenate([known, np.full(count - len(known), 12)])


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The GIF code stream of ``data`` (samples below 2 ** size), with a clear code whenever the table is full."""
    clear, first = 1 << size, (1 << size) + 2
    codes, lengths, begun = [clear], [], 1
    put, following = codes.append, first
    root: dict[int, dict] = {i: {-1: i} for i in range(clear)}  # a string's continuations; -1: its code
    if data:
        node = root[data[0]]
        for c in memoryview(data)[1:]:
            longer = node.get(c)
            if longer is not None:
                node = longer
                continue
            put(node[-1])
            node[c] = {-1: following}
            following += 1
            if following == MOST_CODES:
                put(clear)
                lengths.append(len(codes) - begun)
                begun, following = len(codes), first
                root = {i: {-1: i} for i in range(clear)}
            node = root[c]
        put(node[-1])
    put(clear + 1)
    lengths.append(len(codes) - begun)
    bits = np.concatenate([[size + 1], *(widths(size, 0, n) for n in lengths)])
    return pack_codes(np.array(codes, np.int64), bits)


def pack_codes(codes: np.ndarray, bits: np.ndarray) -> bytes:
    out, carry = [], np.zeros(0, np.uint8)
    for i in range(0, len(codes), 1 << 16):
        wide = (codes[i : i + (1 << 16), None] >> np.arange(12)) & 1
        carry = np.concatenate([carry, wide[np.arange(12) < bits[i : i + (1 << 16), None]].astype(np.uint8)])
        whole = len(carry) // 8 * 8
        out.append(np.packbits(carry[:whole], bitorder="little").tobytes())
        carry = carry[whole:]
    return b"".join(out) + np.packbits(carry, bitorder="little").tobytes()


def read_codes(data: bytes, size: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A stream's codes without clear and end codes, and for each where the codes since its clear code begin."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    total, at, k, n, begun, codes, begins = len(data) * 8, 0, 0, 0, 0, [], []
    while at + size + 1 <= total and (most is None or n < most):
        bits = widths(size, k, min(MOST_CODES, (total - at) // (size + 1)))
        starts = at + np.concatenate([[0], np.cumsum(bits)])
        whole = int(np.searchsorted(starts[1:], total, side="right"))
        if not whole:
            break
        s, b = starts[:whole], bits[:whole]
        i = s >> 3
        got = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (s & 7)) & ((1 << b) - 1)
        stops = np.flatnonzero((got == clear) | (got == end))
        stop = int(stops[0]) if len(stops) else whole
        codes.append(got[:stop])
        begins.append(np.full(stop, begun))
        n, k, at = n + stop, k + stop, int(starts[stop])
        if len(stops):
            if got[stop] == end:
                break
            at, k, begun = int(starts[stop + 1]), 0, n
    return (np.concatenate(codes), np.concatenate(begins)) if codes else (np.zeros(0, np.int64),) * 2


def lzw_decode(data: bytes, size: int, most: int | None = None) -> bytes:
    """The samples of a GIF code stream, up to its end code, its last whole code, or ``most`` samples.

    The string of the entry that code number i added is that code's string and the first sample of the next code's,
    so strings are chains of earlier codes: their first samples and lengths are found by pointer jumping, and all
    strings are then written from their last samples backwards, one sample of each at a time.
    """
    if not 1 <= size <= 8:
        raise ValueError("a minimum code size beyond 8 bits")
    codes, begins = read_codes(data, size, most)
    first, n = (1 << size) + 2, len(codes)
    parent = np.where(codes < first, np.arange(n), begins + codes - first)
    if (parent >= np.arange(n))[codes >= first].any():
        raise ValueError("a code beyond the table")
    root, length = parent.copy(), (codes >= first).astype(np.int64)
    while not np.array_equal(up := root[root], root):
        length += length[root]
        root = up
    head, length = codes[root].astype(np.uint8), length + 1
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    at, now = ends - 1, np.arange(n)
    while len(now):
        plain = codes[now] < first
        out[at[plain]] = codes[now[plain]]
        now, at = parent[now[~plain]], at[~plain]
        out[at] = head[now + 1]
        at = at - 1
    return out[:most].tobytes()


@dataclass
class Frame:
    index: int
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  #: palette indices, height x width
    canvas: np.ndarray  #: RGBA of the whole picture while this frame shows


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def decode(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames in order. ``compose`` False leaves the canvas empty. ValueError: not a GIF, or a broken one."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n
    if width * height > MOST_PIXELS:
        raise ValueError("a picture beyond the bound on pixels")
    canvas = np.zeros((height, width, 4) if compose else (0, 0, 4), np.uint8)
    delay, disposal, transparent, index = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label = data[at]
            body, at = blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            if w * h > MOST_PIXELS:
                raise ValueError("a frame beyond the bound on pixels")
            colours = palette
            if local & 0x80:
                n = 2 << (local & 7)
                colours, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n
            size = data[at]
            stream, at = blocks(data, at + 1)
            flat = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
            if len(flat) < w * h:
                raise ValueError("a frame without all its samples")
            samples = flat.reshape(h, w)
            if local & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order)]
            kept = canvas
            if compose:
                if colours is None:
                    raise ValueError("a frame without a palette")
                box = np.s_[top : min(height, top + h), left : min(width, left + w)]
                seen = samples[: max(0, height - top), : max(0, width - left)]
                kept = canvas.copy() if disposal == 3 else None
                table = np.full((256, 4), 255, np.uint8)  # samples beyond the palette take its last colour
                table[: len(colours), :3], table[len(colours) :, :3] = colours, colours[-1]
                rgba = table.view(np.uint32)[:, 0][seen]
                whole = canvas.view(np.uint32)[..., 0]
                whole[box] = rgba if transparent is None else np.where(seen != transparent, rgba, whole[box])
            yield Frame(index, left, top, w, h, delay, disposal, transparent, samples, canvas.copy() if compose else canvas)
            if compose and disposal == 2:
                canvas[box] = 0
            elif compose and disposal == 3:
                canvas = kept
            delay, disposal, transparent, index = 0, 0, None, index + 1
        else:
            raise ValueError("an unknown block")


def sub_blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(part := stream[i : i + 255])]) + part for i in range(0, len(stream), 255)) + b"\0"


def encode_samples(payload: bytes) -> bytes:
    """A GIF whose frames hold ``payload`` (a positive multiple of 64 bytes) as samples, 64 to a row; each frame is cleared away by the next."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MOST_ROWS), 0xF7, 0, 0), PALETTE]
    for top in range(0, rows, MOST_ROWS):
        part = payload[top * WIDTH : (top + MOST_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + sub_blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels of each of 64 colours: two bits each of red, green and blue."""
    colour = (canvas[..., 0] >> 6 << 4 | canvas[..., 1] >> 6 << 2 | canvas[..., 2] >> 6).ravel()
    opaque = canvas[..., 3].ravel() > 0
    return np.bincount(colour if opaque.all() else colour[opaque], minlength=64).tolist()


FRAMES = "frame int, left int, top int, width int, height int, delay_ms int, start_ms long, disposal int, transparent int, canvas binary, histogram array<long>, error string"


def decode_gifs(df: DataFrame, *, id_col: str, gif_col: str) -> DataFrame:
    """A row for each frame: id (as string), frame, its place, times, disposal, RGBA canvas, colour histogram, error.

    A null, empty or broken GIF gives one row after the frames that could be read, with error set and no frame.
    """
    prepare(df.sparkSession)
    names = ["id", *(x.split()[0] for x in FRAMES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), *((n, pa.int32()) for n in names[1:7]), ("start_ms", pa.int64()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("canvas", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
        for batch in by_bytes(batches):
            for key, gif in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, start = [], 0
                try:
                    for f in decode(gif or b""):
                        rows.append((key, f.index, f.left, f.top, f.width, f.height, f.delay_ms, start, f.disposal, f.transparent, f.canvas.tobytes(), histogram(f.canvas), None))
                        start += f.delay_ms
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    rows.append((key, *[None] * 11, str(e) or "broken"))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(gif_col).alias("gif")).mapInArrow(run, "id string, " + FRAMES)


FRAME = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.list_(FRAME))])


def store_text(text: str | None) -> tuple[tuple, bytes]:
    """What the query returns of one text, after the id, and the stored bytes; all but n_bytes comes from these."""
    raw = (text or "").encode()
    media = encode_samples(raw + b"\0" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0))
    size, whole, tail, start, frames, total = 0, hashlib.sha256(), b"", 0, [], np.zeros(64, np.int64)
    for f in decode(media):
        part = f.samples.tobytes()
        whole.update(part)
        size, tail = size + len(part), part[-WIDTH:]
        colours = histogram(f.canvas)
        frames.append({"frame": f.index, "start_ms": start, "delay_ms": f.delay_ms, "height": f.height, "histogram": colours})
        start, total = start + f.delay_ms, total + colours
    feature = f"frames={len(frames)};ms={start};rgb64={','.join(map(str, total.tolist()))}"
    return (len(raw), size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames), media


def store_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, frames [, media].

    feature: number of frames, their time and the colour histogram over all of them; frames: place, times and colour
    histogram of each. A null text is empty, and an empty one is 64 zero bytes; null and repeated ids give rows like
    others; a text over 4 MB takes more than one frame; an empty table gives an empty one. Other columns are not read.
    """
    prepare(df.sparkSession)
    schema = STORED.append(pa.field("media", pa.binary())) if keep_media else STORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, media = store_text(text)
                rows.append((key, *row, media) if keep_media else (key, *row))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)

    types = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<frame: int, start_ms: long, delay_ms: int, height: int, histogram: array<long>>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, types + ", media binary" * keep_media)
