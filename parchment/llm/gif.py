"""GIF media columns: encoding, decoding (LZW, palettes, disposal, transparency, interlacing), features.

``encode`` stores bytes as the samples of an animated GIF89a: 192 samples a row, at most
``ROWS`` rows a frame, so a payload of any length is a sequence of timed frames.  The palette is the
grey ramp, which makes a sample's colour its value.  ``decode`` reads any
GIF87a/89a stream: global and local palettes, transparent samples, disposal
(keep, clear to background, restore) and interlaced rows.

Null text is an empty payload, padded like any other to one row of blanks.  Equal texts give
equal bytes and features.  Repeated rows are repeated; a null id stays null; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parchment.llm.common import stored, texts

WIDTH = 192
#: Rows of one frame.
ROWS = 1024
#: Hundredths of a second that a frame is shown.
DELAY = 4
_FULL = 4096


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the n codes after a clear code, as a decoder counts them."""
    table = np.minimum((1 << size) + 1 + np.arange(n), _FULL - 1)
    return np.maximum(np.ceil(np.log2(table + 1)).astype(np.int64), size + 1)


_WIDTHS = {s: _widths(_FULL, s) for s in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream with an 8-bit alphabet."""
    clear, end = 256, 257
    codes: list[int] = []
    runs: list[int] = []  # codes after each clear code, itself excluded
    emit = codes.append
    at, n = 0, len(data)
    table: dict[int, int] = {}
    nxt, mark = 258, 0
    if n:
        prefix = data[0]
        get = table.get
        for b in data[1:]:
            k = prefix << 8 | b
            c = get(k)
            if c is not None:
                prefix = c
            else:
                emit(prefix)
                table[k] = nxt
                nxt += 1
                prefix = b
                if nxt == _FULL:
                    emit(clear)
                    runs.append(len(codes) - mark)
                    mark = len(codes)
                    table.clear()
                    nxt = 258
        emit(prefix)
        at = n
    emit(end)
    runs.append(len(codes) - mark)
    assert at == n
    width = _WIDTHS[8]
    values = np.array([clear, *codes], np.uint16)
    bits = np.concatenate([[9], *[width[:r] for r in runs]])
    cells = (values[:, None] >> np.arange(12, dtype=np.uint16)) & np.uint16(1)
    used = np.arange(12)[None, :] < bits[:, None]
    return np.packbits(cells[used].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, limit: int) -> bytes:
    """Samples of an LZW code stream with codes of ``size`` + 1 bits at first; at most ``limit`` samples."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    bits = 8 * len(stream)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    full = _WIDTHS[size]
    pos, out, have = 0, [], 0
    table, prev, count = base[:], b"", 0
    while pos < bits and have < limit:
        width = full[count:] if count < _FULL else full[-1:].repeat(_FULL)
        starts = pos + np.cumsum(width) - width
        starts = starts[starts + width <= bits]
        if not len(starts):
            break
        width = width[: len(starts)]
        byte = starts >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (starts & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else len(codes)
        add, put = table.append, out.append
        for c in codes[:used].tolist():
            if prev:
                n = len(table)
                if c < n:
                    entry = table[c]
                    if n < _FULL:
                        add(prev + entry[:1])
                elif c == n and n < _FULL:
                    entry = prev + prev[:1]
                    add(entry)
                else:
                    raise ValueError("bad LZW code")
            else:
                entry = table[c]
            put(entry)
            prev = entry
        count += used
        if len(stop):
            pos = int(starts[used] + width[used])
            if codes[used] == end:
                break
            table, prev, count = base[:], b"", 0
        else:
            pos = int(starts[-1] + width[-1])
        have = sum(map(len, out))
        out = [b"".join(out)]
    return b"".join(out)[:limit]


def _chunks(stream: bytes) -> bytes:
    parts = [bytes([len(c := stream[i : i + 255])]) + c for i in range(0, len(stream), 255)]
    return b"".join(parts) + b"\0"


_RAMP = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes) -> bytes:
    """GIF of a payload that is a positive multiple of 192 bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _RAMP]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_chunks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    canvas: np.ndarray  # rows x columns x (red, green, blue, alpha) as shown

    @property
    def shown(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _interlaced(rows: int) -> np.ndarray:
    """Row that each stored row of an interlaced image goes to."""
    return np.concatenate([np.arange(start, rows, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes) -> Iterator[Frame]:
    """Frames of a GIF in order, composed on the canvas."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", media[6:13])
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        p = np.full((256, 4), 255, np.uint8)
        p[:, :3] = 0
        p[:n, :3] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return p

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    common = palette(flags & 7) if flags & 0x80 else None
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(media):
        kind = media[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack("<HHHHB", media[at : at + 9])
            at += 9
            colours = palette(own & 7) if own & 0x80 else common
            if colours is None:
                raise ValueError("no palette")
            size = media[at]
            at += 1
            samples = np.frombuffer(lzw_decode(blocks(), size, w * h), np.uint8)
            if len(samples) < w * h:
                raise ValueError("image data ends early")
            samples = samples.reshape(h, w)
            if own & 0x40:
                placed = np.empty_like(samples)
                placed[_interlaced(h)] = samples
                samples = placed
            before = canvas.copy() if disposal == 3 else None
            place = canvas[top : top + h, left : left + w]
            drawn = colours[samples[: place.shape[0], : place.shape[1]]]
            if clear_index is None:
                place[:] = drawn
            else:
                solid = samples[: place.shape[0], : place.shape[1]] != clear_index
                place[solid] = drawn[solid]
            yield Frame(left, top, w, h, delay, disposal, canvas)
            if disposal == 2:
                place[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind}")


def histogram(pixels: np.ndarray, bins: int = 16) -> np.ndarray:
    """Counts of the visible pixels by level of red, green and blue: 3 x bins."""
    seen = pixels if pixels[..., 3].all() else pixels[pixels[..., 3] > 0]
    out = np.zeros((3, bins), np.int64)
    for c in range(3):
        out[c] = np.bincount(np.ascontiguousarray(seen[..., c]).ravel(), minlength=256).reshape(bins, -1).sum(1)
    return out


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded by blanks to full rows, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for body in batch.column(1):
                b = body.as_py()
                sizes.append(len(b))
                media.append(encode(b + b" " * (-len(b) % WIDTH if b else WIDTH)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """media(doc_id, media) -> a row per frame: place, delay, start time and colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, m in zip(batch.column(0), batch.column(1)):
                start = 0
                for k, f in enumerate(decode(m.as_py())):
                    rows.append((i.as_py(), k, f.left, f.top, f.width, f.height, f.delay, start, histogram(f.canvas).ravel().tolist()))
                    start += f.delay
            if rows:
                schema = pa.schema(
                    [("doc_id", pa.int64())]
                    + [(n, pa.int64()) for n in ("frame", "left", "top", "width", "height", "delay", "start")]
                    + [("histogram", pa.list_(pa.int64()))]
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    kinds = ", ".join(f"{n} long" for n in ("frame", "left", "top", "width", "height", "delay", "start"))
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id long, {kinds}, histogram array<bigint>")


def read_back(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> the decoded payload's length, digests and colour features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in batch.column(2):
                b = m.as_py()
                sha, size, tail, n, time = hashlib.sha256(), 0, b"", 0, 0
                hist = np.zeros((3, 16), np.int64)
                for f in decode(b):
                    part = f.shown[..., 0].tobytes()
                    sha.update(part)
                    size += len(part)
                    tail = part[-16:]
                    hist += histogram(f.shown)
                    n += 1
                    time += f.delay
                out["payload_bytes"].append(size)
                out["payload_sha256"].append(sha.hexdigest())
                out["tail_crc32"].append(zlib.crc32(tail))
                out["media_bytes"].append(len(b))
                out["media_sha256"].append(hashlib.sha256(b).hexdigest())
                grey = ",".join(map(str, hist[0].tolist()))
                out["feature"].append(f"frames={n};time={time};grey={grey}")
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]],
                ["doc_id", "n_bytes", *out],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF in a table of the shared folder, read it back and describe it."""
    return read_back(stored(to_media(docs), "media"))
