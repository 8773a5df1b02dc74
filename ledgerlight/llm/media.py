"""GIF as a media column: an encoder, a full decoder, and a table of timed frames with colour histograms.

The decoder reads LZW code streams of any code size, applies global and local palettes, interlacing, transparency and
the disposal rules, and returns the timed frames both as stored samples and as composed colours. How wide a code is depends on
its place after the last clear code alone, so codes are cut from the bits in runs; each then goes through the dictionary. The
encoder grows the same dictionary and clears it when it is full.

A document's text is stored as the samples of a greyscale GIF of 64 columns: the bytes of the text, filled up by zeros
to whole rows, in frames of at most ``ROWS`` rows. Everything is in memory bounded by one document.

Defined cases: a null text is an empty one, and an empty one still has one row of zeros; a long text takes more frames; equal texts give
equal values; a GIF that breaks off gives the frames that are whole and is marked as truncated; what is no GIF raises
ValueError; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
#: Rows of a frame at most.
ROWS = 4096
DELAY = 10
BINS = 8
#: Fixed by the format: entries of a full dictionary, and the most bits of a code.
FULL, WIDEST = 4096, 12


@lru_cache(12)
def widths(size: int) -> np.ndarray:
    """Bits of the code at each place after a clear code, for an alphabet of ``size`` bits; from the last place on they stay.

    The first code adds nothing to the dictionary, each later one an entry, until it is full.
    """
    entries = np.minimum((1 << size) + 2 + np.maximum(np.arange(FULL + 2) - 1, 0), FULL)
    return size + 1 + sum(entries >= 1 << w for w in range(size + 1, WIDEST))


def code_stream(samples: bytes) -> list[int]:
    """The codes of 8-bit samples: clear, the longest strings known so far, clear again when the dictionary is full, end."""
    if not samples:
        return [256, 257]
    out, known, free, prefix = [256], {}, 258, samples[0]
    emit = out.append
    for byte in samples[1:]:
        key = prefix << 8 | byte
        if key in known:
            prefix = known[key]
            continue
        emit(prefix)
        prefix = byte
        if free < FULL:
            known[key] = free
            free += 1
        else:
            emit(256)
            known.clear()
            free = 258
    out += prefix, 257
    return out


def packed_codes(codes: list[int]) -> bytes:
    """Codes of 8-bit samples as bits, the lowest first. The first code, a clear one, is as wide as any first code."""
    value = np.array(codes, np.int64)
    clears = np.flatnonzero(value == 256)
    place = np.arange(len(value)) - np.repeat(clears, np.diff(np.append(clears, len(value)))) - 1
    place[clears[1:]] = np.diff(clears) - 1  # a clear code is as wide as the code that would have stood there
    place[0] = 0
    bits = widths(8)[place]
    ends = np.cumsum(bits)
    at, spread = (ends - bits) >> 3, value << (ends - bits & 7)
    out = sum(np.bincount(at + k, spread >> 8 * k & 255, (ends[-1] + 7 >> 3) + 2) for k in range(3))  # no bit is set twice
    return out.astype(np.uint8)[: ends[-1] + 7 >> 3].tobytes()


def blocks_of(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes, and the empty one that ends them."""
    whole = len(data) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


GREYS = bytes(v for v in range(256) for _ in range(3))


def encode(frames: list[np.ndarray], palette: bytes = GREYS, delay: int = DELAY) -> bytes:
    """A looping GIF of 8-bit frames (rows, columns), placed at the origin, each replacing what it covers."""
    height, width = (max(f.shape[i] for f in frames) for i in (0, 1))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        out.append(blocks_of(packed_codes(code_stream(np.ascontiguousarray(f).tobytes()))))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame]
    truncated: bool


def codes_of(data: bytes, size: int) -> Iterator[list[int]]:
    """The codes of a stream in runs, each from a clear code (or the start) to the next, which is left out; ends at the end code."""
    raw, clear, at, start, run = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int64), 1 << size, 0, 0, []
    whole, narrow = 8 * len(data), widths(size)
    while True:
        wide = narrow[np.minimum(np.arange(start, start + min(FULL, (whole - at) // (size + 1) + 1)), FULL + 1)]
        ends = at + np.cumsum(wide)
        n = int(np.searchsorted(ends, whole, "right"))
        if not n:
            yield run
            return
        first = ends[:n] - wide[:n]
        byte = first >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[np.minimum(byte + 2, len(raw) - 1)] << 16) >> (first & 7) & (1 << wide[:n]) - 1
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop):
            run += codes.tolist()
            at, start = int(ends[n - 1]), start + n
            continue
        run += codes[: stop[0]].tolist()
        yield run
        if codes[stop[0]] != clear:
            return
        at, start, run = int(ends[stop[0]]), 0, []


def lzw(data: bytes, size: int, count: int) -> np.ndarray:
    """``count`` samples of a code stream whose alphabet has ``size`` bits; fewer if it breaks off.

    The dictionary is kept as a tree: the entry that the code at place k of a run adds is that code's string and the
    first sample of the next. So a later code for it has place k as its parent, and its string is the parent's and one sample more.
    """
    base, parts, starts, n = (1 << size) + 2, [], [], 0
    for run in codes_of(data, size):
        parts.append(np.array(run, np.int64))
        starts.append(np.full(len(run), n))
        n += len(run)
    if not n:
        return np.zeros(0, np.uint8)
    code, start = np.concatenate(parts), np.concatenate(starts)
    parent = np.where(code >= base, code - base + start, np.arange(n))
    wrong = np.flatnonzero((code >= base) & (parent >= np.arange(n)))
    if len(wrong):  # no entry has that number yet
        n = int(wrong[0])
        code, parent = code[:n], parent[:n]
    root, length, up = np.arange(n), np.ones(n, np.int64), np.flatnonzero(code >= base)
    while len(up):
        root[up] = parent[root[up]]
        length[up] += 1
        up = up[code[root[up]] >= base]
    first = code[root]
    after = np.minimum(parent + 1, n - 1)
    last = np.where(code >= base, first[after], code).astype(np.uint8)
    ends = np.cumsum(length)
    out, now, at = np.empty(int(ends[-1]) if n else 0, np.uint8), np.arange(n), ends - 1
    left = length
    while len(now):
        out[at] = last[now]
        deeper = np.flatnonzero(left > 1)
        now, at, left = parent[now[deeper]], at[deeper] - 1, left[deeper] - 1
    return out[:count]


def interlaced(samples: np.ndarray) -> np.ndarray:
    """Rows in their places, from the four passes."""
    order = np.concatenate([np.arange(start, len(samples), step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(samples)
    out[order] = samples
    return out


def decode(data: bytes) -> Gif:
    """Everything a GIF stores; ValueError if it is none."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, everywhere = 13, None
    if flags & 0x80:
        everywhere = np.frombuffer(data[at : at + 3 * (2 << (flags & 7))], np.uint8)
        at += 3 * (2 << (flags & 7))
    gif = Gif(width, height, background, [], True)
    control = (0, 0, None)

    def sub_blocks(at: int) -> tuple[bytes, int, bool]:
        parts = []
        while at < len(data):
            n = data[at]
            if not n:
                return b"".join(parts), at + 1, True
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at, False

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            gif.truncated = False
            break
        if kind == 0x21 and at + 2 < len(data):
            label = data[at + 1]
            body, at, whole = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None)
            if not whole:
                break
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = everywhere
            if local & 0x80:
                palette = np.frombuffer(data[at : at + 3 * (2 << (local & 7))], np.uint8)
                at += 3 * (2 << (local & 7))
            if at >= len(data) or palette is None or len(palette) % 3:
                break
            size = data[at]
            body, at, whole = sub_blocks(at + 1)
            samples = lzw(body, size, w * h) if 1 <= size <= 11 else np.zeros(0, np.uint8)
            if len(samples) < w * h:
                break
            samples = samples.reshape(h, w)
            gif.frames.append(Frame(left, top, w, h, control[1], control[0], control[2], palette.reshape(-1, 3), interlaced(samples) if local & 0x40 else samples))
            control = (0, 0, None)
            if not whole:
                break
        else:
            break
    return gif


def composed(gif: Gif) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in hundredths of a second, delay, red-green-blue-alpha canvas) of each frame, with transparency and disposal."""
    canvas, time = np.zeros((gif.height, gif.width, 4), np.uint8), 0
    for f in gif.frames:
        saved = canvas.copy() if f.disposal == 3 else None
        rows, columns = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        part = f.samples[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        seen = np.ones(part.shape, bool) if f.transparent is None else part != f.transparent
        canvas[rows, columns][seen] = colours[part[seen]]
        yield time, f.delay, canvas.copy()
        time += f.delay
        if f.disposal == 2:
            canvas[rows, columns] = 0
        elif saved is not None:
            canvas = saved


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Visible pixels by bins of red, green and blue, one after the other."""
    seen = canvas[canvas[..., 3] > 0][:, :3]
    return np.concatenate([np.bincount(seen[:, c] >> (8 - bins.bit_length() + 1), minlength=bins) for c in range(3)])


FRAMES = "media_id long, frame int, start_cs int, delay_cs int, width int, height int, red array<long>, green array<long>, blue array<long>, pixels binary"


def frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            if data is not None:
                gif = decode(data)
                for i, (start, delay, canvas) in enumerate(composed(gif)):
                    h = histogram(canvas).tolist()
                    rows.append({"media_id": name, "frame": i, "start_cs": start, "delay_cs": delay, "width": gif.width, "height": gif.height, "red": h[:BINS], "green": h[BINS : 2 * BINS], "blue": h[2 * BINS :], "pixels": canvas.tobytes()})
            if rows:
                kinds = [("media_id", pa.int64()), *((n, pa.int32()) for n in ("frame", "start_cs", "delay_cs", "width", "height")), *((n, pa.list_(pa.int64())) for n in ("red", "green", "blue")), ("pixels", pa.binary())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def frames(media: DataFrame) -> DataFrame:
    """(media_id, media) GIFs to a row per frame, timed and composed, with colour histograms; null media has none."""
    return media.select("media_id", "media").mapInArrow(frame_rows, FRAMES)


def stored(text: str | None) -> tuple[bytes, int]:
    """A text as a GIF, and its length in bytes."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    samples = np.zeros(rows * WIDTH, np.uint8)
    samples[: len(raw)] = np.frombuffer(raw, np.uint8)
    return encode([samples[a * WIDTH : (a + ROWS) * WIDTH].reshape(-1, WIDTH) for a in range(0, rows, ROWS)]), len(raw)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        texts = batch.column(1)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            media, n = stored(texts[i].as_py())
            gif = decode(media)
            grey, cs, shown = np.zeros(BINS, np.int64), 0, []
            for f, (start, delay, canvas) in zip(gif.frames, composed(gif), strict=True):
                painted = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                grey += histogram(painted)[:BINS]
                shown.append(painted[..., 0].tobytes())  # a grey's red is its sample
                cs = start + delay
            payload = b"".join(shown)
            feature = f"frames={len(gif.frames)};cs={cs};grey={','.join(map(str, grey.tolist()))}"
            for column, value in zip(columns, (doc, n, len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in DIGEST.split(", ")])


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text as a GIF, read back: DIGEST's columns. Payload and feature come from what each frame paints, as composed."""
    return docs.select("doc_id", "text").mapInArrow(digests, DIGEST)


def as_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([stored(t)[0] for t in part.column(1).to_pylist()], pa.binary())], names=["media_id", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(media_id, media): each text as a GIF."""
    return docs.select("doc_id", "text").mapInArrow(as_media, "media_id long, media binary")


def op6_gif(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a GIF and read back."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
