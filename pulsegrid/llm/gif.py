"""GIF files as media columns: bytes stored as frames, and frames read back with their times and colour histograms.

`store` writes any bytes as a GIF of grey samples; `read_back` reads such a column again; `frames` gives a row for each
timed frame of any GIF column. The reader takes LZW code streams of any code size, global and local palettes, interlaced
rows, transparency and the four ways of disposal.

Null text counts as empty; the payload is then 64 zero bytes. Long payloads take several frames. A null or damaged GIF, or
one whose screen has more than `MOST_PIXELS`, has no frames in `frames` and null results in `read_back`; blocks that end
early are damage. Frames are shown one after another, so memory holds a screen or two. Repeated rows are treated each for
itself; an empty table gives an empty table. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, slices

WIDTH, HEIGHT, DELAY = 64, 1024, 10
BINS = 16
#: Pixels of a screen that is drawn, 3 bytes each: a file of a few bytes can ask for 4 billion.
MOST_PIXELS = 1 << 26
FULL = 4096

_STORED = T.StructType([T.StructField("media", T.BinaryType())])
_READ = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("n_frames", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("histogram", T.ArrayType(T.LongType())),
    ]
)
_HIST = T.ArrayType(T.LongType())
_FRAMES = T.StructType(
    [
        T.StructField(n, t) for n,
        t in [
            ("frame", T.IntegerType()),
            ("start_ms", T.LongType()),
            ("duration_ms", T.LongType()),
            ("width", T.IntegerType()),
            ("height", T.IntegerType()),
            ("rgb", T.BinaryType()),
            ("hist_red", _HIST),
            ("hist_green", _HIST),
            ("hist_blue", _HIST),
        ]
    ]
)


class Frame(NamedTuple):
    delay_ms: int
    box: tuple[int, int, int, int]
    """Left, top, right and bottom of what the frame drew."""
    canvas: np.ndarray
    """height x width x 3"""


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of each of the first n codes after a clear code: by how many entries the reader has then."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.frexp(entries.astype(np.float64))[1]))


_WIDTHS = {bits: _widths(2 * FULL, bits) for bits in range(2, 9)}


def lzw_pack(samples: bytes) -> bytes:
    """8-bit samples as an LZW code stream."""
    out, runs, known, free = [256], [], {}, 258
    get, put = known.get, out.append
    prefix = samples[0]
    for b in samples[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        known[key] = free
        free += 1
        prefix = b
        if free == FULL:
            put(256)
            runs.append(len(out))
            known.clear()
            free = 258
    put(prefix)
    put(257)
    starts = [1, *runs]
    widths = np.concatenate([[9], *(_WIDTHS[8][: b - a] for a, b in zip(starts, [*runs, len(out)], strict=True))])
    at = np.cumsum(widths) - widths
    spread = np.array(out, dtype=np.int64) << (at & 7)
    byte = at >> 3
    size = int(at[-1] + widths[-1] + 7) >> 3
    total = sum(np.bincount(byte + i, weights=(spread >> (8 * i)) & 255, minlength=size + 2) for i in range(3))
    return total[:size].astype(np.uint8).tobytes()


def lzw_unpack(packed: bytes, bits: int) -> bytes:
    """The samples of a code stream. The width of a code depends on its place after a clear code alone, so the codes up to
    the next clear code are cut out together."""
    clear = 1 << bits
    data = np.frombuffer(packed + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    words = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    limit, at, out = len(packed) * 8, 0, []
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at + bits + 1 <= limit:
        n = min(2 * FULL, (limit - at) // (bits + 1) + 1)
        while True:
            widths = _WIDTHS[bits][:n] if n <= 2 * FULL else np.concatenate([_WIDTHS[bits], np.full(n - 2 * FULL, 12)])
            ends = np.cumsum(widths) + at
            n_whole = int(np.searchsorted(ends, limit, side="right"))
            place = (ends - widths)[:n_whole]
            codes = (words[place >> 3] >> (place & 7)) & ((1 << widths[:n_whole]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or n_whole < n:
                break
            n *= 2
        run = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        table = roots.copy()
        add, put = table.append, out.append
        before = b""
        for code in run:
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("a code that is not there yet")
            put(entry)
            if before and len(table) < FULL:
                add(before + entry[:1])
            before = entry
        if not len(stop) or codes[stop[0]] == clear + 1:
            break
        at = int(ends[stop[0]])
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def write(payload: bytes) -> bytes:
    """A GIF of grey frames of 64 samples a row; the payload is a multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, HEIGHT), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, HEIGHT):
        part = payload[top * WIDTH : (top + HEIGHT) * WIDTH]
        out += [
            b"\x21\xf9\x04",
            struct.pack("<BHB", 1 << 2, DELAY, 0),
            b"\0",
            b"\x2c",
            struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0),
            b"\x08",
            _blocks(lzw_pack(part)),
        ]
    return b"".join([*out, b"\x3b"])


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        return np.frombuffer(self.take(3 * (2 << (flags & 7))), dtype=np.uint8).reshape(-1, 3) if flags & 0x80 else None


def read(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as they are shown."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = r.unpack("<HHBBB")
    if width * height > MOST_PIXELS:
        raise ValueError("a screen that is too large")
    common = r.palette(flags)
    ground = common[background] if common is not None and background < len(common) else np.zeros(3, dtype=np.uint8)
    canvas = np.empty((height, width, 3), dtype=np.uint8)
    canvas[:] = ground
    delay, disposal, clear = 0, 0, None
    while (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = r.take(1), r.blocks()
            if label == b"\xf9":
                if len(body) < 4:
                    raise ValueError("a control block that is too short")
                how, ticks, index = struct.unpack("<BHB", body[:4])
                delay, disposal, clear = ticks * 10, how >> 2 & 7, index if how & 1 else None
            continue
        if kind != b"\x2c":
            raise ValueError("an unknown block")
        left, top, w, h, flags = r.unpack("<HHHHB")
        palette = own if (own := r.palette(flags)) is not None else common
        bits = r.take(1)[0]
        if palette is None or not 2 <= bits <= 8 or left + w > width or top + h > height:
            raise ValueError("a frame that cannot be drawn")
        index = np.frombuffer(lzw_unpack(r.blocks(), bits)[: w * h], dtype=np.uint8)
        if len(index) < w * h:
            raise ValueError("too few samples")
        index = index.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            index = index[np.argsort(order)]
        old, box = canvas.copy() if disposal == 3 else None, (slice(top, top + h), slice(left, left + w))
        full = np.zeros((256, 3), dtype=np.uint8)
        full[: len(palette)] = palette
        drawn = full[index]
        canvas[box] = drawn if clear is None else np.where((index == clear)[..., None], canvas[box], drawn)
        yield Frame(delay, (left, top, left + w, top + h), canvas.copy())
        if disposal == 2:
            canvas[box] = ground
        elif old is not None:
            canvas = old
        delay, disposal, clear = 0, 0, None


def histogram(samples: np.ndarray) -> np.ndarray:
    return np.bincount((samples >> 4).ravel(), minlength=BINS)


def store(docs: DataFrame, payload: Column) -> DataFrame:
    """docs with media: the payload (bytes, a multiple of 64 of them) as a GIF."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if p is None else write(p) for p in batch.column(0).to_pylist()], pa.binary())]

    return add_columns(docs, {"payload": payload}, _STORED, run)


def read_back(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored with the payload that its frames show, their number and time, and the histogram of all samples."""

    def one(data: bytes | None) -> tuple:
        try:
            samples, time, counts = [], 0, np.zeros(BINS, dtype=np.int64)
            for f in read(data or b""):
                some = f.canvas[f.box[1] : f.box[3], f.box[0] : f.box[2], 0]
                samples.append(some.tobytes())
                time += f.delay_ms
                counts += histogram(some)
        except ValueError:
            return None, None, None, None
        return b"".join(samples), len(samples), time, counts.tolist()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [one(x) for x in batch.column(0).to_pylist()]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return add_columns(stored, {"media": media}, _READ, run)


def _sound(data: bytes | None) -> bool:
    """Whether a file can be read to its end."""
    try:
        for _ in read(data or b""):
            pass
    except ValueError:
        return False
    return True


def frames(stored: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each frame: key, its number and time, the canvas as it is shown, and a histogram of each colour."""
    schema = T.StructType([stored.schema[key], *_FRAMES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for name, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                start = 0
                for i, f in enumerate(read(data) if _sound(data) else ()):
                    height, width, _ = f.canvas.shape
                    hists = {f"hist_{c}": histogram(f.canvas[..., k]).tolist() for k, c in enumerate(("red", "green", "blue"))}
                    row = {
                        key: name.as_py(),
                        "frame": i,
                        "start_ms": start,
                        "duration_ms": f.delay_ms,
                        "width": width,
                        "height": height,
                        "rgb": f.canvas.tobytes(),
                    } | hists
                    start += f.delay_ms
                    yield pa.RecordBatch.from_pylist([row], schema=_arrow(batch.schema.field(0).type, key))

    return stored.select(key, media).mapInArrow(run, schema)


def _arrow(kind: pa.DataType, key: str) -> pa.Schema:
    hist = pa.list_(pa.int64())
    return pa.schema(
        [
            (key, kind),
            ("frame", pa.int32()),
            ("start_ms", pa.int64()),
            ("duration_ms", pa.int64()),
            ("width", pa.int32()),
            ("height", pa.int32()),
            ("rgb", pa.binary()),
            ("hist_red", hist),
            ("hist_green", hist),
            ("hist_blue", hist),
        ]
    )
