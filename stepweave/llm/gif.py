"""GIF media columns: texts stored as grey-scale frames, and frames of any GIF read back.

The reader decodes the LZW code stream, applies global and local palettes, interlacing, transparency and disposal, and
gives each frame with its time and colour histogram.  The writer stores bytes without loss: one byte is one
pixel of a grey palette, 64 pixels are a row, and frames of up to 4096 rows follow each other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.session import materialize

WIDTH, ROWS = 64, 4096
#: Hundredths of a second that a written frame is shown.
DELAY = 10
#: Colour-histogram bins per channel.
BINS = 8
_MOST = 4096  # codes of 12 bits


def _widths(bits: int) -> np.ndarray:
    """Width of the n-th code after a clear code, until the table is full."""
    free = np.maximum(np.arange(_MOST - (1 << bits)) - 1, 0) + (1 << bits) + 2
    return np.minimum(np.floor(np.log2(free)).astype(np.int64) + 1, 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of ``data``; the table starts anew when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    out: list[int] = [clear]
    runs: list[int] = []  # codes in each stretch that follows a clear code
    table: dict[int, int] = {}
    free, mark = end + 1, 1
    add, find = out.append, table.get
    if data:
        prefix = data[0]
        for c in memoryview(data)[1:]:
            key = prefix << 8 | c
            code = find(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = c
            if free < _MOST:
                table[key] = free
                free += 1
            else:
                add(clear)
                runs.append(len(out) - mark)
                mark = len(out)
                table.clear()
                free = end + 1
        add(prefix)
    add(end)
    runs.append(len(out) - mark)
    schedule = _widths(bits)
    longest = max(runs)
    if longest > len(schedule):
        schedule = np.append(schedule, np.full(longest - len(schedule), 12))
    width = np.concatenate([np.array([bits + 1]), *[schedule[:n] for n in runs]])
    codes = np.array(out, np.int64)
    at = np.cumsum(width) - width
    flat = np.zeros(int(at[-1] + width[-1]) + 7 & ~7, np.uint8)
    for b in range(12):
        has = width > b
        flat[at[has] + b] = codes[has] >> b & 1
    return np.packbits(flat, bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """The pixels of a code stream; a stream that breaks off gives what it has."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(stream)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    schedule = _widths(bits)
    offsets = np.cumsum(schedule) - schedule
    out: list[bytes] = []

    def read(at: np.ndarray, width: np.ndarray) -> np.ndarray:
        byte = at >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        return window >> (at & 7) & ((1 << width) - 1)

    start = 0
    done = False
    while not done:
        fits = int(np.searchsorted(offsets + schedule, total - start, side="right"))
        codes = read(start + offsets[:fits], schedule[:fits])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and fits == len(schedule):  # a full table that is used on
            more = (total - start - int(offsets[-1] + schedule[-1])) // 12
            at = start + int(offsets[-1] + schedule[-1]) + 12 * np.arange(more)
            codes = np.append(codes, read(at, np.full(more, 12)))
            stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        done = not len(stop) or codes[n] == end
        if not done:
            start += int(offsets[n] + schedule[n]) if n < len(schedule) else int(offsets[-1] + schedule[-1]) + 12 * (n + 1 - len(schedule))
        if not n:
            continue
        entries = base.copy()
        part = codes[:n].tolist()
        known = entries[part[0]]
        out.append(known)
        add, new = out.append, entries.append
        size = len(entries)
        for code in part[1:]:
            if code < size:
                text = entries[code]
                if size < _MOST:
                    new(known + text[:1])
                    size += 1
            elif code == size and size < _MOST:
                text = known + known[:1]
                new(text)
                size += 1
            else:
                raise ValueError("GIF code stream refers to an unknown string")
            add(text)
            known = text
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    """A GIF of ``payload``, whose length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH:(top + ROWS) * WIDTH]
        codes = lzw_encode(part)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        for i in range(0, len(codes), 255):
            out += [bytes([len(codes[i:i + 255])]), codes[i:i + 255]]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _colours(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours and how often they occur; grey ones, the usual case, without a sort."""
    grey = pixels & 255
    if (pixels == grey * np.uint32(0x010101) + np.uint32(0xFF000000)).all():
        return np.arange(256, dtype=np.uint32) * np.uint32(0x010101) + np.uint32(0xFF000000), np.bincount(grey, minlength=256)
    return np.unique(pixels, return_counts=True)


@dataclass
class Frame:
    """A frame as shown: ``canvas`` is RGBA; the rectangle is where its own pixels lie."""

    number: int
    start_cs: int
    delay_cs: int
    x: int
    y: int
    width: int
    height: int
    disposal: int
    transparent: bool
    canvas: np.ndarray

    def own(self) -> np.ndarray:
        return self.canvas[self.y:self.y + self.height, self.x:self.x + self.width]

    def histogram(self) -> np.ndarray:
        """Counts per channel and bin of the shown opaque pixels of its rectangle."""
        shown = np.ascontiguousarray(self.own()).view("<u4").ravel()
        colours, count = _colours(shown)
        opaque = colours >> 24 > 0
        return np.stack([np.bincount((colours[opaque] >> 8 * k & 255) >> 5, count[opaque], BINS) for k in range(3)]).astype(np.int64)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1:at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composed one after another on its canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    shared = None
    if flags & 0x80:
        shared, at = palette(flags, at)
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    number = clock = 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown GIF block {data[at]:#x}")
        x, y, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if local & 0x80:
            colours, at = palette(local, at)
        stream, after = _blocks(data, at + 1)
        pixels = np.frombuffer(lzw_decode(stream, data[at])[:w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        at = after
        if local & 0x40:  # rows come in four passes
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        if colours is None:
            raise ValueError("GIF frame without a palette")
        full = np.zeros((256, 4), np.uint8)
        full[:len(colours), :3], full[:len(colours), 3] = colours, 255
        before = canvas.copy() if disposal == 3 else None
        area = canvas[y:y + h, x:x + w]
        drawn = full[pixels[:area.shape[0], :area.shape[1]]]
        if clear_index is None:
            area[...] = drawn
        else:
            seen = pixels[:area.shape[0], :area.shape[1]] != clear_index
            area[seen] = drawn[seen]
        yield Frame(number, clock, delay, x, y, w, h, disposal, clear_index is not None, canvas.copy())
        clock += delay
        number += 1
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text as a GIF.  Null texts are empty."""
    def write(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            payload, n = padded(text)
            rows.append((n, encode(payload)))
        return pd.DataFrame(rows, columns=["n_bytes", "media"])

    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(write, kind)(F.col(text_col)).alias("s")).select("id", "s.*")


FRAME_SCHEMA = ("id {kind}, frame long, start_cs long, delay_cs long, x long, y long, width long, height long, disposal long, transparent boolean, "
                "rgba binary, red_hist array<long>, green_hist array<long>, blue_hist array<long>")


def timed_frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row per frame of each GIF: time, place, composed pixels of its rectangle, and colour histograms.  Null media have no frames."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["id"], batch["media"]):
                for f in frames(data) if data is not None else ():
                    red, green, blue = f.histogram()
                    yield pd.DataFrame([{
                        "id": key, "frame": f.number, "start_cs": f.start_cs, "delay_cs": f.delay_cs, "x": f.x, "y": f.y, "width": f.width, "height": f.height,
                        "disposal": f.disposal, "transparent": f.transparent, "rgba": f.own().tobytes(), "red_hist": red, "green_hist": green, "blue_hist": blue}])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInPandas(read, FRAME_SCHEMA.format(kind=dict(rows.dtypes)["id"]))


#: What is stored of a GIF: payload size and digests, and its timed frames with a column per colour histogram.
_FRAME = "struct<frame: long, start_cs: long, delay_cs: long, x: long, y: long, width: long, height: long, disposal: long, transparent: boolean, red_hist: array<long>, green_hist: array<long>, blue_hist: array<long>>"
_READ = f"payload_bytes long, payload_sha256 string, tail_crc32 long, frames array<{_FRAME}>"


def read_back(media: DataFrame) -> DataFrame:
    """``media`` (with a column media) and what each GIF says: its timed frames, and size and digests of the payload.

    The payload is the red channel of all frames in order.  A GIF is decoded once; frames pass one at a time, so memory holds
    a GIF and one canvas.  Null media have no frames and an empty payload.
    """
    def read(gifs: pd.Series) -> pd.DataFrame:
        rows = []
        for data in gifs:
            whole, size, tail, seen = hashlib.sha256(), 0, b"", []
            for f in frames(data) if data is not None else ():
                part = f.own()[..., 0].tobytes()
                whole.update(part)
                size += len(part)
                tail = part[-WIDTH:]
                red, green, blue = f.histogram().tolist()
                seen.append((f.number, f.start_cs, f.delay_cs, f.x, f.y, f.width, f.height, f.disposal, f.transparent, red, green, blue))
            rows.append((size, whole.hexdigest(), zlib.crc32(tail), seen))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "frames"])

    return media.select(*[c for c in media.columns if c not in ("payload_bytes", "payload_sha256", "tail_crc32", "frames")], F.pandas_udf(read, _READ)("media").alias("s")).select("*", "s.*").drop("s")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a GIF in a table of the shared folder, store its timed frames, and compute the features from these.

    ``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``; ``feature`` has frames, time and the three
    histograms.  Null and empty texts are one row of zeros; rows repeated whole are stored each; an empty table gives no
    rows.  A text is held in memory about ten times over (payload, code stream and canvas), so it has to be far smaller than a task.
    """
    media = materialize(stored(docs, id_col, text_col))
    told = [F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    timed = materialize(read_back(media).select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *told, "frames"))
    total = lambda c: F.array_join(F.expr(f"transform(sequence(0, {BINS - 1}), i -> aggregate(frames, 0L, (s, f) -> s + f.{c}[i]))"), ",")
    time = F.expr("aggregate(frames, 0L, (s, f) -> s + f.delay_cs)")
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(";cs="), time, F.lit(";red="), total("red_hist"), F.lit(";green="), total("green_hist"), F.lit(";blue="), total("blue_hist"))
    return timed.select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
