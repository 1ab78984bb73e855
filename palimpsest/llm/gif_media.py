"""Media columns: animated GIF as bytes, decoded to timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a: LZW code streams of all code sizes, global and local palettes, interlacing,
graphic controls (delay, disposal, transparency) and skipped extensions. The encoder stores bytes losslessly as the
8-bit samples of an animation.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import map_arrow, texts_of

#: Width and greatest height of a stored frame, and its delay in hundredths of a second.
WIDTH, HEIGHT, DELAY = 192, 64, 4
#: No UTF-8 text has this byte, so it can be the transparent index without touching any stored sample.
TRANSPARENT = 255
#: Colours fall into 4 x 4 x 4 bins.
COLOUR_BINS = 64
CLEAR_AFTER = 3838  # codes after which the table of 4096 entries is full


def palette() -> np.ndarray:
    """256 colours: red rises with the index, green runs through it in steps of 7, blue falls."""
    i = np.arange(256)
    return np.stack([i, i * 7 % 256, 255 - i], 1).astype(np.uint8)


def code_widths(n: int, code_size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    return np.minimum(12, np.maximum(code_size + 1, np.floor(np.log2((1 << code_size) + 1 + np.arange(n))).astype(np.int64) + 1))


def lzw_encode(data: bytes) -> bytes:
    """GIF's LZW for 8-bit samples; a clear code comes first and whenever the table is full."""
    segments, codes, table, fresh = [], [], {}, 258
    get, put = table.get, codes.append
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = b
        if fresh == 4096:
            segments.append(codes)
            codes, fresh = [], 258
            put = codes.append
            table.clear()
            continue
        table[key] = fresh
        fresh += 1
    if prefix >= 0:
        put(prefix)
    segments.append(codes)
    values, widths = [[256]], [[9]]
    for i, part in enumerate(segments):
        values += [part, [257 if i == len(segments) - 1 else 256]]
        widths.append(code_widths(len(part) + 1, 8))
    return pack(np.concatenate([np.asarray(v, np.int64) for v in values]), np.concatenate([np.asarray(w, np.int64) for w in widths]))


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits as a stream of bits, the lowest first."""
    end = np.cumsum(widths)
    at = end - widths
    shifted = values << (at & 7)
    size = int(-(-end[-1] // 8))
    out = np.zeros(size + 3, np.int64)
    for k in range(3):  # a code touches three bytes at most, and no two codes set the same bit
        out[:size] += np.bincount((at >> 3) + k, (shifted >> (8 * k)) & 255, size + 3)[:size].astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, code_size: int, limit: int) -> bytes:
    """The first ``limit`` samples of a code stream. Widths depend only on the place after a clear code, so codes are cut out in blocks."""
    clear, stop = 1 << code_size, (1 << code_size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    out, size, bit, total_bits = [], 0, 0, len(stream) * 8
    root = [bytes([i]) for i in range(clear)] + [b"", b""]
    block = (1 << 12) + 512
    widths = code_widths(block, code_size)
    while bit < total_bits and size < limit:
        table, seen, last = root.copy(), 0, None
        ended = False
        while not ended:
            w = widths[seen : seen + block] if seen < block else np.full(block, 12)
            end = bit + np.cumsum(w)
            at = end - w
            n = int(np.searchsorted(end, total_bits, "right"))
            if not n:
                bit = total_bits
                break
            at, w = at[:n], w[:n]
            k = at >> 3
            codes = ((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (at & 7)) & ((1 << w) - 1)
            special = np.flatnonzero((codes == clear) | (codes == stop))
            if len(special):
                n, ended = int(special[0]), True
                bit = total_bits if codes[n] == stop else int(end[n])
            else:
                bit = int(end[n - 1])
            put, grow = out.append, table.append
            for code in codes[:n].tolist():
                if last is None:
                    entry = table[code]
                else:
                    if code < len(table):
                        entry = table[code]
                    elif code == len(table):
                        entry = last + last[:1]
                    else:
                        raise ValueError("LZW code outside the table")
                    if len(table) < 4096:
                        grow(last + entry[:1])
                put(entry)
                size += len(entry)
                last = entry
            seen += n
            if size >= limit:
                return b"".join(out)[:limit]
    return b"".join(out)[:limit]


def blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the empty block that ends them."""
    return b"".join(bytes([len(x)]) + x for i in range(0, len(data), 255) if (x := data[i : i + 255])) + b"\0"


def encode(payload: bytes) -> bytes:
    """An animation whose samples are the payload's bytes in order; its length is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    height = min(rows, HEIGHT)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), palette().tobytes()]
    for i, start in enumerate(range(0, len(payload), WIDTH * height)):
        part = payload[start : start + WIDTH * height]
        disposal = 1 + i % 2  # frames stay and are cleared in turn
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | 1, DELAY, TRANSPARENT, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out.append(blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    samples: bytes
    histogram: np.ndarray


def decode(media: bytes) -> list[Frame]:
    """All frames in order, with stored samples, and the histogram of the canvas as shown (pixels never painted count nowhere)."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(media, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
    canvas = np.full((height, width), -1, np.int64)  # bin of each pixel's colour; -1: nothing painted
    frames, delay, disposal, transparent = [], 0, 0, -1

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            label = media[at + 1]
            body, at = joined(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
            continue
        if media[at] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, local = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        colours = shared
        if local & 0x80:
            n = 2 << (local & 7)
            colours, at = np.frombuffer(media, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
        code_size = media[at]
        stream, at = joined(at + 1)
        samples = lzw_decode(stream, code_size, w * h)
        image = np.zeros(w * h, np.uint8)
        image[: len(samples)] = np.frombuffer(samples, np.uint8)
        image = image.reshape(h, w)
        if local & 0x40:
            order = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
            plain = np.empty_like(image)
            plain[order] = image
            image = plain
        bins = np.zeros(256, np.int64)
        if colours is not None:
            c = colours.astype(np.int64) >> 6
            bins[: len(c)] = c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2]
        before = canvas.copy() if disposal == 3 else None
        place = canvas[y : y + h, x : x + w]
        image_seen = image[: place.shape[0], : place.shape[1]]
        np.copyto(place, bins[image_seen], where=image_seen != transparent)
        shown = canvas[canvas >= 0]
        frames.append(Frame(x, y, w, h, delay * 10, disposal, image.tobytes(), np.bincount(shown, minlength=COLOUR_BINS)))
        if disposal == 2:
            place[:] = -1
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1
    return frames


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` and ``media`` binary: each text's UTF-8 bytes (null: none), padded with spaces to a positive multiple of 192, as a GIF."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [t.encode() for t in texts_of(batch.column(1))]
        media = [encode(d.ljust(max(-(-len(d) // WIDTH), 1) * WIDTH)) for d in data]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return map_arrow(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


FRAMES = "array<struct<start_ms: bigint, delay_ms: int, x: int, y: int, width: int, height: int, disposal: int, histogram: array<bigint>>>"


def frames(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of ``df``, with ``payload`` (samples of all frames in order), ``frames`` and ``media_error``.

    Null media give nulls; media that can't be decoded give nulls and the reason. Rows are handled one by one, so repeated
    rows are alike; an empty table stays empty; columns of ``df`` with the names of new ones are replaced.
    """
    df = df.drop("payload", "frames", "media_error")
    names = df.columns
    at = names.index(media)
    fields = ["start_ms", "delay_ms", "x", "y", "width", "height", "disposal", "histogram"]
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), *((f, pa.int32()) for f in fields[1:7]), ("histogram", pa.list_(pa.int64()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, lists, errors = [], [], []
        for m in batch.column(at).to_pylist():
            found, error = None, None
            if m is not None:
                try:
                    found = decode(m)
                except (ValueError, IndexError, struct.error) as e:  # damaged media are errors of their own row
                    error = str(e) or type(e).__name__
            errors.append(error)
            if found is None:
                payloads.append(None)
                lists.append(None)
                continue
            start, rows = 0, []
            for f in found:
                rows.append(dict(zip(fields, (start, f.delay_ms, f.x, f.y, f.width, f.height, f.disposal, f.histogram.tolist()))))
                start += f.delay_ms
            payloads.append(b"".join(f.samples for f in found))
            lists.append(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(lists, kind), pa.array(errors, pa.string())], [*names, "payload", "frames", "media_error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, f"{own}, payload binary, frames {FRAMES}, media_error string")


def digests(docs: DataFrame) -> DataFrame:
    """What the media query returns of each document; ``feature``: number of frames, duration and histogram over all frames.

    A null or empty text is stored as 192 spaces. Repeated rows are alike, a null doc_id is kept, an empty table gives no
    rows; further columns are not read.
    """
    histogram = F.aggregate("frames", F.array_repeat(F.lit(0).cast("bigint"), COLOUR_BINS), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    duration = F.aggregate("frames", F.lit(0).cast("bigint"), lambda acc, f: acc + f["delay_ms"])
    return frames(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.size("frames").cast("string"), duration.cast("string"), F.concat_ws(",", histogram.cast("array<string>"))).alias("feature"),
    )
