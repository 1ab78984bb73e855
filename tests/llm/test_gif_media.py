import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from helpers import docs, empty

from palimpsest.llm import gif_media as g


def payload_of(text):
    data = (text or "").encode()
    return data.ljust(max(-(-len(data) // 192), 1) * 192)


@pytest.mark.parametrize("data", [bytes(192), bytes(range(192)) * 100, b"ab" * 96 * 200, random.Random(0).randbytes(192 * 400)])
def test_round_trip(data):
    frames = g.decode(g.encode(data))
    assert b"".join(f.samples for f in frames) == data
    assert [f.disposal for f in frames] == [1 + i % 2 for i in range(len(frames))]


def plain_lzw(codes, code_size):
    """A literal decoder of one clear-to-clear run, to compare with."""
    table = [bytes([i]) for i in range(1 << code_size)] + [b"", b""]
    out, last = [], None
    for c in codes:
        entry = table[c] if c < len(table) else last + last[:1]
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
    return b"".join(out)


@pytest.mark.parametrize("code_size", [2, 4, 8])
def test_decoder_of_other_code_sizes_and_full_tables(code_size):
    r = random.Random(code_size)
    clear, n = 1 << code_size, 9000  # beyond a full table without a clear code
    codes, size = [r.randrange(clear)], clear + 2
    for _ in range(n - 1):
        codes.append(r.choice([r.randrange(clear), r.randrange(clear + 2, size + 1) if size > clear + 2 or len(codes) > 1 else 0]) if size < 4096 else r.randrange(clear + 2, 4096))
        size = min(size + 1, 4096)
    want = plain_lzw(codes, code_size)
    widths = np.r_[code_size + 1, np.where(np.arange(n + 1) < 4096 + 512, np.r_[g.code_widths(4096 + 512, code_size), np.full(n, 12)][: n + 1], 12)]
    stream = g.pack(np.array([clear, *codes, clear + 1]), widths)
    assert g.lzw_decode(stream, code_size, len(want)) == want


def test_local_palette_interlace_and_disposal():
    """Two frames by hand: the second is interlaced, has its own palette and restores what was before."""
    pal = bytes([0, 0, 0, 255, 255, 255])
    images = lambda x, y, w, h, flags, local, samples: struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + local + b"\x02" + g.blocks(lzw2(samples))

    def lzw2(samples):
        codes = [4]
        for s in samples:
            codes += [s, 4]
        return g.pack(np.array([*codes, 5]), np.full(len(codes) + 1, 3))

    control = lambda disposal, transparent, delay: struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    rows = [0, 2, 4, 1, 3]  # order of the rows of an interlaced image of height 5: 0, 4, 2, 1, 3
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 5, 0x80, 0, 0) + pal
    data += b"\x21\xfe\x03abc\x00"  # a comment is skipped
    data += control(1, None, 5) + images(0, 0, 2, 5, 0, b"", [0] * 10)
    data += control(3, 1, 7) + images(0, 0, 2, 5, 0xC0, bytes([255, 0, 0, 0, 255, 0]), [x for k in (0, 4, 2, 1, 3) for x in ([0, 1] if k % 2 else [1, 1])])
    data += control(0, None, 1) + images(0, 0, 1, 1, 0, b"", [1]) + b"\x3b"
    frames = g.decode(data)
    assert [f.delay_ms for f in frames] == [50, 70, 10] and len(rows) == 5
    black, white, red = 0, 63, 48
    assert frames[0].histogram[black] == 10
    assert frames[1].samples == bytes([1, 1, 0, 1, 1, 1, 0, 1, 1, 1]) and frames[1].histogram[red] == 2 and frames[1].histogram[black] == 8
    assert frames[2].histogram[white] == 1 and frames[2].histogram[black] == 9 and frames[2].histogram[red] == 0
    with pytest.raises(ValueError):
        g.decode(b"PNG")


def test_spark(spark):
    d = docs(spark)
    got = g.digests(d).collect()
    by_text = {r.doc_id: r.text for r in d.collect()}
    assert len(got) == d.count()
    for r in got:
        p = payload_of(by_text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((by_text[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(g.encode(p)), hashlib.sha256(g.encode(p)).hexdigest())
    assert len({r.feature for r in got if r.doc_id == 1}) == 1 and g.digests(empty(spark)).count() == 0
    frames = g.frames(g.store(d)).where("doc_id = 4").first().frames
    assert [f.start_ms for f in frames] == [40 * i for i in range(len(frames))] and sum(frames[-1].histogram) <= 192 * 64
