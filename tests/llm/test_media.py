import random
import zlib

import numpy as np
import pytest

from cohortlake.llm import media

TEXTS = [b"", b"a", bytes(64), b"\xff" * 700, bytes(range(256)) * 9, "é𝒳".encode() * 100, b"x" * 63, random.Random(1).randbytes(media.ROW * media.MAX_ROWS + 5000)]


def test_round_trip_and_padding():
    streams = media.encode([(media.payload_of(t), len(t)) for t in TEXTS])
    for text, stream in zip(TEXTS, streams, strict=True):
        images = media.parse(stream)
        payload = b"".join(t.tobytes() for t in media.thumbnails(images))
        assert len(payload) % 64 == 0 and len(payload) == max(64, -(-len(text) // 64) * 64)
        assert payload == text + bytes(len(payload) - len(text)) and int(images[0].comment) == len(text)
    assert len(media.parse(streams[-1])) == 2


def written(diffs, tables, comps, width, height, restart=0, quant=3):
    """A small file from DC differences and AC symbols per block, bit by bit."""
    codes = {k: media._codes(*t) for k, t in tables.items()}
    bits, out = "", b""

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""
        bits = ""

    def put(value, n):
        nonlocal bits
        bits += format(value, f"0{n}b") if n else ""

    for unit, blocks in enumerate(diffs):
        if restart and unit and unit % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
        for diff, ac in blocks:
            size = abs(diff).bit_length()
            put(*codes[0][size])
            put(diff if diff >= 0 else diff + (1 << size) - 1, size)
            for symbol, value in ac:
                put(*codes[16][symbol])
                put(value, symbol & 15)
    flush()
    m = media._marker
    head = b"\xff\xd8" + m(0xDB, bytes([0, *[quant] * 64])) + m(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(comps)]) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in comps))
    for k, (b, s) in tables.items():
        head += m(0xC4, bytes([k, *b, *s]))
    if restart:
        head += m(0xDD, restart.to_bytes(2, "big"))
    return head + m(0xDA, bytes([len(comps)]) + b"".join(bytes([c, 0]) for c, _, _ in comps) + b"\0\x3f\0") + out + b"\xff\xd9"


TABLES = {0: (media.DC_BITS, media.DC_SYMBOLS), 16: ((0, 2, 3, 0, *[0] * 12), (0x00, 0x02, 0xF0, 0x13, 0x51))}


@pytest.mark.parametrize("restart", [0, 2])
def test_colour_with_subsampling_and_ac_codes(restart):
    r = random.Random(restart)
    ac = lambda: [x for s in r.choices([0x02, 0x13, 0x51, 0xF0], k=r.randint(0, 3)) for x in [(s, r.getrandbits(s & 15) if s & 15 else 0)]] + [(0, 0)]
    units = [[(r.randint(-60, 60), ac()) for _ in range(6)] for _ in range(6)]  # 2x2 luminance, two of colour
    stream = written(units, TABLES, [(1, 2, 2), (2, 1, 1), (3, 1, 1)], 44, 30, restart)
    (thumb,) = media.thumbnails(media.parse(stream))
    grid, last = np.zeros((4, 6), int), 0
    for unit, blocks in enumerate(units):
        last = 0 if restart and unit % restart == 0 else last
        for j in range(4):
            last += blocks[j][0]
            grid[unit // 3 * 2 + j // 2, unit % 3 * 2 + j % 2] = last
    assert (thumb == np.clip((grid * 3 + 4) // 8 + 128, 0, 255)[:4, :6]).all()


def test_bad_files_are_refused():
    with pytest.raises(ValueError):
        media.parse(b"GIF89a")
    good = media.encode([(bytes(64), 0)])[0]
    with pytest.raises(ValueError):
        media.parse(good.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_columns(spark):
    rows = [(1, "a", 1), (1, "a", 1), (2, None, 1), (3, "", 1), (None, "é" * 5000, 1)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()
    assert len(got) == 5
    for r in got:
        text = next((t or "").encode() for i, t, _ in rows if i == r.id)
        assert bytes(r.payload) == media.payload_of(text) and r.n_bytes == len(text)
        assert zlib.crc32(bytes(r.payload)[-64:]) == zlib.crc32(media.payload_of(text)[-64:])
    a, b = (r for r in got if r.id == 1)
    assert a == b and a.feature.startswith("512x8:")
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
