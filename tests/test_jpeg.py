import math
import random

import numpy as np
import pytest

from cohortlake.sources import dicom, jpeg

# sixteen codes of eight bits: sizes 0..8 for differences, and some runs
DC = bytes(range(12))
AC = bytes([0x00, 0x01, 0x02, 0x13, 0x25, 0xF0])


def codes(symbols):
    return {s: format(i, "08b") for i, s in enumerate(symbols)}


def number(value):
    n = abs(value).bit_length()
    return n, format(value if value >= 0 else value + (1 << n) - 1, f"0{n}b") if n else ""


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def table(kind, symbols):
    return segment(0xC4, bytes([kind, *[0] * 7, len(symbols), *[0] * 8]) + symbols)


def frame(kind, rows, cols, parts, scans, predictor=0, restart=0, depth=8):
    head = b"\xff\xd8" + segment(0xDB, bytes([0, *range(1, 65)])) + segment(kind, bytes([depth]) + rows.to_bytes(2, "big") + cols.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in parts))
    head += table(0, DC) + table(0x10, AC) + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    head += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c, _, _ in parts) + bytes([predictor, 63 * (not predictor), 0]))
    return head + b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(scans) else b"") for i, s in enumerate(scans)) + b"\xff\xd9"


def idct(block):
    c = lambda u: math.sqrt(0.125) if u == 0 else 0.5
    return [[sum(c(u) * c(v) * block[u][v] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]


ORDER = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)]


def coded(r, last):
    """(bits, coefficients, the DC value) of a random block."""
    dc, block = r.randint(-200, 200), [[0] * 8 for _ in range(8)]
    n, raw = number(dc - last)
    bits, at = codes(DC)[n] + raw, 1
    block[0][0] = dc * 1
    for symbol in r.choices([0x01, 0x02, 0x13], k=3):
        run, size = divmod(symbol, 16)
        value = r.choice([1, -1]) * r.randint(1 << (size - 1), (1 << size) - 1)
        at += run
        u, v = ORDER[at]
        block[u][v] = value * (at + 1)  # the table's entries are 1, 2, 3, ... in coded order
        bits += codes(AC)[symbol] + number(value)[1]
        at += 1
    return bits + codes(AC)[0], block, dc


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_grey(restart):
    r, scans, bits, last, want = random.Random(restart), [], "", 0, np.zeros((16, 24))
    for unit in range(6):
        if restart and unit and unit % restart == 0:
            scans.append(packed(bits))
            bits, last = "", 0
        more, block, last = coded(r, last)
        bits += more
        want[unit // 3 * 8 : unit // 3 * 8 + 8, unit % 3 * 8 : unit % 3 * 8 + 8] = idct(block)
    data = frame(0xC0, 13, 20, [(1, 1, 1)], [*scans, packed(bits)], restart=restart)
    got = np.frombuffer(jpeg.decode(data, 13, 20, 1), np.uint8).reshape(13, 20)
    assert np.abs(got.astype(int) - np.clip(np.rint(want + 128), 0, 255)[:13, :20]).max() <= 1


def test_baseline_colour_with_subsampling():
    r, bits, last, planes = random.Random(3), "", [0, 0, 0], [np.zeros((16, 16)), np.zeros((8, 8)), np.zeros((8, 8))]
    for k, n in ((0, 4), (1, 1), (2, 1)):
        for j in range(n):
            more, block, last[k] = coded(r, last[k])
            bits += more
            planes[k][j // 2 * 8 : j // 2 * 8 + 8, j % 2 * 8 : j % 2 * 8 + 8] = idct(block)
    y, b, c = planes[0] + 128, planes[1].repeat(2, 0).repeat(2, 1), planes[2].repeat(2, 0).repeat(2, 1)
    want = np.clip(np.rint(np.stack([y + 1.402 * c, y - 0.344136 * b - 0.714136 * c, y + 1.772 * b], -1)), 0, 255)
    got = np.frombuffer(jpeg.decode(frame(0xC0, 16, 16, [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [packed(bits)]), 16, 16, 3), np.uint8).reshape(16, 16, 3)
    assert np.abs(got.astype(int) - want).max() <= 1


@pytest.mark.parametrize(("depth", "restart"), [(8, 0), (12, 7), (16, 14)])
def test_lossless(depth, restart):
    r = random.Random(depth)
    image = [[min((1 << depth) - 1, max(0, (1 << depth - 1) + r.randint(-500, 500))) for _ in range(7)] for _ in range(6)]
    scans, bits = [], ""
    for at in range(42):
        row, col = divmod(at, 7)
        begins = restart and at % restart == 0
        if begins and at:
            scans.append(packed(bits))
            bits = ""
        left = image[row][col - 1] if col else 1 << depth - 1 if not row or begins else image[row - 1][0]
        n, raw = number(image[row][col] - left)
        bits += codes(DC)[n] + raw
    data = frame(0xC3, 6, 7, [(1, 1, 1)], [*scans, packed(bits)], 1, restart, depth)
    got = jpeg.decode_lossless(data, 6, 7, 1, 8 if depth == 8 else 16)
    assert np.frombuffer(got, np.uint8 if depth == 8 else "<u2").reshape(6, 7).tolist() == image


def test_what_is_refused():
    with pytest.raises(ValueError):
        jpeg.decode(b"GIF", 1, 1, 1)
    with pytest.raises(ValueError):
        jpeg.decode(frame(0xC0, 8, 8, [(1, 1, 1)], [b"\xfe\xfe"]), 8, 8, 1)
    with pytest.raises(ValueError):
        jpeg.decode(frame(0xC0, 8, 8, [(1, 1, 1)], [b"\0"]), 9, 8, 1)


def test_codecs_by_transfer_syntax():
    reader = dicom._Reader(b"")
    reader.fragments = [b"abc", b"def"]
    row = {"rows": 1, "cols": 3, "samples": 1, "frames": 2, "bits": 8}
    assert dicom._decoded(reader, row, "1.2.3", 0, {"1.2.3": lambda data, row: data.upper()}) == b"ABCDEF"
    with pytest.raises(ValueError, match="no codec"):
        dicom._decoded(reader, row, "1.2.4", 0, {})
