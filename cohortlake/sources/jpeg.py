"""JPEG frames of images: baseline with Huffman codes, and lossless with the first predictor."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the standard: the order of coefficients in a block, as places in row-major order.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    """Reads codes from entropy-coded data whose stuffed zeros are gone."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0
        self.data = data + bytes(8)

    def peek(self) -> int:
        byte, bit = divmod(self.at, 8)
        return (int.from_bytes(self.data[byte : byte + 4], "big") >> (16 - bit)) & 0xFFFF

    def code(self, table: tuple[list[int], list[int]]) -> int:
        window = self.peek()
        n = table[1][window]
        if not n or self.at >= self.size:
            raise ValueError("a code that is not in the table")
        self.at += n
        return table[0][window]

    def signed(self, n: int) -> int:
        if n == 0:
            return 0
        byte, bit = divmod(self.at, 8)
        raw = (int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - bit - n)) & ((1 << n) - 1)
        self.at += n
        return raw if raw >> (n - 1) else raw - (1 << n) + 1


class _File:
    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[list[int], list[int]]] = {}
        self.restart, self.kind, at = 0, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            kind, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = self._lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind in (0xC0, 0xC1, 0xC3):
                self.kind = kind
                self.depth, self.rows, self.cols, _ = struct.unpack_from(">BHHB", body)
                self.parts = {c: (hv >> 4, hv & 15, q) for c, hv, q in zip(body[6::3], body[7::3], body[8::3], strict=True)}
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError(f"no codec for JPEG marker {kind:02x}")
            elif kind == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
                self.segments = self._segments(data, at)
                break
        if len(self.scan) != len(self.parts):
            raise ValueError("components in scans of their own")

    @staticmethod
    def _lookup(bits: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
        symbol, length, code, at = [0] * 65536, [0] * 65536, 0, 0
        for n, count in enumerate(bits, 1):
            for _ in range(count):
                low, high = code << (16 - n), (code + 1) << (16 - n)
                symbol[low:high], length[low:high] = [symbols[at]] * (high - low), [n] * (high - low)
                code, at = code + 1, at + 1
            code <<= 1
        return symbol, length

    @staticmethod
    def _segments(data: bytes, at: int) -> list[bytes]:
        """The entropy-coded segments, cut at restart markers, stuffed zeros left out."""
        out, start = [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("the scan has no end")
            if 0xD0 <= data[at + 1] <= 0xD7:
                out.append(data[start:at])
                start = at + 2
            elif data[at + 1] not in (0, 0xFF):
                return [x.replace(b"\xff\0", b"\xff") for x in [*out, data[start:at]]]
            at += 2 if data[at + 1] != 0xFF else 1


def _checked(data: bytes, rows: int, cols: int, samples: int, kinds: tuple[int, ...]) -> _File:
    file = _File(data)
    if file.kind not in kinds or (file.rows, file.cols, len(file.parts)) != (rows, cols, samples):
        raise ValueError(f"a JPEG of {file.rows}x{file.cols}x{len(file.parts)}, kind {file.kind:02x}")
    return file


def decode(data: bytes, rows: int, cols: int, samples: int) -> bytes:
    """Interleaved 8-bit samples of a baseline file; three components become red, green and blue."""
    file = _checked(data, rows, cols, samples, (0xC0, 0xC1))
    wide, high = max(h for h, _, _ in file.parts.values()), max(v for _, v, _ in file.parts.values())
    if samples == 1:
        wide = high = 1
    across, down = -(-cols // (8 * wide)), -(-rows // (8 * high))
    parts = [(1, 1, q) if samples == 1 else (h, v, q) for h, v, q in file.parts.values()]
    blocks = [np.zeros((down * v, across * h, 64), np.int64) for h, v, _ in parts]
    every, unit = iter(file.segments), 0
    while unit < across * down:
        bits, last = _Bits(next(every, b"")), [0] * samples
        for unit in range(unit, min(across * down, unit + (file.restart or across * down))):
            row, col = divmod(unit, across)
            for k, ((h, v, _), (_, dc, ac)) in enumerate(zip(parts, file.scan, strict=True)):
                for j in range(h * v):
                    block = blocks[k][row * v + j // h, col * h + j % h]
                    last[k] += bits.signed(bits.code(file.tables[dc]))
                    block[0], i = last[k], 1
                    while i < 64:
                        run, size = divmod(bits.code(file.tables[16 | ac]), 16)
                        if size == 0 and run < 15:
                            break
                        i += run
                        if size:
                            if i > 63:
                                raise ValueError("too many coefficients")
                            block[_ZIGZAG[i]] = bits.signed(size)
                        i += 1
        unit += 1
    planes = []
    for coded, (h, v, q) in zip(blocks, parts, strict=True):
        scale = np.zeros(64)
        scale[_ZIGZAG] = file.quant[q]
        coefficients = (coded * scale).reshape(*coded.shape[:2], 8, 8)
        pixels = np.einsum("xu,abuv,yv->axby", _COS, coefficients, _COS).reshape(coded.shape[0] * 8, -1) + 128
        planes.append(pixels.repeat(high // v, axis=0).repeat(wide // h, axis=1)[:rows, :cols])
    if samples == 3:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue]
    return np.clip(np.rint(np.stack(planes, axis=-1)), 0, 255).astype(np.uint8).tobytes()


def decode_lossless(data: bytes, rows: int, cols: int, samples: int, bits: int) -> bytes:
    """Interleaved samples of a lossless file whose predictor is the sample to the left."""
    file = _checked(data, rows, cols, samples, (0xC3,))
    if file.predictor != 1 or file.restart % cols:
        raise ValueError(f"no codec for predictor {file.predictor}")
    diffs, at, every = np.zeros((rows * cols, samples), np.int64), 0, iter(file.segments)
    tables = [file.tables[dc] for _, dc, _ in file.scan]
    starts = []
    while at < rows * cols:
        reader = _Bits(next(every, b""))
        starts.append(at // cols)
        for at in range(at, min(rows * cols, at + (file.restart or rows * cols))):
            for k, table in enumerate(tables):
                size = reader.code(table)
                diffs[at, k] = 32768 if size == 16 else reader.signed(size)
        at += 1
    out = diffs.reshape(rows, cols, samples)
    for first, end in zip(starts, [*starts[1:], rows], strict=True):
        part = out[first:end]
        part[0, 0] += 1 << (file.depth - 1)
        part[:, 0] = np.cumsum(part[:, 0], axis=0)  # a row begins from the sample above
        np.cumsum(part, axis=1, out=part)
    return (out & 0xFFFF).astype("<u2" if bits > 8 else np.uint8).tobytes()
