"""Media columns as baseline JPEG.

Reading: markers are parsed, the scan is Huffman-decoded, and the DC coefficients of the
luminance component give a thumbnail at one eighth of the size. All restart segments of a batch
of files are decoded side by side: every numpy step takes one symbol of each segment.

Writing: each byte of a payload is the DC coefficient of one 8x8 block, quantised by 8, so the
block is flat grey of that value and the thumbnail is the payload. A block row is 64 bytes and a
restart segment; AC tables hold only the end-of-block code. Payloads beyond one image's height go
on in further images of the same stream. The true length is kept in a comment.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, utf8

ROW = 64
#: Block rows of one image: its height has to fit into 16 bits.
MAX_ROWS = 8191
QUANT = 8
#: Payload bytes that are encoded or decoded together.
CHUNK = 1 << 19

# Fixed values of the standard: code counts by length and symbols of the luminance DC table.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# Only end-of-block, with a one-bit code.
AC_BITS = (1, *[0] * 15)
AC_SYMBOLS = (0,)

_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the symbol it starts with and its code length (0: none)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes(bits, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)], length[code << (16 - n) : (code + 1) << (16 - n)] = s, n
    return symbol, length


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit counts of a whole flat block for each DC difference -255..255."""
    dc, (eob, eob_n) = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)[0]
    code, count = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix, n = dc[size]
        value = diff if diff >= 0 else diff + (1 << size) - 1
        code[diff + 255], count[diff + 255] = (((prefix << size) | value) << eob_n) | eob, n + size + eob_n
    return code, count


_CODE, _COUNT = _block_codes()


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _header(rows: int, length: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _marker(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _marker(0xFE, b"%d" % length),
        _marker(0xDB, bytes([0, *[QUANT] * 64])),
        _marker(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + b"\x01\x11\0"),
        _marker(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS])),
        _marker(0xC4, bytes([0x10, *AC_BITS, *AC_SYMBOLS])),
        _marker(0xDD, struct.pack(">H", ROW)),
        _marker(0xDA, b"\x01\x01\0\0\x3f\0"),
    ))


def _scans(values: np.ndarray, images: list[int]) -> list[bytes]:
    """The entropy-coded data of images of so many block rows each; values are (rows, ROW) bytes."""
    signed = values.astype(np.int64) - 128
    diff = np.diff(signed, axis=1, prepend=0) + 255
    code, count = _CODE[diff], _COUNT[diff]
    used = count.sum(axis=1)
    row_bytes = (used + 7) >> 3
    first = np.cumsum(row_bytes) - row_bytes
    at = (np.cumsum(count, axis=1) - count + 8 * first[:, None]).ravel()
    wide = code.ravel() << (24 - count.ravel() - (at & 7))
    total = int(row_bytes.sum())
    data = sum(np.bincount((at >> 3) + i, (wide >> (16 - 8 * i)) & 255, total + 3) for i in range(3))[:total].astype(np.int64)
    data[first + row_bytes - 1] |= (1 << ((-used) & 7)) - 1  # padding of ones
    # room for a zero after each FF and a restart marker after each row but an image's last
    row_of = np.repeat(np.arange(len(used)), row_bytes)
    ends = np.cumsum(images)
    marked = np.ones(len(used), np.int64)
    marked[ends - 1] = 0
    stuffed = data == 255
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * (np.cumsum(marked) - marked)[row_of]
    last = place[first + row_bytes - 1] + stuffed[first + row_bytes - 1]
    out = np.zeros(total + int(stuffed.sum()) + 2 * int(marked.sum()), np.uint8)
    out[place] = data
    nth = np.arange(len(used)) - np.repeat(ends - images, images)
    here = marked == 1
    out[last[here] + 1] = 0xFF
    out[last[here] + 2] = 0xD0 + nth[here] % 8
    stops = np.where(here, last + 3, last + 1)[ends - 1]
    starts = np.concatenate([[0], stops[:-1]])
    return [out[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def encode(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    """A JPEG stream for each (payload, true length); payload lengths are multiples of 64."""
    out: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if waiting:
            rows = [len(x) // ROW for _, x in waiting]
            values = np.frombuffer(b"".join(x for _, x in waiting), np.uint8).reshape(-1, ROW)
            for (i, _), n, scan in zip(waiting, rows, _scans(values, rows), strict=True):
                out[i] += [_header(n, payloads[i][1]), scan, b"\xff\xd9"]
        waiting.clear()
        held = 0

    for i, (payload, _) in enumerate(payloads):
        for at in range(0, len(payload), MAX_ROWS * ROW):
            waiting.append((i, payload[at : at + MAX_ROWS * ROW]))
            held += len(waiting[-1][1])
            if held >= CHUNK:
                flush()
    flush()
    return [b"".join(x) for x in out]


@dataclass
class Image:
    """One parsed file: sizes, tables, and where its scan lies."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    #: component id -> (horizontal, vertical sampling, quantisation table)
    parts: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    #: of the scan with the first component, the luminance: (component id, DC table, AC table)
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: bytes = b""
    #: Tables and restart interval as they were at that scan.
    scan_tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    scan_restart: int = 0


def parse(stream: bytes) -> list[Image]:
    """The images of a stream of baseline files, one after the other."""
    at, out = 0, []
    while at < len(stream):
        if stream[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no JPEG at byte {at}")
        at, image = at + 2, Image()
        while stream[at + 1] != 0xD9:
            if stream[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            kind, (size,) = stream[at + 1], struct.unpack_from(">H", stream, at + 2)
            body, at = stream[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                image.comment = body
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    image.tables[body[0]] = (bits, tuple(body[17 : 17 + sum(bits)]))
                    body = body[17 + sum(bits) :]
            elif kind == 0xDD:
                (image.restart,) = struct.unpack(">H", body)
            elif kind == 0xC0:
                depth, image.height, image.width, _ = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError(f"{depth}-bit samples")
                image.parts = {c: (hv >> 4, hv & 15, q) for c, hv, q in zip(body[6::3], body[7::3], body[8::3], strict=True)}
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError(f"marker {kind:02x}: only baseline files are read")
            elif kind == 0xDA:
                scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                stop = _AFTER_SCAN.search(stream, at)
                if stop is None:
                    raise ValueError("the scan has no end")
                if image.parts and scan and scan[0][0] == next(iter(image.parts)):  # other components' scans are passed over
                    image.scan, image.data = scan, stream[at : stop.start()]
                    image.scan_tables, image.scan_restart = dict(image.tables), image.restart
                at = stop.start()
        if not image.scan or not image.width or not image.height:
            raise ValueError("an image without a luminance scan")
        at += 2
        out.append(image)
    return out


def _segments(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """All scans as one array without stuffing and markers; the first byte of each segment."""
    data = np.frombuffer(b"".join(x.data + b"\xff\xd0" for x in images), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    drop = np.zeros(len(data), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    kept = np.cumsum(~drop)
    return data[~drop], np.concatenate([[0], kept[marks[:-1]]]) if len(marks) else np.zeros(0, np.int64)


def _decode_alike(images: list[Image]) -> list[np.ndarray]:
    """The luminance thumbnails of images that share tables, components and restart interval."""
    one, restart = images[0], images[0].scan_restart
    parts = [(i, *one.parts[c][:2], dc, ac) for i, (c, dc, ac) in enumerate(one.scan)]
    tallest, widest = max(v for _, v, _ in one.parts.values()), max(h for h, _, _ in one.parts.values())
    # the luminance's own size in samples; alone in its scan, it is coded block by block
    broad = [(-(-x.width * parts[0][1] // widest), -(-x.height * parts[0][2] // tallest)) for x in images]
    if len(parts) == 1:
        parts = [(0, 1, 1, *parts[0][3:])]
        grids = [(-(-w // 8), -(-h // 8)) for w, h in broad]
    else:
        grids = [(-(-x.width // (8 * widest)), -(-x.height // (8 * tallest))) for x in images]
    order = [(i, dc, ac) for i, h, v, dc, ac in parts for _ in range(h * v)]
    units = [a * b for a, b in grids]
    sizes = np.array([min(restart, n - at) if restart else n for n in units for at in range(0, n, restart or n)])
    data, at = _segments(images)
    if len(at) != len(sizes):
        raise ValueError("restart segments are missing")
    padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    lookups = {k: _lookup(*t) for k, t in one.scan_tables.items()}
    bit = at.astype(np.int64) * 8
    limit = 8 * len(data)

    def symbol(table: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, lengths = lookups[table]
        peek = (window[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF
        n = lengths[peek]
        if not n.all() or (pos >= limit).any():
            raise ValueError("a code that is not in the table")
        return symbols[peek], pos + n

    diffs = [np.zeros((len(sizes), int(sizes.max(initial=0)), h * v), np.int64) for _, h, v, _, _ in parts]
    for unit in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > unit)
        pos, seen = bit[live], defaultdict(int)
        for part, dc, ac in order:
            size, pos = symbol(dc, pos)
            raw = (window[pos >> 3] >> (32 - (pos & 7) - size)) & ((1 << size) - 1)
            pos = pos + size
            diffs[part][live, unit, seen[part]] = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
            seen[part] += 1
            k, left = np.ones(len(live), np.int64), np.arange(len(live))
            while len(left):
                code, moved = symbol(0x10 | ac, pos[left])
                run, size = code >> 4, code & 15
                pos[left] = moved + size
                k[left] += np.where((size == 0) & (run < 15), 64, run + 1)
                left = left[k[left] < 64]
        bit[live] = pos
    _, h, v, _, _ = parts[0]
    dc = np.cumsum(diffs[0].reshape(len(sizes), -1), axis=1).reshape(diffs[0].shape)
    out, seg = [], 0
    for image, (across, down), n, (wide, high) in zip(images, grids, units, broad, strict=True):
        count = -(-n // restart) if restart else 1
        blocks = dc[seg : seg + count].reshape(-1, h * v)[:n] if sizes[seg] == sizes[:].max() else np.concatenate([dc[s, : sizes[s]] for s in range(seg, seg + count)])
        seg += count
        grid = blocks.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        quant = image.quant[image.parts[image.scan[0][0]][2]]
        out.append(np.clip((grid[: -(-high // 8), : -(-wide // 8)] * quant + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image, at one eighth of its size."""
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i, x in enumerate(images):
        alike[repr((x.scan_tables, x.scan, x.parts, x.scan_restart)),].append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for same in alike.values():
        batch, held = [], 0
        for i in [*same, -1]:
            if i >= 0:
                batch.append(i)
                held += len(images[i].data)
            if batch and (i < 0 or held >= CHUNK):
                for j, thumb in zip(batch, _decode_alike([images[j] for j in batch]), strict=True):
                    out[j] = thumb
                batch, held = [], 0
    return out


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8x8 grid of means lies above the grid's mean."""
    cells = thumb.astype(np.int64)
    for axis in (0, 1):
        n = cells.shape[axis]
        first = np.arange(8) * n // 8
        last = np.maximum((np.arange(8) + 1) * n // 8, first + 1)
        sums = np.concatenate([np.zeros_like(cells.take([0], axis)), np.cumsum(cells, axis=axis)], axis=axis)
        # means are kept in fixed point so that equal thumbnails hash alike everywhere
        shape = (-1, 1) if axis == 0 else (1, -1)
        cells = ((sums.take(last, axis) - sums.take(first, axis)) << 12 >> (0 if axis == 0 else 12)) // (last - first).reshape(shape)
    return np.packbits(cells.ravel() * 64 > cells.sum()).tobytes().hex()


_READ = "struct<payload: binary, n_bytes: bigint, feature: string, error: string>"
#: What a damaged or foreign file raises while it is read.
_BAD = (ValueError, IndexError, KeyError, struct.error)


def _read(images: list[Image], thumbs: list[np.ndarray]) -> dict:
    """The features of one stream; the true length is null where a file of another make has none."""
    length = int(images[0].comment) if images[0].comment.isdigit() else None
    return {"payload": b"".join(t.tobytes() for t in thumbs), "n_bytes": length, "feature": "+".join(f"{x.width}x{x.height}:{thumb_hash(t)}" for x, t in zip(images, thumbs, strict=True)), "error": None}


def read_streams(streams: list[bytes | None]) -> list[dict]:
    """Features of each stream, or nulls and an error; good streams are decoded together."""
    out: list[dict | None] = [None] * len(streams)
    good: dict[int, list[Image]] = {}
    for i, data in enumerate(streams):
        try:
            if not data:
                raise ValueError("no media")
            good[i] = parse(data)
        except _BAD as e:
            out[i] = _failed(e)
    try:
        thumbs = iter(thumbnails([image for images in good.values() for image in images]))
        for i, images in good.items():
            out[i] = _read(images, [next(thumbs) for _ in images])
    except _BAD:  # one of them is damaged: each is decoded on its own
        for i, images in good.items():
            try:
                out[i] = _read(images, thumbnails(images))
            except _BAD as e:
                out[i] = _failed(e)
    return out


def _failed(e: Exception) -> dict:
    return {"payload": None, "n_bytes": None, "feature": None, "error": f"{type(e).__name__}: {e}"}


def _decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("payload", pa.binary()), ("n_bytes", pa.int64()), ("feature", pa.string()), ("error", pa.string())])
    for batch in batches:
        yield pa.array([row for part in texts(batch) for row in read_streams(part)], kind)


def _encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([x for part in texts(batch) for x in encode([(payload_of(t), len(t)) for t in part])], pa.binary())


def media(text: str | Column) -> Column:
    """The stored form of a text: a JPEG stream. Null counts as empty; equal texts have equal streams."""
    return F.arrow_udf(_encode_batches, "binary").asNondeterministic()(utf8(text))


def read_media(column: str | Column) -> Column:
    """(payload, n_bytes, feature, error) read from a stored stream.

    A null, empty, truncated or foreign value gives nulls and an error, and the rows beside it stay as
    they are. A file of another make has no true length, so n_bytes is null there.
    """
    return F.arrow_udf(_decode_batches, _READ).asNondeterministic()(column)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media, payload, n_bytes, feature): a row per row of ``docs``, without a shuffle.

    feature has the dimensions and thumbnail hash of each image, joined by "+" where a very long
    text takes several. Null and empty texts are 64 zero bytes; equal texts have equal streams.
    An empty table gives an empty result; other columns are not read.
    """
    stored = docs.select(F.col(id_col).alias("id"), media(text_col).alias("media"))
    read = stored.select("id", "media", read_media("media").alias("read"))
    return read.select("id", "media", "read.payload", "read.n_bytes", "read.feature")
