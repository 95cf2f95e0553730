"""DICOM files as rows, and rows as DICOM files.

Files are listed and read by Spark's binaryFile source, so any store that Spark reads will do; an
Arrow function parses them. Implicit, explicit and deflated little endian are parsed, undefined
lengths and nested items included; pixels are decoded where they are stored plainly, as RLE, baseline
JPEG or lossless JPEG of the first predictor, or by a codec that is given for their transfer syntax. A
file that can't be read becomes a row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.tags import TEXT_VRS
from ..plans.cohort import Cohort
from . import jpeg

IMPLICIT, EXPLICIT, DEFLATED, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
JPEG_BASELINE, JPEG_LOSSLESS = "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.70"
PIXELS = "7fe0,0010"
# Fixed values of the standard: representations with a four-byte length, with bulk values, and of
# the tags that implicit files and the writer need.
LONG_VRS = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV")
BULK_VRS = ("OB", "OW", "OF", "OD", "OL")
NUMBERS = {"US": "<H", "SS": "<h", "UL": "<I", "SL": "<i", "FL": "<f", "FD": "<d", "UV": "<Q", "SV": "<q"}
VRS = {
    "CS": "0008,0008 0008,0060 0010,0040 0028,0004 0028,0301 0012,0062 0008,0005 0008,0102",
    "UI": "0008,0016 0008,0018 0020,000d 0020,000e 0002,0002 0002,0003 0002,0010 0002,0012 0400,0520",
    "DA": "0008,0020 0008,0021 0008,0022 0008,0023 0010,0030",
    "TM": "0008,0030 0008,0031 0008,0032 0008,0033 0010,0032",
    "SH": "0008,0050 0020,0010 0008,0100 0010,2160",
    "LO": "0008,0070 0008,1030 0008,103e 0008,1090 0010,0020 0010,1000 0018,1000 0008,0080 0008,1040 0012,0063 0008,0104 0010,1040",
    "PN": "0010,0010 0008,0090 0008,1050 0008,1070 0010,1001",
    "ST": "0008,0081 0008,2111",
    "LT": "0010,4000",
    "UT": "0040,a160",
    "IS": "0020,0011 0020,0013 0028,0008",
    "DS": "0018,0050 0018,0060 0020,0032 0020,0037 0028,0030 0028,1050 0028,1051 0028,1052 0028,1053",
    "US": "0028,0002 0028,0006 0028,0010 0028,0011 0028,0100 0028,0101 0028,0102 0028,0103",
    "SQ": "0008,9215 0012,0064 0400,0500 0040,a730 0008,1140",
    "OB": "0400,0510 0002,0001",
    "OW": PIXELS,
}
VR_OF = {tag: vr for vr, tags in VRS.items() for tag in tags.split()}

# Fixed values of the standard: the sealed attributes' sequence and what it holds.
SEALED_SEQUENCE, SEALED = "0400,0500", ("0400,0510", "0400,0520")

RECORD = (
    "struct<error: string, patient_id: string, patient_name: string, study_instance_uid: string, study_date: string, study_time: string, series_instance_uid: string, modality: string, series_number: string, "
    "manufacturer: string, model_name: string, device_serial_number: string, sop_instance_uid: string, sop_class_uid: string, instance_number: string, attributes: map<string,string>, "
    "items: array<struct<item_path: string, tag: string, vr: string, value: string>>, rows: int, cols: int, samples: int, frames: int, bits: int, pixel_repr: int, pixels: binary>"
)
FRAMES = "sop_instance_uid string, rows int, cols int, samples int, frames int, bits int, pixel_repr int, pixels binary, pixel_hash string, config_hash string"
# Linking attributes, and what stands for an absent one.
LINKS = {
    "patient_id": ("0010,0020", "UnknownPatient"), "patient_name": ("0010,0010", "Unknown"), "study_instance_uid": ("0020,000d", "UnknownStudy"), "study_date": ("0008,0020", "19000101"),
    "study_time": ("0008,0030", None), "series_instance_uid": ("0020,000e", "UnknownSeries"), "modality": ("0008,0060", "OT"), "series_number": ("0020,0011", "0"), "manufacturer": ("0008,0070", None),
    "model_name": ("0008,1090", None), "device_serial_number": ("0018,1000", None), "sop_instance_uid": ("0008,0018", None), "sop_class_uid": ("0008,0016", None), "instance_number": ("0020,0013", None),
}


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8").strip(" \0")
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip(" \0")


def _value(vr: str, raw: bytes) -> str:
    if vr in NUMBERS:
        size = struct.calcsize(NUMBERS[vr])
        return "\\".join(str(x[0]) for x in struct.iter_unpack(NUMBERS[vr], raw[: len(raw) // size * size]))
    if vr == "AT":
        return "\\".join(f"{a:04x},{b:04x}" for a, b in struct.iter_unpack("<HH", raw[: len(raw) // 4 * 4]))
    return _text(raw)


class _Reader:
    """One pass over a data set; nested items get a path like 0040,a730[0]."""

    def __init__(self, data: bytes):
        self.data = data
        self.fragments: list[bytes] = []
        self.raw_pixels = b""
        self.items: list[tuple[str, str, str, str]] = []

    def header(self, at: int, explicit: bool) -> tuple[str, str, int, int]:
        """(tag, vr, length, where the value starts)"""
        group, element = struct.unpack_from("<HH", self.data, at)
        tag = f"{group:04x},{element:04x}"
        if group == 0xFFFE:
            return tag, "", struct.unpack_from("<I", self.data, at + 4)[0], at + 8
        if not explicit:
            return tag, VR_OF.get(tag, "UN"), struct.unpack_from("<I", self.data, at + 4)[0], at + 8
        vr = self.data[at + 4 : at + 6].decode("latin-1")
        if vr in LONG_VRS:
            return tag, vr, struct.unpack_from("<I", self.data, at + 8)[0], at + 12
        return tag, vr, struct.unpack_from("<H", self.data, at + 6)[0], at + 8

    def elements(self, at: int, end: int, explicit: bool, path: str | None = None) -> tuple[dict[str, str], int]:
        found: dict[str, str] = {}
        while at + 8 <= end:
            tag, vr, length, start = self.header(at, explicit)
            if tag == "fffe,e00d":  # end of an item without a length
                return found, start
            if vr == "SQ" or (vr == "UN" and length == 0xFFFFFFFF):
                at = self.sequence(start, length, explicit and vr == "SQ", f"{path}.{tag}" if path else tag, end)
                continue
            if tag == PIXELS:
                at = self.pixels(start, length)
                continue
            raw, at = self.data[start : start + length], start + length
            if vr not in BULK_VRS or tag in SEALED:
                found[tag] = _value(vr, raw)
                if path:
                    self.items.append((path, tag, vr, found[tag]))
        return found, at

    def sequence(self, at: int, length: int, explicit: bool, path: str, end: int) -> int:
        stop, n = (end if length == 0xFFFFFFFF else at + length), 0
        while at + 8 <= stop:
            tag, _, size, start = self.header(at, explicit)
            if tag == "fffe,e0dd":
                return start
            _, at = self.elements(start, stop if size == 0xFFFFFFFF else start + size, explicit, f"{path}[{n}]")
            n += 1
        return at

    def pixels(self, at: int, length: int) -> int:
        if length != 0xFFFFFFFF:
            self.raw_pixels = self.data[at : at + length]
            return at + length
        while True:
            tag, _, size, start = self.header(at, True)
            at = start + size
            if tag == "fffe,e0dd":
                self.fragments = self.fragments[1:]  # the first is the table of offsets
                return at
            self.fragments.append(self.data[start:at])


def unpack_rle(fragment: bytes, size: int, samples: int, wide: int) -> bytes:
    """One frame: byte planes of PackBits runs, most significant byte first."""
    (n, *offsets) = struct.unpack_from("<16I", fragment)
    planes = []
    for k in range(n):
        at, end = offsets[k], offsets[k + 1] if k + 1 < n else len(fragment)
        out = bytearray()
        while at < end and len(out) < size:
            count = fragment[at]
            if count < 128:
                out += fragment[at + 1 : at + 2 + count]
                at += count + 2
            else:
                if count > 128:
                    out += fragment[at + 1 : at + 2] * (257 - count)
                at += 2 if count > 128 else 1
        planes.append(np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8))
    stacked = np.stack(planes).reshape(samples, wide, size)[:, ::-1]
    return stacked.transpose(2, 0, 1).tobytes()


def parse(data: bytes, codecs: dict[str, Codec] | None = None) -> dict:
    """One file as a record; raises ValueError if it has no instance uid. ``codecs`` go before the built-in ones."""
    at, syntax = 0, IMPLICIT
    reader = _Reader(data)
    if data[128:132] == b"DICM":
        at = 132
        while at + 8 <= len(data) and data[at : at + 2] == b"\x02\0":
            tag, vr, length, start = reader.header(at, True)
            if tag == "0002,0010":
                syntax = _text(data[start : start + length])
            at = start + length
    elif len(data) > 8 and data[4:6].isalpha() and data[4:6].isupper():
        syntax = EXPLICIT
    if syntax == DEFLATED:
        reader.data = data = zlib.decompress(data[at:], -15)
        at = 0
    found, _ = reader.elements(at, len(data), syntax != IMPLICIT)
    if not found.get("0008,0018"):
        raise ValueError("no SOPInstanceUID")
    sealed = {tag: value for path, tag, _, value in reader.items if path == f"{SEALED_SEQUENCE}[0]" and tag in SEALED}
    found |= sealed
    reader.items = [x for x in reader.items if not x[0].startswith(SEALED_SEQUENCE)]
    out = {k: found.get(tag, default) for k, (tag, default) in LINKS.items()}
    out |= {"error": None, "attributes": list(found.items()), "items": [dict(zip(("item_path", "tag", "vr", "value"), x, strict=True)) for x in reader.items]}
    number = lambda tag, default: int(float(found.get(tag) or default))
    out |= {"rows": number("0028,0010", 0), "cols": number("0028,0011", 0), "samples": number("0028,0002", 1), "frames": number("0028,0008", 1), "bits": number("0028,0100", 16), "pixel_repr": number("0028,0103", 0), "pixels": None}
    if reader.raw_pixels or reader.fragments:
        out["pixels"] = _decoded(reader, out, syntax, number("0028,0006", 0), codecs or {})
    return out


#: A decoder takes one frame's bytes and its record (rows, cols, samples, bits, ...), and gives plain interleaved samples.
Codec = Callable[[bytes, dict], bytes]
CODECS: dict[str, Codec] = {
    RLE: lambda data, row: unpack_rle(data, row["rows"] * row["cols"], row["samples"], row["bits"] // 8),
    JPEG_BASELINE: lambda data, row: jpeg.decode(data, row["rows"], row["cols"], row["samples"]),
    JPEG_LOSSLESS: lambda data, row: jpeg.decode_lossless(data, row["rows"], row["cols"], row["samples"], row["bits"]),
}


def _decoded(reader: _Reader, row: dict, syntax: str, planar: int, codecs: dict[str, Codec]) -> bytes:
    wide = row["bits"] // 8
    plane = row["rows"] * row["cols"]
    size = plane * row["samples"] * row["frames"] * wide
    if reader.fragments:
        codec = codecs.get(syntax) or CODECS.get(syntax)
        if codec is None:
            raise ValueError(f"no codec for transfer syntax {syntax}")
        # one fragment a frame, or all of a single frame
        frames = reader.fragments if row["frames"] > 1 or syntax == RLE else [b"".join(reader.fragments)]
        return b"".join(codec(x, row) for x in frames)
    raw = reader.raw_pixels[:size].ljust(size, b"\0")
    if planar and row["samples"] > 1:  # stored interleaved from here on
        array = np.frombuffer(raw, np.uint8).reshape(row["frames"], row["samples"], plane, wide)
        raw = array.transpose(0, 2, 1, 3).tobytes()
    return raw



def _parse_batches(codecs: dict[str, Codec] | None, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = {k: pa.string() for k in ("error", *LINKS)} | {k: pa.int32() for k in ("rows", "cols", "samples", "frames", "bits", "pixel_repr")}
    item = pa.struct([(k, pa.string()) for k in ("item_path", "tag", "vr", "value")])
    kinds |= {"attributes": pa.map_(pa.string(), pa.string()), "items": pa.list_(item), "pixels": pa.binary()}
    order = ["error", *LINKS, "attributes", "items", "rows", "cols", "samples", "frames", "bits", "pixel_repr", "pixels"]
    for batch in batches:
        rows = []
        for value in batch:
            try:
                rows.append(parse(value.as_py(), codecs))
            except (ValueError, struct.error, IndexError, KeyError, zlib.error) as e:
                rows.append({"error": f"{type(e).__name__}: {e}"})
        yield pa.array(rows, pa.struct([(k, kinds[k]) for k in order]))


def parsed(content: str, codecs: dict[str, Codec] | None = None) -> Column:
    """The record of a file's bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _parse_batches(codecs, batches)

    return F.arrow_udf(run, RECORD).asNondeterministic()(content)


def read(spark: SparkSession, path: str, known: DataFrame | None = None, codecs: dict[str, Codec] | None = None) -> DataFrame:
    """(path, record): one row per file below ``path``; names that begin with a dot are skipped.

    Paths in ``known`` (file_path) are left out before any file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))
    if known is not None:
        files = files.join(known.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    return files.select("path", parsed("content", codecs).alias("record"))


def errors(records: DataFrame) -> DataFrame:
    return records.filter("record.error is not null").select("path", "record.error")


def _first(rows: DataFrame, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy("file_path"))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def to_cohort(records: DataFrame, known: DataFrame | None = None) -> tuple[Cohort, DataFrame]:
    """(cohort, frames) from parsed records: the first file, by path, decides about its ancestors.

    Of files with one instance uid the first, by path, counts, and none whose uid is in ``known``
    (sop_instance_uid): its row, nested items and frames come or stay out together. The paths that
    stay out are found on narrow rows, so pixels aren't shuffled for it where those are few.
    """
    good = records.filter("record.error is null").select(F.col("path").alias("file_path"), "record.*")
    own = good.select("sop_instance_uid", "file_path")
    rank = F.row_number().over(Window.partitionBy("sop_instance_uid").orderBy("file_path"))
    late = own.withColumn("_rank", rank).filter("_rank > 1").select("file_path")
    if known is not None:
        late = late.unionByName(own.join(known.select("sop_instance_uid").distinct(), "sop_instance_uid", "left_semi").select("file_path"))
    good = good.join(late.distinct(), "file_path", "left_anti")
    patients = _first(good.select("patient_id", "patient_name", "file_path"), "patient_id").drop("file_path")
    studies = _first(good.select("study_instance_uid", "patient_id", parse_date(F.col("study_date")).alias("study_date"), "study_time", F.lit(False).alias("date_shifted"), "file_path"), "study_instance_uid").drop("file_path")
    machine = F.col("manufacturer").isNotNull() | F.col("model_name").isNotNull()
    equipment = [F.when(machine, F.col(c)).alias(c) for c in ("manufacturer", "model_name", "device_serial_number")]
    series = _first(good.select("series_instance_uid", "study_instance_uid", "modality", F.col("series_number").try_cast("int").alias("series_number"), *equipment, "file_path"), "series_instance_uid").drop("file_path")
    instances = good.select("sop_instance_uid", "series_instance_uid", "sop_class_uid", F.col("instance_number").try_cast("int").alias("instance_number"), "file_path", "attributes")
    nested = good.select("sop_instance_uid", F.explode("items").alias("i")).select("sop_instance_uid", "i.*")
    frames = good.filter("pixels is not null").select("sop_instance_uid", "rows", "cols", "samples", "frames", "bits", "pixel_repr", "pixels", F.sha2("pixels", 256).alias("pixel_hash"), F.lit(None).cast("string").alias("config_hash"))
    return Cohort(patients, studies, series, instances, nested), frames


def text_index(items: DataFrame) -> DataFrame:
    """Nested elements that hold text."""
    return items.filter(F.col("vr").isin(*TEXT_VRS))


def _element(tag: str, vr: str, raw: bytes) -> bytes:
    group, element = (int(x, 16) for x in tag.split(","))
    raw += b"" if len(raw) % 2 == 0 else b"\0" if vr in ("UI", *BULK_VRS, "UN") else b" "
    head = struct.pack("<HH", group, element) + vr.encode()
    return head + (struct.pack("<HI", 0, len(raw)) if vr in LONG_VRS else struct.pack("<H", len(raw))) + raw


def _encoded(vr: str, value: str) -> bytes:
    if vr in NUMBERS:
        kind = float if vr in ("FL", "FD") else int
        return b"".join(struct.pack(NUMBERS[vr], kind(float(x))) for x in value.split("\\") if x)
    return value.encode("utf-8")


def _shape(row: dict) -> tuple[int, int, int]:
    return row["rows"] * row["cols"], row["samples"], row["frames"]


def _fragments(pixels: bytes, shape: tuple[int, int, int], wide: int) -> bytes:
    """Pixels as a sequence of fragments: an empty table of offsets, then one RLE fragment a frame."""
    plane, samples, frames = shape
    size, out = plane * samples * wide, struct.pack("<HHI", 0xFFFE, 0xE000, 0)
    for k in range(frames):
        packed = pack_rle(pixels[k * size : (k + 1) * size], plane, samples, wide)
        out += struct.pack("<HHI", 0xFFFE, 0xE000, len(packed)) + packed
    return struct.pack("<HH2sHI", 0x7FE0, 0x0010, b"OW", 0, 0xFFFFFFFF) + out + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def write(attributes: dict[str, str], items: list[dict] = (), pixels: bytes | None = None, bits: int = 16, rle: tuple[int, int, int] | None = None) -> bytes:
    """An explicit little-endian file. Nested items are rebuilt from their paths.

    ``rle`` is (pixels of a plane, samples, frames) and stores the pixels compressed.

    A code in an attribute that is a sequence becomes an item; sealed attributes go into theirs.
    """
    codes = {t: v for t, v in attributes.items() if VR_OF.get(t) == "SQ"}
    sealed = {t: attributes[t] for t in SEALED if attributes.get(t)}
    attributes = {t: v for t, v in attributes.items() if t not in codes and t not in SEALED}
    items = [x for x in items if not x["item_path"].startswith(tuple(codes))] if codes else list(items)
    for t, code in codes.items():
        items += [{"item_path": f"{t}[0]", "tag": tag, "vr": "SH", "value": v} for tag, v in (("0008,0100", code), ("0008,0102", "DCM"))]
    items += [{"item_path": f"{SEALED_SEQUENCE}[0]", "tag": t, "vr": VR_OF[t], "value": v} for t, v in sealed.items()]
    meta = _element("0002,0001", "OB", b"\0\1") + _element("0002,0002", "UI", (attributes.get("0008,0016") or "").encode()) + _element("0002,0003", "UI", attributes["0008,0018"].encode()) + _element("0002,0010", "UI", (RLE if rle else EXPLICIT).encode())
    body = {t: _element(t, VR_OF.get(t, "LO" if len(v) <= 64 else "UT"), _encoded(VR_OF.get(t, "LO" if len(v) <= 64 else "UT"), v)) for t, v in attributes.items() if v is not None and t.count(",") == 1 and not t.startswith(("_", "0000", "0002", "7fe0"))}
    body |= _nested("", list(items))
    if pixels is not None:
        body[PIXELS] = _fragments(pixels, rle, bits // 8) if rle else _element(PIXELS, "OB" if bits <= 8 else "OW", pixels)
    return bytes(128) + b"DICM" + _element("0002,0000", "UL", struct.pack("<I", len(meta))) + meta + b"".join(body[t] for t in sorted(body))


def _nested(base: str, items: list[dict]) -> dict[str, bytes]:
    """Sequences directly below ``base``, as elements by tag."""
    groups: dict[str, dict[int, list[dict]]] = {}
    for x in items:
        rest = x["item_path"][len(base) + bool(base) :] if x["item_path"].startswith(base) else ""
        if rest:
            tag, _, index = rest.split(".")[0].partition("[")
            groups.setdefault(tag, {}).setdefault(int(index[:-1]), []).append(x)
    out = {}
    for tag, numbered in groups.items():
        raw = b""
        for index, rows in sorted(numbered.items()):
            path = f"{base}.{tag}[{index}]" if base else f"{tag}[{index}]"
            own = {x["tag"]: _element(x["tag"], x["vr"], _encoded(x["vr"], x["value"])) for x in rows if x["item_path"] == path}
            own |= _nested(path, [x for x in rows if x["item_path"] != path])
            item = b"".join(own[t] for t in sorted(own))
            raw += struct.pack("<HHI", 0xFFFE, 0xE000, len(item)) + item
        out[tag] = _element(tag, "SQ", raw)
    return out


def pack_rle(pixels: bytes, plane: int, samples: int, wide: int) -> bytes:
    """One frame as byte planes of PackBits runs, most significant byte first."""
    planes = np.frombuffer(pixels, np.uint8).reshape(plane, samples, wide)[:, :, ::-1].transpose(1, 2, 0).reshape(-1, plane)
    segments = []
    for values in planes:
        ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, plane)
        out, literal, start = bytearray(), 0, 0
        raw = values.tobytes()

        def flush(upto: int) -> None:
            nonlocal literal
            for at in range(literal, upto, 128):
                part = raw[at : min(at + 128, upto)]
                out.append(len(part) - 1)
                out.extend(part)
            literal = upto

        for end in ends.tolist():
            if end - start > 2:
                flush(start)
                for at in range(start, end, 128):
                    n = min(128, end - at)
                    out.extend((257 - n, raw[at]) if n > 1 else (0, raw[at]))
                literal = end
            start = end
        flush(plane)
        segments.append(bytes(out) + (b"\0" if len(out) % 2 else b""))
    offsets = np.cumsum([64, *map(len, segments[:-1])]).tolist()
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def export(rows: DataFrame, compress: bool = False) -> DataFrame:
    """Write (path, attributes, items, pixels, bits, ...) rows as files; returns (path, error) per row.

    ``compress`` stores pixels as RLE, which needs rows, cols, samples and frames beside them.

    Paths are URIs of any store that Arrow's file systems open; a task writes its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            paths, failed = [], []
            for row in batch.to_pylist():
                try:
                    store, at = fs.FileSystem.from_uri(row["path"] if "://" in row["path"] else f"file://{row['path']}")
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(at) as f:
                        f.write(write(dict(row["attributes"]), row["items"] or [], row["pixels"], row["bits"] or 16, _shape(row) if compress and row["pixels"] else None))
                    failed.append(None)
                except (OSError, ValueError, KeyError, struct.error) as e:
                    failed.append(f"{type(e).__name__}: {e}")
                paths.append(row["path"])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(failed, pa.string())], ["path", "error"])

    shape = [c for c in ("rows", "cols", "samples", "frames") if c in rows.columns]
    return rows.select("path", "attributes", "items", "pixels", "bits", *shape).mapInArrow(run, "path string, error string")
