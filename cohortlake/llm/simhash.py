"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from word shingles. Two fingerprints are linked when they differ in at
most three bits; the components of that relation are the groups of near-copies.

Links are searched among distinct fingerprints only, so copies cost nothing, in two steps
that never list all pairs of a dense group:

1. Every fingerprint is filed under itself and its 64 one-bit neighbours. All that are filed
   under one key are within two bits of each other, so one star per key carries every link
   of distance one and two. A key holds at most 65 fingerprints.
2. For distance three, the fingerprint is cut into two 32-bit segments. One of them differs
   in at most one bit, so the 33 values of the radius-one ball around each segment are looked
   up in the segment tables and complete distances are verified. Probes whose whole bucket
   already lies in their own component are dropped first. Buckets of more than CROWD fingerprints
   are split by the other segment's four bytes: at most three of them differ, so a linked pair
   meets under an equal byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, texts, utf8, wide, word_blocks

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints in a bucket from which on it is split by the other segment; the links are the same.
CROWD = 64

_BLOCK = 1 << 14


def _bit_counts(hashes: list[int]) -> np.ndarray:
    packed = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(packed, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 if it has no words."""
    digest, counts, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.lower()):  # bytes.lower() changes A-Z only
        words = carry + words
        for at in range(0, max(0, len(words) - shingle + 1), _BLOCK):
            part = words[at : at + _BLOCK + shingle - 1]
            joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
            hashes = [digest(x, SEED) for x in joined]
            counts += _bit_counts(hashes)
            total += len(hashes)
        carry = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total and carry:
        counts, total = _bit_counts([digest(b" ".join(carry), SEED)]), 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint_of(x) for part in texts(batch) for x in part], pa.int64())


def fingerprint_column(text: str | Column) -> Column:
    return F.arrow_udf(_fingerprints, "long").asNondeterministic()(utf8(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``. Null and empty texts have fingerprint zero."""
    return docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col).alias("fp"))


def _flips(fp: str, first: int, last: int) -> Column:
    """``fp`` and its neighbours with one of the bits first..last-1 flipped."""
    one = F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(F.col(fp)), one)


def _changed(a: DataFrame) -> tuple:
    return a.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is pinned in the shared folder.
    """
    work = pin(edges.select("u", "v").filter("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        work = pin(small.filter("u <> v").distinct())
        now = _changed(work)
        if now[0] == 0 or now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _stars(nodes: DataFrame) -> DataFrame:
    """Edges that connect all fingerprints within two bits of each other."""
    filed = wide(nodes.select("fp"), "fp").select("fp", F.explode(_flips("fp", 0, 64)).alias("key"))
    near = filed.groupBy("key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return near.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("u <> v").select("u", "v")


def _segment(fp: str, which: int) -> Column:
    """Segment ``which`` of the fingerprint, in its place, the other half zero."""
    return F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF if which == 0 else -0x100000000).cast("long"))


def _other_bytes() -> Column:
    """(place, value) of the four bytes of the segment that isn't the key's."""
    return F.expr("transform(sequence(0, 3), j -> struct(j as place, shiftright(u, 8 * j + if(s = 0, 32, 0)) & 255 as value))")


def _links(nodes: DataFrame) -> DataFrame:
    """Edges of three bits between different groups; ``nodes`` has fp and its group so far."""
    nodes, parts = wide(nodes.select("fp", "group"), "fp"), []
    for which in (0, 1):
        own = nodes.select(F.col("fp").alias("u"), F.col("group").alias("gu"), F.lit(which).alias("s"), _segment("fp", which).alias("key"))
        parts.append((own, own.select("u", "gu", "s", F.explode(_flips("key", 32 * which, 32 * which + 32)).alias("key"))))
    tables = parts[0][0].unionByName(parts[1][0])
    probes = parts[0][1].unionByName(parts[1][1])
    buckets = tables.groupBy("s", "key").agg(F.min("gu").alias("lo"), F.max("gu").alias("hi"), F.count("*").alias("n"))
    open_ = pin(probes.join(buckets, ["s", "key"]).filter("lo <> gu or hi <> gu").select("s", "key", "u", "gu", (F.col("n") > CROWD).alias("crowded")))
    entry = lambda df: df.select("s", "key", F.col("u").alias("v"), F.col("gu").alias("gv"))
    plain = open_.filter("not crowded").join(entry(tables), ["s", "key"]).select("u", "gu", "v", "gv")
    crowds = buckets.filter((F.col("n") > CROWD) & (F.col("lo") != F.col("hi"))).select("s", "key")
    split = lambda df: df.withColumn("b", F.explode(_other_bytes())).withColumns({"place": F.col("b.place"), "value": F.col("b.value")})
    held = split(tables.join(crowds, ["s", "key"], "left_semi")).select("s", "key", "place", "value", F.col("u").alias("v"), F.col("gu").alias("gv"))
    parted = split(open_.filter("crowded")).join(held, ["s", "key", "place", "value"]).select("u", "gu", "v", "gv")
    met = plain.unionByName(parted)
    return met.filter((F.col("gu") != F.col("gv")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select(F.col("gu").alias("u"), F.col("gv").alias("v"))


def near_groups(prints: DataFrame) -> DataFrame:
    """(fp, group, component_id) for the distinct fingerprints of ``prints`` (id, fp).

    group is a fingerprint of the component that names it;
    component_id is its smallest id, null only if all its ids are null.
    """
    nodes = pin(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    near = components(_stars(nodes))
    grouped = pin(nodes.join(near, nodes.fp == near.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("group")))
    far = components(_links(grouped))
    joined = grouped.join(far, grouped.group == far.node, "left").select("fp", "first_id", F.coalesce("root", "group").alias("group"))
    lowest = joined.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return joined.join(lowest, "group").select("fp", "group", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, group, component_id): one row per row of ``docs``.

    Null or wordless texts have fingerprint zero and link like any other. Rows with a null id
    take part; their component id is the smallest id that is not null. Repeated rows stay.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    prints = pin(fingerprints(docs, id_col, text_col))
    return prints.join(near_groups(prints), "fp").select("id", "fp", "group", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
