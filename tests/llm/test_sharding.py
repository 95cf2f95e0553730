import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cohortlake.llm import sharding

SCHEMA = "doc_id long, text string, shard string"
ROWS = [(i, f"text {i % 50} é", "x") for i in range(3000)] + [(None, None, "x")] * 40 + [(5, "same", "x")] * 30 + [(6, "", "x")]


def test_places_have_no_gaps(spark):
    got = sharding.shard(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(40))


def test_sizes_and_checksums(spark):
    got = Counter((r.id, r.size, r.text_crc32) for r in sharding.shard(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)


def test_id_decides_and_growth_moves_only_into_the_new_shard(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sharding.shard(docs).collect()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 40)
    assert all(len(x) == 1 for x in by_id.values())
    grown = {r.id: r.shard for r in sharding.shard(docs, shards=41).collect()}
    assert grown == {i: next(iter(x))[1] for i, x in by_id.items()}


def plain_slot(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 8192


def plain_map(shards, slots=8192):
    """Shards by slot: at each growth every shard keeps its first slots up to an even share."""
    held = [list(range(slots))]
    for n in range(1, shards):
        new = []
        for s in range(n):
            keep = slots // (n + 1) + (s < slots % (n + 1))
            new += held[s][keep:]
            held[s] = held[s][:keep]
        held.append(sorted(new))
    return {slot: s for s, own in enumerate(held) for slot in own}


def test_against_plain_python(spark):
    now, grown = plain_map(40), plain_map(41)
    rows = sorted(((plain_slot(i), zlib.crc32((t or "").encode()) % 16, i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, i) for i, t, _ in ROWS))
    places, expected = Counter(), []
    for slot, _, _, _, crc, size, i in rows:
        expected.append((str(i), size, crc, slot, now[slot], places[now[slot]], grown[slot]))
        places[now[slot]] += 1
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for some in (docs, docs.repartition(7).orderBy("text")):
        got = [(str(r.id), r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot, r.grown_shard) for r in sharding.shard(some).collect()]
        assert sorted(got) == sorted(expected)


def test_assign_evens_out_bytes_and_stores_the_map(spark, tmp_path):
    rows = [(i, "x" * (20_000 if i % 53 == 0 else 10), "x", 1) for i in range(6000)] + [(None, None, "x", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA + ", virtual_slot int")
    got = sharding.assign(docs, path=str(tmp_path / "map")).collect()
    assert len(got) == len(rows)
    load = Counter()
    for r in got:
        load[r.shard] += len((r.text or "").encode()) + 16
        assert r.virtual_slot == plain_slot(r.doc_id) and r.grown_shard in (r.shard, 40)
    plain = Counter()
    for i, t, *_ in rows:
        plain[plain_map(40)[plain_slot(i)]] += len((t or "").encode()) + 16
    assert max(load.values()) < max(plain.values()) and max(load.values()) <= 1.3 * sum(load.values()) / 40
    kept = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert len(kept.versions) == 3 and {s: x for s, x in enumerate(kept.versions[0])} == plain_map(40) and kept.versions[0] != kept.versions[1]
    measured = spark.read.parquet(str(tmp_path / "map")).filter("version = 2").agg(F.sum("slot_bytes")).first()[0]
    assert measured == sum(load.values())


def test_map_is_even_and_edits_keep_versions(spark, tmp_path):
    plan = sharding.SlotMap.for_shards(40)
    held = Counter(plan.current)
    assert max(held.values()) - min(held.values()) <= 40 and len(held) == 40
    before = list(plan.current)
    assert plan.add_shard() == 40 and plan.versions[0] == before
    assert all(b in (a, 40) for a, b in zip(before, plan.current, strict=True))
    load = {s: 1000 if s % 37 else 50_000 for s in range(sharding.SLOTS)}
    weigh = lambda edited: [sum(v) for v in _by_shard(edited, load).values()]
    uneven = weigh(plan.current)
    assert plan.rebalance(load) > 0
    even = weigh(plan.current)
    assert sum(even) == sum(uneven) and max(even) <= max(uneven) and max(even) <= 1.03 * sum(even) / len(even)
    plan.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).versions == plan.versions


def _by_shard(edited, load):
    out = defaultdict(list)
    for slot, shard in enumerate(edited):
        out[shard].append(load[slot])
    return out


def test_slot_bytes_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    per_slot = sharding.slot_bytes(sharding.records(docs)).agg(F.sum("slot_rows"), F.sum("slot_bytes")).first()
    assert tuple(per_slot) == (len(ROWS), sum(len((t or "").encode()) + 16 for _, t, _ in ROWS))
    assert sharding.shard(docs.limit(0)).count() == 0
