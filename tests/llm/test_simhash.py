import random
import re

import xxhash
from pyspark.sql import functions as F

from cohortlake.llm import simhash

SCHEMA = "doc_id long, text string, fp int"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, bits=3):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_fingerprints(monkeypatch):
    r = random.Random(0)
    texts = ["", " \n", "One", "one two", "A B C", "É é\x0bx\x1cy", " ".join(r.choices(["the", "of", "cat"], k=500))]
    for text in texts:
        assert simhash.fingerprint_of(text.encode()) & (1 << 64) - 1 == fingerprint(text), text
    real = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda data: real(data, 50))
    assert simhash.fingerprint_of(texts[-1].encode()) & (1 << 64) - 1 == fingerprint(texts[-1])


def test_hash_is_sparks_own(spark):
    (row,) = spark.sql("SELECT xxhash64('a b c') AS h").collect()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_planted_distances(spark):
    r = random.Random(7)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    nodes = set()
    for _ in range(25):
        a = r.getrandbits(64)
        nodes |= {a, flip(a, 1), flip(a, 2), flip(a, 3), flip(a, 4), flip(flip(a, 3), 3)}
    dense = r.getrandbits(64)
    nodes |= {flip(dense, k) for k in (1, 2, 3) for _ in range(40)}
    signed = {n - (1 << 64) if n >> 63 else n: n for n in nodes}
    prints = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "id long, fp long")
    got = {signed[x.fp]: x.component_id for x in simhash.near_groups(prints).collect()}
    ids = {n: i for i, n in enumerate(signed.values())}
    roots = components(nodes)
    lowest = {}
    for n, root in roots.items():
        lowest[root] = min(lowest.get(root, ids[n]), ids[n])
    assert got == {n: lowest[root] for n, root in roots.items()}


def test_table(spark):
    base = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 300 - i % 3]), 1) for i in range(20, 30)] + [(5, None, 1), (6, "", 1), (6, "", 1), (7, "\t", 1), (None, " ".join(base), 1), (3, "quite other words in here", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).withColumn("hex", simhash.fingerprint_hex()).collect()
    assert len(got) == len(rows)
    prints = {(i, t): fingerprint(t) for i, t, _ in rows}
    roots = components(set(prints.values()))
    for r in got:
        text = {f"{prints[k]:016x}" for k in prints if k[0] == r.id}
        same = [i for (i, t), p in prints.items() if i is not None and roots[p] == roots[int(r.hex, 16)]]
        assert r.hex in text and r.component_id == min(same)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_ids_null(spark):
    (row,) = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", 1)], SCHEMA)).select("component_id").distinct().collect()
    assert row.component_id is None


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(61)}
