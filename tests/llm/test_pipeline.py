import hashlib
import random
import re
from collections import Counter
from math import ceil, floor

from pyspark.sql import functions as F

import corpus_pipeline
from cohortlake.llm import simhash, stages, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, folder):
    r = random.Random(4)
    vocab = [a + b for a in "th er on an re in at".split() for b in "ing er st ly ou".split()]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    docs = []
    for i in range(160):
        body = text(r.randint(20, 60))
        if i % 8 == 1:
            body = f"{body} you idiot {text(3)}"
        elif i % 8 == 2 and docs:
            body = docs[-2][1]
        docs.append((i, body, "en", f"s{i % 5}" if i % 7 else None, len(body)))
    items = [(k, text(20)) for k in range(4)]
    docs += [(200 + k, items[k][1] + " " + text(10), "en", "s0", 1) for k in range(4)]
    docs += [(300, None, None, "s1", None), (301, "", "en", "s1", 0), (5, docs[5][1], "en", "s0", 1), (None, text(30), "en", "s2", 1), (None, text(31), "en", "s2", 1)]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in docs if i is not None and i < 160]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def contaminated(own, items):
    hit = set()
    for w in items:
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
    return bool(hit) and 20 * len(hit) >= len(own)


def copies(rows):
    """(id, size, source) as often as the mix takes it: md5 order within a source, cut at its budget."""
    by_source = {}
    for i, text, _, source, _ in rows:
        key = hashlib.md5(f"42|{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by_source.setdefault(source, []).append((key, i is not None, i or 0, len((text or "").split()), i))
    sizes = {s: sum(x[3] for x in v) for s, v in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, open_, target = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values()), set(order), {}
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in above} if above else share
        left -= sum(3 * sizes[s] for s in above)
        open_ = open_ - above if above else set()
    out = Counter()
    for s, docs in by_source.items():
        budget, before = floor(target[s] + 1e-9), 0
        epochs = budget // sizes[s] if sizes[s] else 0
        for _, _, _, size, i in sorted(docs):
            taken = epochs * size + max(0, min(size, budget - epochs * sizes[s] - before))
            before += size
            if taken:
                out[(i, size, s)] += ceil(taken / size)
    return out


def test_stages_against_plain_python(spark, tmp_path):
    made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    row = lambda r: tuple(r)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        before, after = [row(r) for r in docs.collect()], [row(r) for r in out.collect()]
        if k == 0:
            assert all("idiot" not in (r[1] or "") for r in after) and len(after) >= 0.95 * sum("idiot" not in (r[1] or "") for r in before)
        elif k == 1:
            groups = {}
            prints = {r: simhash.fingerprint_of((r[1] or "").encode()) & (1 << 64) - 1 for r in before}
            nodes = sorted(set(prints.values()))
            root = {n: n for n in nodes}
            for _ in nodes:
                for a in nodes:
                    for b in nodes:
                        if (a ^ b).bit_count() <= 3:
                            root[a] = root[b] = min(root[a], root[b])
                if all(root[a] == root[b] for a in nodes for b in nodes if (a ^ b).bit_count() <= 3):
                    break
            for r in before:
                groups.setdefault(root[prints[r]], []).append(r)
            assert Counter(root[prints[r]] for r in after) == Counter(groups.keys())
            for r in after:
                ids = [x[0] for x in groups[root[prints[r]]] if x[0] is not None]
                assert r[0] == (min(ids) if ids else None)
        elif k == 2:
            items = [words(b.text) for b in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
            assert Counter(after) == Counter(r for r in before if not contaminated(words(r[1]), items)) and len(after) < len(before)
        elif k == 3:
            assert Counter((r[0], len(words(r[1])), r[3]) for r in after) == copies(before)
        else:
            assert Counter(r[: len(docs.columns)] for r in after) == Counter(before)
            load = Counter()
            for r in out.collect():
                assert r.virtual_slot == int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 8192 and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
                load[r.shard] += len((r.text or "").encode()) + 16
            assert len({(r.virtual_slot, r.shard, r.grown_shard) for r in out.collect()}) == len({r.virtual_slot for r in out.collect()})
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")


def test_run_is_the_stages(spark, tmp_path):
    made(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 50 and "shard" in got.columns


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (1, "completely other text", "en", "s", 1), (None, "x y z", "en", "t", 1)], SCHEMA)
    assert sorted(r.text for r in stages.drop_near_copies(docs).collect()) in (["a b c d", "x y z"], ["completely other text", "x y z"], ["a b c d", "completely other text", "x y z"])
    assert Counter(r.text for r in stages.mix_sources(docs).collect()).total() >= 3


CLASHING = "score string, key string, key_ string, print string, fp string, digest string, copies string, size string, nth string, words string, at string, id string, p string, found string, range string, __stage_value string, __id string"


def test_columns_of_any_name_stay(spark):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    r = random.Random(8)
    rows = [(i if i % 9 else None, " ".join(r.choices("abcdefghij", k=20)) if i % 7 else None, "en", f"s{i % 2}", 1, *[f"{c}-{i}" for c in names]) for i in range(60)]
    rows.append((3, rows[3][1], "en", "s1", 1, *["again"] * len(names)))
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    known = set(rows)
    for stage in (lambda d: stages.drop_toxic(d, labels), stages.drop_near_copies, lambda d: stages.drop_contaminated(d, items), stages.mix_sources):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= known
    placed = stages.place(docs.withColumn("shard", F.lit("mine")))
    assert {tuple(r)[: len(names) + 5] for r in placed.collect()} == known and dict(placed.dtypes)["shard"] == "int"


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (stages.drop_toxic(docs, labels), stages.drop_near_copies(docs), stages.drop_contaminated(docs, items), stages.mix_sources(docs), stages.place(docs)):
        assert out.count() == 0
    assert toxicity.SAMPLE_PER_LABEL > 0
