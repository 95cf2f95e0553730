import random
import re

import numpy as np

from cohortlake.llm import decontaminate as dec

DOCS = "doc_id long, text string, n_chars int"
ITEMS = "item_id long, text string, lang string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    names.add(name)
    return len(own), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(own)


def made():
    r = random.Random(5)
    vocab = ["the", "of", "a", "Été", "x1", "na"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(r.choice([0, 1, 4, 12, 13, 14, 40]))) for i in range(30)] + [(30, None), (31, "?!"), (3, text(20)), (None, "odd one out here")]
    docs = []
    for i in range(80):
        parts = [text(r.randint(0, 60))]
        if i % 2:
            copied = (r.choice(items)[1] or "").split()
            cut = r.randint(0, max(0, len(copied) - 13))
            parts += [" ".join(copied[cut : cut + 20]).upper() if i % 4 == 1 else ", ".join(copied), text(r.randint(0, 30))]
        docs.append((i, " ".join(parts), 1))
    return docs + [(100, None, 1), (101, "", 1), (7, "the of a", 1), (7, "the of a", 1)], items


def rows(spark, docs, items, **more):
    table = spark.createDataFrame([(i, f"{i}|{t or ''}", t) for i, t, _ in docs], "doc_id long, name string, text string")
    found = dec.search(table, spark.createDataFrame([(*x, "en") for x in items], ITEMS), **more)
    got = found.select("doc_id", "name", "found", dec.n_hit().alias("n_hit"), dec.contaminated().alias("bad")).collect()
    return sorted((r.name, r.found.n_words, r.n_hit, r.found["items"], r.bad) for r in got)


def wanted(docs, items):
    named = [("" if n is None else str(n), t) for n, t in items]
    return sorted((f"{i}|{t or ''}", *brute(t, named)) for i, t, _ in docs)


def test_against_brute_force(spark):
    docs, items = made()
    assert rows(spark, docs, items) == wanted(docs, items)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    docs, items = made()
    monkeypatch.setattr(dec, "BITMAP", (3, 3))
    assert rows(spark, docs[:40], items) == wanted(docs[:40], items)


def test_found_texts_are_those_of_the_rows(spark):
    docs, items = made()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, "en") for x in items], ITEMS)
    got = dec.found_texts(table, bench).join(table.withColumn("digest", dec.digest("text")), "digest").select("doc_id", "text", dec.n_hit().alias("n")).collect()
    named = [("" if n is None else str(n), t) for n, t in items]
    assert sorted((r.doc_id, r.n) for r in got) == sorted((i, n) for i, t, _ in docs if (n := brute(t, named)[1]))


def test_blocks_of_a_very_long_text(monkeypatch):
    r = random.Random(2)
    text = " ".join(r.choices("abcdef", k=3000)).encode()
    bitmap = np.frombuffer(r.randbytes(1 << 13), np.uint8)
    whole = dec.Probe(16, bitmap, [1, 3], 13)(text)
    real = dec.word_blocks
    monkeypatch.setattr(dec, "word_blocks", lambda data: real(data, 100))
    cut = dec.Probe(16, bitmap, [1, 3], 13)(text)
    order = lambda x: sorted(map(str, x["places"]))
    assert cut["n_words"] == whole["n_words"] == 3000 and order(cut) == order(whole) and len(whole["places"]) > 100


def test_a_large_benchmark_stays_in_tables(spark):
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(vocab, k=3000))) for i in range(200)]  # 3 MB, over half a million windows
    docs = [(1, " ".join(items[7][1].split()[100:140]), 1), (2, " ".join(r.choices(vocab, k=40)), 1)]
    (a, b) = rows(spark, docs, items)
    assert a[1:] == (40, 40, ["7"], True) and b[1:] == (40, 0, [], False)


def test_no_items_and_empty_tables(spark):
    docs, _ = made()
    assert all(r[2:] == (0, [], False) for r in rows(spark, docs[:5], []))
    assert rows(spark, [], [(1, "a b c")]) == []
