import math
import random
import zlib
from collections import Counter

import numpy as np

from cohortlake.llm import langmodel

SCHEMA = "doc_id long, text string, n int"


def corpus(n=300, seed=1):
    r = random.Random(seed)
    tongues = [[f"{a}{b}" for a in x for b in y] for x, y in (("st re th".split(), "an on er ing".split()), ("sch ung".split(), "ei au en".split()))]
    rows = []
    for i in range(n):
        words = r.choice(tongues)
        rows.append((i, " ".join(r.choices(words, k=r.randint(0, 80))) + (f" Rare{i}" if i % 5 == 0 else ""), 1))
    return [*rows, (1000, None, 1), (1001, "", 1), (1001, " ", 1), (1002, "THE the\x0bThe " + "é" * 100, 1)]


def check(rows, got):
    tokens = {(i, t): (t or "").encode().translate(langmodel._LOWER).split() + [langmodel.END] for i, t, _ in rows}
    counts = Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens[i, t])
    n, v = sum(counts.values()), len(counts)
    base = sorted((i, len(w), sum(counts[x] > 0 for x in w), float(f"{sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w):.8g}")) for (i, t, _), w in ((r, tokens[r[0], r[1]]) for r in rows))
    assert sorted((r.id, r.n_tokens, r.n_known, float(f"{r.base_score:.8g}")) for r in got) == base
    assert all(r.train_tokens == n and r.held_out == (zlib.crc32(str(r.id).encode()) % 10 == 0) for r in got)


def test_base_and_model(spark):
    rows = corpus()
    got = langmodel.score_corpus(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_score(model, counts, words):
    """The model's log10 probability, place by place, with both softmaxes summed out in full."""
    size, mask, mix = len(model.index), (1 << 64) - 1, 0x9E3779B97F4A7C15
    ids = [model.index.get(w, size + zlib.crc32(w)) for w in words]
    of = lambda i: int(model.classes[i]) if i < size else 1 + langmodel.HEAD_CLASSES + (i - size) % langmodel.TAIL_CLASSES
    total = 0.0
    for at, word in enumerate(words):
        one, two = (ids[at - k] if at >= k else (1 << 40) + k for k in (1, 2))
        keys = (one * 4 + 1, ((one * 0x100000001B3 & mask) ^ two) * 4 + 2, two * 4 + 3)
        logits = [float(model.weights[-1][c]) + sum(float(model.weights[(k & mask) * mix % (1 << 64) >> (64 - model.bits)][c]) for k in keys) for c in range(langmodel.CLASSES)]
        own = of(ids[at])
        total += logits[own] - math.log(sum(math.exp(x) for x in logits))
        if ids[at] < size:
            a, b = (langmodel.CLASSES if x >= 1 << 40 else of(x) for x in (one, two))
            weigh = lambda i: float(model.bias[i]) + float(model.after[0, a, i]) + float(model.after[1, b, i])
            total += weigh(ids[at]) - math.log(sum(math.exp(weigh(i)) for i in range(size) if model.classes[i] == own))
        else:
            total += math.log((counts.get(word, 0) + 0.1) / model.class_total[own])
    return total / math.log(10)


def test_scores_against_plain_python(spark, monkeypatch):
    from cohortlake.llm.common import pin

    monkeypatch.setattr(langmodel, "HEAD_WORDS", 20)
    rows = corpus(80)
    docs = spark.createDataFrame(rows, SCHEMA)
    training = docs.filter(langmodel.is_training())
    counts = pin(langmodel.word_counts(training))
    model = langmodel.train(training, counts)
    assert np.abs(model.after).max() > 0.1 and np.abs(model.weights[:-1]).max() > 0.1
    seen = {bytes(r.word): r.n for r in counts.collect()}
    for r, (i, t, _) in zip(sorted(langmodel.score(docs, model, counts).collect(), key=lambda r: (r.id, r.n_tokens)), sorted(rows, key=lambda r: (r[0], len((r[1] or "").split()))), strict=True):
        words = (t or "").encode().translate(langmodel._LOWER).split() + [langmodel.END]
        assert r.id == i and math.isclose(r.score, plain_score(model, seen, words), rel_tol=1e-4), (i, t)


def test_in_class_steps_reach_the_counts():
    r = np.random.default_rng(2)
    c = langmodel.CONTEXTS
    joint = r.integers(0, 2000, (c, c, 5)) * (r.random((c, c, 1)) < 0.5)
    follows = np.stack([joint.sum(axis=1), joint.sum(axis=0)]).astype(float)
    bias = np.log(joint.sum(axis=(0, 1)) / joint.sum())
    after = langmodel.in_class_weights(bias, follows, joint.sum(axis=2).astype(float))
    p = np.exp(bias + after[0][:, None] + after[1][None])
    p /= p.sum(axis=2, keepdims=True)
    expected = joint.sum(axis=2, keepdims=True) * p
    assert np.abs(expected.sum(axis=1) - follows[0]).max() < 0.02 * follows[0].max() and np.abs(expected.sum(axis=0) - follows[1]).max() < 0.02 * follows[1].max()


def test_words_outside_the_head(spark, monkeypatch):
    monkeypatch.setattr(langmodel, "HEAD_WORDS", 4)
    rows = corpus(60)
    check(rows, langmodel.score_corpus(spark.createDataFrame(rows, SCHEMA)).collect())


def test_probabilities_of_a_history_sum_to_one():
    counts = Counter({b"a%d" % i: 50 - i for i in range(40)}) + Counter({langmodel.END: 30})
    tail = Counter({b"zz%d" % i: 2 for i in range(9)})
    totals = {}
    for w, n in tail.items():
        c = zlib.crc32(w) % langmodel.TAIL_CLASSES
        totals[c] = (totals.get(c, (0, 0))[0] + n, totals.get(c, (0, 0))[1] + 1)
    model = langmodel.Model(counts.most_common(), totals, sum(counts.values()) + sum(tail.values()), len(counts) + len(tail))
    model.weights += np.random.default_rng(0).normal(0, 1, model.weights.shape).astype(np.float32)
    model.after += np.random.default_rng(1).normal(0, 1, model.after.shape).astype(np.float32)
    model.settle()
    history = np.array([[3], [5]])
    log = langmodel._softmax(model.weights, langmodel._rows(history, model.bits))[0]
    every = np.arange(len(model.index))
    inside = model.in_class(every, model.classes, np.repeat(model.contexts_of(history), len(every), axis=1))
    head = sum(math.exp(log[model.classes[i]]) * 10 ** inside[i] for i in every)
    rest = 0.0
    for c in range(langmodel.TAIL_CLASSES):
        own = [n for w, n in tail.items() if zlib.crc32(w) % langmodel.TAIL_CLASSES == c]
        share = sum(n + 0.1 for n in own) + 0.1  # and one share for the unseen
        rest += math.exp(log[c + 1 + langmodel.HEAD_CLASSES]) * share / model.class_total[c + 1 + langmodel.HEAD_CLASSES]
    assert abs(head + rest - 1) < 1e-5


def test_no_training_rows_and_empty_table(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = langmodel.score_corpus(spark.createDataFrame([(one, "a b", 1)], SCHEMA)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score <= 0
    assert langmodel.score_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_a_long_text_are_one_text(spark):
    text = "one two three " * 40_000
    rows = [(i, text if i < 2 else "one two", 1) for i in range(12)]
    got = langmodel.score_corpus(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
