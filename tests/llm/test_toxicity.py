import math
import random
import re

import numpy as np

from cohortlake.llm import toxicity as tox


def kernel(a: bytes, b: bytes) -> float:
    """The normalised kernel by listing all subsequences."""
    from collections import Counter
    from itertools import combinations

    def features(w):
        out = Counter()
        for at in combinations(range(len(w)), tox.LENGTH):
            span = at[-1] - at[0] + 1
            if span <= tox.MAX_SPAN:
                out[tuple(int(tox._CODE[w[i]]) for i in at)] += tox.DECAY**span
        return out

    x, y = features(b"^" + a), features(b"^" + b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_kernel_is_the_sum_over_subsequences():
    words = [b"idiot", b"idxiot", b"idit", b"scum", b"banana", "müll".encode(), b"aaaaaa", b"ab"]
    found = tox.Kernel([b"idiot", b"scum", b"aaaaa"])(words)
    for i, w in enumerate(words):
        for j, m in enumerate((b"idiot", b"scum", b"aaaaa")):
            assert abs(found[i, j] - kernel(w, m)) < 1e-5, (w, m)


def test_gaps_and_inserted_characters_stay_alike():
    k = tox.Kernel([b"idiot", b"worthless"])
    alike = k([b"idioot", b"idxiot", b"table", b"worthl3ss".translate(tox._FOLD, tox._DROP)])
    assert alike[0, 0] > 0.5 and alike[1, 0] > 0.3 and alike[2, 0] < 0.05 and alike[3, 1] > 0.99


def test_words_are_folded():
    assert tox.words_of(b"You I-D.I_O-T and s c u m!") == [b"you", b"idiot", b"and", b"scum"]
    assert tox.words_of("1d10t ÉTÉ".encode()) == [b"idiot", "ÉtÉ".encode()]


def test_long_runs_are_read_whole():
    k = tox.Kernel([b"idiot", b"worthless"])
    plain = b"table chair window garden river mountain forest kitchen"
    joined = plain.replace(b" ", b"-")
    for run in (joined + b"-idiot-", joined + b"/worthless,", b'{"a":"' + joined + b'","b":"idiot"}'):
        values = k(tox.words_of(run))
        assert values.max() > 0.99, run
    assert k(tox.words_of(joined)).max() < tox.FLOOR
    for bare in (plain.replace(b" ", b"") * 300 + b"worthless" + plain.replace(b" ", b"") * n for n in (0, 1)):
        assert k([bare])[0, 1] > tox.FLOOR and k([bare.replace(b"worthless", b"")])[0, 1] < tox.FLOOR
    word = bytes(range(97, 123)) * 40
    for n in (*range(1, 10), *range(10, 32)):
        assert all(any(word[at : at + n] in w for w in tox.windows_of(word)) for at in range(0, len(word) - n, 7))


def test_insult_behind_the_fortieth_byte_counts():
    model = tox.fit([(t.encode(), y) for t, y in made()])
    run = "-".join(["then", "eron", "anre", "inat"] * 5)
    low, high = tox.Scorer(model).scores([run.encode(), (run + "-idiot").encode()])
    assert low < 0.5 < high


def made(n=400, seed=3):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "in", "at", "en", "or", "es"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["idiot", "moron", "scum", "stupid"])
        out.append((" ".join(words) + ".", int(bad)))
    return out


def brute_score(model, text):
    """The score by listing subsequences: best word per landmark, sentence by sentence."""
    best = 0.0
    for sentence in re.split(rb"[.!?]+\s|\n", text):
        rows = [v for w in tox.words_of(sentence) if max(v := [kernel(w, m) for m in model.kernel.landmarks]) >= tox.FLOOR]
        if rows:
            best = max(best, sum(x * w for x, w in zip(map(max, zip(*rows, strict=True)), model.weights, strict=True)))
    return 1 / (1 + math.exp(-(model.slope * (model.bias + best) + model.shift)))


def test_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(tox, "LANDMARKS", 12)
    rows = [(t.encode(), y) for t, y in made()]
    model = tox.fit(rows)
    some = [t for t, _ in rows[:12]] + [b"", b"?!", b"you i d i o t. fine", "müde Idiotén".encode(), b"one\ntwo scumm"]
    found = tox.Scorer(model).scores(some)
    for text, score in zip(some, found, strict=True):
        assert abs(score - brute_score(model, text)) < 1e-3, text


def test_cuts_change_nothing(monkeypatch):
    model = tox.fit([(t.encode(), y) for t, y in made()])
    r = random.Random(6)
    long = [" ".join(r.choice(["then", "eron", "i", "d", "x!", "s c u m", "idiot", "anre", "a b"]) for _ in range(300)).encode() for _ in range(20)]
    long += [t + b". " + t for t in long[:5]] + [b"a " * 400, b"x" * 3000 + b" idiot"]
    whole = tox.Scorer(model).scores(long)
    monkeypatch.setattr(tox, "BLOCK", 40)
    assert all(b"".join(tox.blocks_of(t)).replace(b" ", b"") == t.replace(b" ", b"") for t in long)
    assert np.allclose(tox.Scorer(model).scores(long), whole)


def test_every_sentence_of_a_clean_text_counts():
    clean = "idiot fish. " * 100 + "calm sea. " * 3
    model = tox.fit([(t.encode(), y) for t, y in made()] + [(clean.encode(), 0)] * 60)
    assert tox.Scorer(model).scores([b"idiot fish"])[0] <= tox.Scorer(tox.fit([(t.encode(), y) for t, y in made()])).scores([b"idiot fish"])[0]


def test_letters_above_ascii_differ():
    k = tox.Kernel(["дурак".encode()])
    assert k(["дурак".encode()])[0, 0] > 0.99 and k(["книга".encode()])[0, 0] < 0.6


def test_held_out_accuracy(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 0.5) for i, (t, _) in enumerate(rows)] + [(1000, None, 0.5), (1001, "", 0.5), (1002, "?!", 0.5), (1003, "fine words " * 200_000 + "you idiot", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)] + [(5000, 1, 1), (None, 1, 1)], "doc_id long, toxic int, lang int")
    got = tox.toxicity(docs, labels).withColumn("held_out", tox.is_held_out("doc_id")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5) == bool(rows[r.doc_id][1]) for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 40 and np.mean(held) > 0.95
    score = {r.doc_id: r.score for r in got}
    assert score[1000] == score[1001] == score[1002] < 0.5 < score[1003]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in tox.toxicity(docs, labels).collect()}) == 1
    assert tox.toxicity(docs.limit(0), labels).count() == 0
