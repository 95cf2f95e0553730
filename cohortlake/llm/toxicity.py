"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Words are folded first: ASCII letters in lower case, look-alike digits as letters, other ASCII
signs left out, and letters spaced one by one joined again. Two words are as alike as the
subsequences of four characters they share; a subsequence that spans s characters weighs
DECAY ** s and may span at most MAX_SPAN, so gaps and inserted characters cost weight but keep
the match. The kernel is normalised. A run of more than MAX_WORD bytes without white space is as
like a landmark as the best of its overlapping windows, and its parts between signs count as words too.

Landmark words come from a bounded sample of labelled texts, read whole. A word's kernel values
below FLOOR count as none, which makes the kernel sparse and most words nobody's likeness. A sentence's
kernel with a landmark is that of its best word, its feature vector is that row times
K(landmarks) ** -1/2. The machine is trained on sentences: all those of clean texts are negative, and
in a toxic text the sentence that scores highest so far stands for it. A text scores as its highest
sentence, mapped to 0..1 on labelled texts that the machine has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, texts, utf8

LENGTH = 4
MAX_SPAN = 6
DECAY = 0.7
LANDMARKS = 96
#: Labelled texts that training gets: at most so many of each label, the first by a hash of the id. They
#: come to the driver in so many parts, one at a time.
SAMPLE_PER_LABEL = 1500
SAMPLE_PARTS = 32
#: Candidates for landmarks that are compared at once.
RANKED = 128
#: A word counts as like no landmark below this kernel value.
FLOOR = 0.3
#: Longer words are read in windows: (bytes, step). What has at most bytes - step + 1 lies whole in one.
MAX_WORD = 40
WINDOWS = ((12, 4), (MAX_WORD, 10))
#: Windows whose kernels are worked out at once.
WINDOW_BATCH = 4096
#: Words whose kernels a worker keeps before it starts anew.
KEEP = 300_000
FOLD = 5
#: Longer sentences are read in blocks, cut between two words; a sentence's row is the highest of its blocks'.
BLOCK = 1 << 20

_FOLD = bytearray(256)
for _c in range(256):
    _FOLD[_c] = _c + 32 if 0x41 <= _c <= 0x5A else _c if _c >= 0x80 or 0x61 <= _c <= 0x7A or _c in b" \t\n\r\x0b\x0c" else 0
for _a, _b in zip(b"013457$@", b"oieastsa", strict=True):
    _FOLD[_a] = _b
_DROP = bytes(c for c in range(256) if _FOLD[c] == 0)
_FOLD = bytes(_FOLD)
_SENTENCE = re.compile(rb"[.!?]+\s|\n")
#: Where a block may end: white space that no spelled-out word goes across.
_CUT = re.compile(rb"(?<=\S\S)\s(?=\S\S)")
#: Signs that join the parts of a run.
_JOINT = re.compile(b"[" + re.escape(bytes(c for c in _DROP if not 0x30 <= c <= 0x39)) + b"]+")
#: Letters on their own, in a row.
_SPELLED = re.compile(rb"(?<!\S)[a-zA-Z](?:\s[a-zA-Z]){2,}(?![a-zA-Z0-9])")

#: Eight-bit codes: letters 1..26, the start mark 27, bytes above ASCII their own.
_CODE = np.array([c - 96 if 97 <= c <= 122 else c if c >= 0x80 else 27 if c == 0x5E else 0 for c in range(256)], np.int64)
_BITS = 8 * LENGTH
_PATTERNS = [(0, *rest) for span in range(LENGTH, MAX_SPAN + 1) for rest in combinations(range(1, span), LENGTH - 1) if rest[-1] == span - 1]


def words_of(sentence: bytes) -> list[bytes]:
    joined = _SPELLED.sub(lambda m: b"".join(m[0].split()), sentence) if _SPELLED.search(sentence) else sentence
    words = joined.translate(_FOLD, _DROP).split()
    if any(len(w) > MAX_WORD for w in words):
        for run in joined.split():
            if len(run.translate(_FOLD, _DROP)) > MAX_WORD and len(parts := _JOINT.split(run)) > 1:
                words += [w for x in parts if 0 < len(w := x.translate(_FOLD, _DROP)) <= MAX_WORD]
    return words


def windows_of(word: bytes) -> Iterator[bytes]:
    """Overlapping windows of a framed word; the last of each size ends with the word."""
    for size, step in WINDOWS:
        for at in range(0, len(word) - size, step):
            yield word[at : at + size]
        yield word[-size:]


def sentences_of(text: bytes) -> Iterator[bytes]:
    at = 0
    for end in _SENTENCE.finditer(text):
        if not (x := text[at : end.start()]).isspace() and x:
            yield x
        at = end.end()
    if not (x := text[at:]).isspace() and x:
        yield x


def blocks_of(sentence: bytes) -> Iterator[bytes]:
    """The sentence in blocks of about BLOCK bytes that cut no word and no spelled-out word."""
    at = 0
    while len(sentence) - at > BLOCK and (cut := _CUT.search(sentence, at + BLOCK)):
        yield sentence[at : cut.start()]
        at = cut.end()
    yield sentence[at:] if at else sentence


def _subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, weight) with repeats summed, for folded words."""
    return _framed_subsequences([b"^" + w for w in words])


def _framed_subsequences(framed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in framed], np.int64)
    codes = _CODE[np.frombuffer(b"".join(framed) + bytes(MAX_SPAN), np.uint8)]
    owner = np.repeat(np.arange(len(framed)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(owner))
    keys, weights = [], []
    for pattern in _PATTERNS:
        at = np.flatnonzero(left > pattern[-1])
        code = codes[at]
        for step in pattern[1:]:
            code = code << 8 | codes[at + step]
        keys.append(owner[at] << _BITS | code)
        weights.append(np.full(len(at), DECAY ** (pattern[-1] + 1)))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> _BITS, key & ((1 << _BITS) - 1), np.bincount(inverse, np.concatenate(weights), len(key))


def _hashed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


class Kernel:
    """Normalised kernel of any words with fixed landmark words."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        own, code, weight = _subsequences(landmarks)
        norm = np.sqrt(np.bincount(own, weight * weight, len(landmarks)))
        self.codes, row = np.unique(code, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_hashed(self.codes)] = True
        self.weights = np.zeros((len(self.codes), len(landmarks)), np.float32)
        self.weights[row, own] = weight / np.maximum(norm[own], 1e-12)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks); a word over MAX_WORD bytes gets the highest values of its windows."""
        out = self._framed([b"^" + w if len(w) <= MAX_WORD else b"" for w in words])
        for i in (i for i, w in enumerate(words) if len(w) > MAX_WORD):
            windows = windows_of(b"^" + words[i])
            while some := list(dict.fromkeys(islice(windows, WINDOW_BATCH))):
                out[i] = np.maximum(out[i], self._framed(some).max(axis=0))
        return out

    def _framed(self, words: list[bytes]) -> np.ndarray:
        own, code, weight = _framed_subsequences(words)
        norm = np.sqrt(np.bincount(own, weight * weight, len(words)))
        met = np.flatnonzero(self.maybe[_hashed(code)])  # then only few are looked up
        row = np.searchsorted(self.codes, code[met])
        same = self.codes[np.minimum(row, len(self.codes) - 1)] == code[met] if len(self.codes) else np.zeros(len(met), bool)
        met, row = met[same], row[same]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if len(met):
            owners = own[met]
            first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            out[owners[first]] = np.add.reduceat(self.weights[row] * weight[met, None].astype(np.float32), first, axis=0)
        return out / np.maximum(norm, 1e-12)[:, None].astype(np.float32)


@dataclass
class Model:
    kernel: Kernel
    #: Decision weights on kernel values: the machine's weights times K(landmarks) ** -1/2.
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


class Scorer:
    """Scores texts; keeps what it has found about words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, np.ndarray | None] = {}

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
            new = list(words)
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            values = self.model.kernel(some)
            like = values.max(axis=1) >= FLOOR
            self.known.update(zip(some, (v if ok else None for v, ok in zip(values, like, strict=True)), strict=True))

    def margins(self, docs: list[bytes]) -> np.ndarray:
        """The highest decision value of any sentence of each text; a text without words gets the bias."""
        short = [words_of(x) if len(x) <= BLOCK else None for x in docs]
        self._learn({w for words in short if words for w in words})
        known, out = self.known, np.full(len(docs), self.model.bias)
        for i, (text, words) in enumerate(zip(docs, short, strict=True)):
            if words is None or any(known.get(w) is not None for w in set(words)):
                best = max((float(row @ self.model.weights) for x in sentences_of(text) if (row := self.row(x)) is not None), default=0.0)
                out[i] = self.model.bias + max(best, 0.0)
        return out

    def row(self, sentence: bytes) -> np.ndarray | None:
        """The highest kernel values of the sentence's words; null if none is like a landmark."""
        rows = [r for x in blocks_of(sentence) if (r := sentence_row(self._values(words_of(x)))) is not None]
        return sentence_row(rows)

    def _values(self, words: list[bytes]) -> list[np.ndarray]:
        if any(w not in self.known for w in words):
            self._learn(set(words))
        return [v for w in words if (v := self.known.get(w)) is not None]

    def scores(self, docs: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.margins(docs) + self.model.shift, -500, 500)))


def sentence_row(values: list[np.ndarray]) -> np.ndarray | None:
    return np.max(values, axis=0) if values else None


def _landmarks(often: Counter, other: Counter, toxic: int, clean: int) -> list[bytes]:
    """Words that tell toxic from clean texts, most telling first, and none too like a chosen one.

    ``often`` and ``other`` count the toxic and the clean texts that hold a word. All telling words are
    candidates; they are compared a block at a time, so memory doesn't grow with them.
    """
    t, c = max(1, toxic), max(1, clean)
    least = max(2, t // 400)  # a word of a single text tells nothing
    telling = {w: np.log((n + 0.5) / (t + 1) / ((other[w] + 0.5) / (c + 1))) * np.sqrt(n) for w, n in often.items() if n >= least and 3 <= len(w) <= MAX_WORD}
    ranked = sorted((w for w, v in telling.items() if v > 0), key=lambda w: (-telling[w], w))
    chosen: list[bytes] = []
    for at in range(0, len(ranked), RANKED):
        if len(chosen) >= LANDMARKS:
            break
        block = ranked[at : at + RANKED]
        alike = Kernel(block)(block)
        free = (Kernel(chosen)(block) < 0.8).all(axis=1) if chosen else np.ones(len(block), bool)
        for i, word in enumerate(block):
            if free[i] and len(chosen) < LANDMARKS:
                chosen.append(word)
                free &= alike[i] < 0.8
    for w, _ in sorted(other.items(), key=lambda x: (-x[1], x[0])):  # plain words fill up, so that there is always a landmark
        if len(chosen) >= LANDMARKS + 8:
            break
        if w not in often and 3 < len(w) <= MAX_WORD:
            chosen.append(w)
    return chosen or [b"landmark"]


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, decay: float = 1e-3, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps; ``cost`` weighs the examples."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, z, t = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 1.0
    blocks = ((x1[a : a + 8192], cost[a : a + 8192, None]) for a in range(0, len(x1), 8192))
    lip = 2 * float(np.linalg.eigvalsh(sum((b * c).T @ b for b, c in blocks))[-1]) + decay
    reg = np.full(len(w), decay)
    reg[-1] = decay * 1e-2
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ z.astype(x1.dtype)))
        slope = reg * z - 2 * (x1.T @ (cost * y * slack).astype(x1.dtype))
        new = z - slope / lip
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w[:-1], float(w[-1])


def _scale(margin: np.ndarray, y: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve: 0.5 lies where F1 is best, the slope fits by Newton steps.

    A clean text of the sample stands for ``clean_weight`` of them.
    """
    if not (y > 0).any() or not (y < 0).any():
        return 1.0, 0.0 if (y > 0).any() else -1.0
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order] > 0)
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(y[order] < 0) + (y > 0).sum())
    ends = np.append(margin[order][1:] < margin[order][:-1], True)  # only whole ties can be cut off
    best = int(np.argmax(np.where(ends, f1, -1)))
    low = margin[order][best + 1] if best + 1 < len(y) else margin.min() - 1
    cut = (margin[order][best] + low) / 2
    x, slope = margin - cut, 1.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        step = (x @ (p - target) + 1e-3 * slope) / ((x * x) @ (p * (1 - p) + 1e-9) + 1e-3)
        slope -= float(np.clip(step, -1, 1))
    slope = max(slope, 0.1)
    return slope, -slope * cut


class Sample:
    """Labelled texts in a fixed order, read again for each step of the fit.

    ``read`` gives an iterator over (text, label); a table's sample comes part by part, so that the
    driver holds one part of the texts at a time. Every third row is kept apart for the scale.
    """

    def __init__(self, read, clean_weight: float = 1.0):
        self.read, self.clean_weight = read, clean_weight
        self.labels = [y for _, y in read()]

    def rows(self, apart: bool | None = None) -> Iterator[tuple[bytes, int]]:
        """All rows, or those kept apart, or the others; a small sample has no rows apart."""
        some = apart is not None and len(self.labels) >= 60
        return (r for i, r in enumerate(self.read()) if not some or (i % 3 == 2) == apart)

    def scaling(self) -> Iterator[tuple[bytes, int]]:
        apart = sum(y for i, y in enumerate(self.labels) if i % 3 == 2) if len(self.labels) >= 60 else sum(self.labels)
        return self.rows(True) if apart >= 30 else self.rows()


def fit(sample: Sample | list[tuple[bytes, int]], clean_weight: float = 1.0) -> Model:
    """The model for labelled texts; every third one is kept for the scale of the scores.

    ``clean_weight`` says how many clean texts one of the sample stands for, if a toxic one stands for one.
    Equal sentence rows of clean texts are one row with their number as cost, so that all of them count.
    """
    sample = sample if isinstance(sample, Sample) else Sample(lambda rows=sample: iter(rows), clean_weight)
    holds, n = (Counter(), Counter()), [0, 0]
    for text, y in sample.rows(False):
        holds[y].update({w for s in sentences_of(text) for x in blocks_of(s) for w in words_of(x)})
        n[y] += 1
    kernel = Kernel(_landmarks(holds[1], holds[0], n[1], n[0]))
    del holds
    gram = kernel(kernel.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    model = Model(kernel, np.zeros(len(gram)), 0.0, 1.0, 0.0)
    scorer = Scorer(model)
    toxic, clean = [], Counter({np.zeros(len(gram), np.float32).tobytes(): 1})
    for text, y in sample.rows(False):
        found = [r.astype(np.float32) for s in sentences_of(text) if (r := scorer.row(s)) is not None]
        if y:
            toxic += [np.unique(found, axis=0)] if found else []
        else:
            clean.update(r.tobytes() for r in found)
    if toxic:
        bad = np.frombuffer(b"".join(clean), np.float32).reshape(len(clean), -1) @ root.astype(np.float32)
        times = np.fromiter(clean.values(), np.float64, len(clean))
        clean.clear()
        witness = [x[x.max(axis=1).argmax()] for x in toxic]
        for _ in range(4):
            x = np.concatenate([(np.array(witness) @ root).astype(np.float32), bad])
            y = np.concatenate([np.ones(len(witness)), -np.ones(len(bad))])
            cost = np.concatenate([np.full(len(witness), 0.5 / len(witness)), 0.5 * times / times.sum()])
            w, model.bias = _fit_svm(x, y, cost)
            model.weights = root @ w
            chosen = [x[(x @ model.weights).argmax()] for x in toxic]
            if all((a == b).all() for a, b in zip(chosen, witness, strict=True)):
                break
            witness = chosen
    else:
        model.bias = -1.0
    if sample.labels:
        margins, y = [], []
        rows = sample.scaling()
        while part := list(islice(rows, 64)):
            margins.append(scorer.margins([x for x, _ in part]))
            y += [1 if label else -1 for _, label in part]
        model.slope, model.shift = _scale(np.concatenate(margins), np.array(y), sample.clean_weight)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL, fold: int = FOLD) -> Sample:
    """At most ``per_label`` rows of each label, the first by a hash of the id, with their whole texts.

    Rows of the held-out fold are left out. The sample is pinned in the shared folder.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out("id", fold))
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id"))
    first = [r for label in (0, 1) for r in chosen.filter(F.col("label") == label).orderBy("order", "id").limit(per_label).collect()]
    if not first:
        return Sample(lambda: iter(()))
    there = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = [there.get(label, 0) / max(1, min(per_label, there.get(label, 0))) for label in (0, 1)]
    keys = docs.sparkSession.createDataFrame([(r.id, r.label, r.order) for r in first], chosen.schema)
    met = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(keys), "id").groupBy("id", "label", "order").agg(F.min("text").alias("text"))
    sample = pin(met.repartitionByRange(SAMPLE_PARTS, "order", "id").sortWithinPartitions("order", "id").select("text", "label"))
    return Sample(lambda: ((bytes(r.text), r.label) for r in sample.toLocalIterator()), max(weight[0], 1.0) / max(weight[1], 1.0))


def is_held_out(id_col: str = "doc_id", fold: int = FOLD) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(fold)) == 0


def _score_batches(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.scores(part) for part in texts(batch, 64)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return run


def score_column(spark, model: Model, text: str | Column = "text") -> Column:
    """The score of a text, 0..1; null counts as empty."""
    run = _score_batches(spark.sparkContext.broadcast(model))
    return F.arrow_udf(run, "double").asNondeterministic()(utf8(text))


def toxicity(docs: DataFrame, labels: DataFrame, out: str = "score", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` with a column ``out``: the score of each whole text, without a shuffle.

    The score depends on the text alone. Null, empty and wordless texts get the score of a text
    like no landmark. Rows and other columns stay; a column already named ``out`` is replaced.
    Without labelled rows, or with one label only, all texts get one constant score.
    """
    model = fit(labelled_sample(docs, labels, id_col, text_col, label_col))
    return docs.withColumn(out, score_column(docs.sparkSession, model, text_col))
