"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Counts of all words come first; they give the add-0.1 unigram base. The most frequent words, a
fixed number, form the head and are sent to the executors. Each word has a class: head words by
k-means over their spelling, with the end mark on its own, other words by a hash. The model is

    P(word | history) = P(class | history) * P(word | class, history)

Both factors are softmaxes. That over the classes has hashed features of the two words before: a
bias, the last word, the last two together, and the second last alone (a skip). Its weights are
trained by distributed gradient updates over all training texts: every partition takes minibatch
steps from the same weights, and the changes are averaged by row, weighted by how often a row was
touched. The hashed table grows with the number of distinct words, up to 2 ** BUCKET_BITS[1] rows.

The softmax over a class's words has a bias per word and features of the last word's class and the
second last's (a skip). Its gradient needs only how often each word follows each class at either
distance; partitions count that in the same pass, and each class is then a problem of its own, solved
by gradient steps in a task of its own. Words outside the head have the bias alone: the add-0.1
relative frequency in their class, one share for an unseen word.

Words outside the head are joined with the counts; of a text only its distinct rare words travel.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, texts, utf8, word_blocks

ADD = 0.1
#: Words sent to the executors: at most so many, none longer than HEAD_BYTES.
HEAD_WORDS = 1 << 16
HEAD_BYTES = 64
#: Classes of head words, besides the end mark's, and of other words.
HEAD_CLASSES = 11
TAIL_CLASSES = 4
CLASSES = 1 + HEAD_CLASSES + TAIL_CLASSES
#: What stands before a text counts as one more class of a last or second last word.
CONTEXTS = CLASSES + 1
#: Rows of the hashed weight table: a power of two from BUCKETS_PER_WORD rows per distinct word, in these bounds.
BUCKETS_PER_WORD = 4
BUCKET_BITS = (14, 17)
#: Gradient steps of a class's words, how far one may go, and what holds rare features back.
IN_CLASS_STEPS, IN_CLASS_REACH, IN_CLASS_PRIOR = 25, 1.0, 2.0
STEP = 0.25
#: Places per step: the least, the most, and in between a share of the places seen so far.
MINIBATCH = (4096, 65536)
MINIBATCH_SHARE = 8
#: Distinct words that a worker counts before it hands them on.
FLUSH = 500_000
#: Weight rows that travel together.
BLOCK = 512
#: Tokens to a partition, about: partitions are summed in as many groups as the square root of their number.
PARTITION_TOKENS = 2_500_000

#: The end mark; no word contains white space.
END = b"\n"

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def is_training(id_col: str = "doc_id", fold: int = 10) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(fold)) != 0


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for part in texts(batch.column(0)):
            for data in part:
                for words in word_blocks(data.translate(_LOWER)):
                    counts.update(words)
                counts[END] += 1
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, the end mark included."""
    return train.select(utf8(text_col).alias("text")).mapInArrow(_count_batches, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _spelling_classes(words: list[bytes], rounds: int = 8) -> np.ndarray:
    """Classes 1..HEAD_CLASSES of the head words: k-means over hashed letter pairs."""
    dims = 256
    found = np.zeros((len(words), dims), np.float32)
    for i, word in enumerate(words):
        framed = b"^" + word + b"$"
        for a, b in zip(framed, framed[1:], strict=False):
            found[i, (a * 31 + b * 7) % dims] += 1
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    centres = found[np.linspace(0, len(words) - 1, HEAD_CLASSES).astype(int)]
    for _ in range(rounds):
        own = (found @ centres.T).argmax(axis=1)
        for c in range(HEAD_CLASSES):
            if (own == c).any():
                mean = found[own == c].mean(axis=0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return own + 1


class Model:
    """What is sent to the executors: the head, class totals and the weight table."""

    def __init__(self, head: list[tuple[bytes, int]], tail_totals: dict[int, tuple[int, int]], tokens: int, types: int):
        self.tokens, self.types = tokens, types
        words = [w for w, _ in head if w != END]
        self.index = {w: i for i, w in enumerate(words)} | {END: len(words)}
        n = len(self.index)
        of = dict(head)
        counts = np.array([of.get(w, 0) for w in self.index], np.float64)
        self.classes = np.zeros(n, np.int64)
        if words:
            self.classes[: n - 1] = _spelling_classes(words)
        # (tokens, types) of each class; the head's are known whole
        totals = np.zeros((CLASSES, 2))
        np.add.at(totals, self.classes, np.stack([counts, np.ones(n)], axis=1))
        for c, (t, k) in tail_totals.items():
            totals[c + 1 + HEAD_CLASSES] = t, k
        tail = np.arange(CLASSES) > HEAD_CLASSES
        self.class_total = totals[:, 0] + ADD * (totals[:, 1] + tail)
        self.class_total = np.maximum(self.class_total, ADD)
        self.bias = np.log((counts + ADD) / self.class_total[self.classes])
        self.base = np.log10((counts + ADD) / base_total(tokens, types))
        self.known = counts > 0
        # rows of hashed features and, last, the bias
        self.bits = int(np.clip(np.ceil(np.log2(max(1, types) * BUCKETS_PER_WORD)), *BUCKET_BITS))
        self.weights = np.zeros(((1 << self.bits) + 1, CLASSES), np.float32)
        self.weights[-1] = np.log(self.class_total / self.class_total.sum())
        # by distance: a head word's weight after each class, and what the class's words add up to
        self.after = np.zeros((2, CONTEXTS, n), np.float32)
        self.log_sum = np.zeros((CLASSES, CONTEXTS, CONTEXTS))

    def tokens_of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Ids: a head word's index, or the head's size plus a hash; and the words outside the head."""
        get, n = self.index.get, len(self.index)
        ids = [get(w, -1) for w in words]
        tail = [w for w, i in zip(words, ids, strict=True) if i < 0]
        out = np.array(ids, np.int64)
        if tail:
            out[out < 0] = [n + zlib.crc32(w) for w in tail]
        return out, tail

    def settle(self) -> None:
        """Work out what each class's words add up to after each pair of classes."""
        for c in range(1 + HEAD_CLASSES):
            own = np.flatnonzero(self.classes == c)
            if len(own):
                for one in range(CONTEXTS):
                    logits = self.bias[own] + self.after[0, one, own] + self.after[1][:, own]
                    top = logits.max(axis=1)
                    self.log_sum[c, one] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))

    def contexts_of(self, history: np.ndarray) -> np.ndarray:
        return np.where(history >= BEFORE, CLASSES, self.classes_of(history))

    def in_class(self, words: np.ndarray, classes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 P(word | class, contexts) of head words."""
        one, two = contexts
        log = self.bias[words] + self.after[0, one, words] + self.after[1, two, words] - self.log_sum[classes, one, two]
        return log / math.log(10)

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.index)
        return np.where(ids < n, self.classes[np.minimum(ids, n - 1)], 1 + HEAD_CLASSES + (ids - n) % TAIL_CLASSES)


def base_total(tokens: int, types: int) -> float:
    return tokens + ADD * (types + 1)


#: Ids from here on mark what stands before a text, at each distance.
BEFORE = 1 << 40


def _rows(history: np.ndarray, bits: int) -> np.ndarray:
    """Hashed weight rows (3, n) for histories (2, n) of the last and second last word."""
    one, two = history.astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    keys = (one * np.uint64(4) + np.uint64(1), (one * np.uint64(0x100000001B3) ^ two) * np.uint64(4) + np.uint64(2), two * np.uint64(4) + np.uint64(3))
    return np.stack([((k * mix) >> np.uint64(64 - bits)).astype(np.int64) for k in keys])


def _history(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two ids before each place; before a text's start there is a mark for each distance."""
    out = np.empty((2, len(ids)), np.int64)
    at = np.arange(len(ids)) - starts
    for back in (1, 2):
        out[back - 1] = np.where(at >= back, np.roll(ids, back), BEFORE + back)
    return out


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes, natural."""
    logits = weights[rows[0]] + weights[-1]
    for r in rows[1:]:
        logits += weights[r]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _stream(model: Model, data: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """A text's ids and words outside the head, in blocks; the end mark closes the last."""
    last = None
    for words in word_blocks(data.translate(_LOWER), 1 << 18):
        if last is not None:
            yield model.tokens_of(last)
        last = words
    yield model.tokens_of([*last, END])


def _batched(model: Model, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[bytes]]]]]:
    """(ids, starts, owner of each place, rare words by owner) in batches of about MINIBATCH[1] places."""
    ids, starts, owners, rare, held = [], [], [], [], 0
    for owner, data in rows:
        context = np.zeros(0, np.int64)
        for own, tail in _stream(model, data):
            # up to two places of context lead a text's later blocks; they belong to nobody
            ids += [context, own]
            starts.append(np.full(len(context) + len(own), held))
            owners += [np.full(len(context), -1), np.full(len(own), owner)]
            held += len(context) + len(own)
            context = np.concatenate([context, own])[-2:]
            if tail:
                rare.append((owner, tail))
            if held >= MINIBATCH[1]:
                yield np.concatenate(ids), np.concatenate(starts), np.concatenate(owners), rare
                ids, starts, owners, rare, held = [], [], [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(starts), np.concatenate(owners), rare


_CHANGE = "kind int, block int, part int, rows binary, change binary, touched binary"


def _train_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weights, bias, size = model.weights.copy(), len(model.weights) - 1, len(model.index)
        squares = np.full(weights.shape, 1e-2, np.float32)
        touched = np.zeros(len(weights), np.int64)
        follows = np.zeros((2, CONTEXTS * size), np.int32)
        pairs = np.zeros(CLASSES * CONTEXTS * CONTEXTS, np.int64)
        columns = np.arange(CLASSES)
        rows = ((0, x) for batch in batches for part in texts(batch.column(0)) for x in part)
        seen = 0
        for ids, starts, owners, _ in _batched(model, rows):
            real = owners >= 0
            history, words = _history(ids, starts)[:, real], ids[real]
            features, classes, (one, two) = _rows(history, model.bits), model.classes_of(words), model.contexts_of(history)
            head = words < size
            for k, context in enumerate((one, two)):
                np.add.at(follows[k], context[head] * size + words[head], 1)
            pairs += np.bincount((classes * CONTEXTS + one) * CONTEXTS + two, minlength=len(pairs))
            at = 0
            while at < len(classes):
                most = min(max(MINIBATCH[0], seen // MINIBATCH_SHARE), MINIBATCH[1])
                some, right = features[:, at : at + most], classes[at : at + most]
                slope = np.exp(_softmax(weights, some))
                slope[np.arange(len(right)), right] -= 1
                counts = np.bincount(some.ravel(), minlength=len(weights))
                counts[bias] = len(right)
                own = np.flatnonzero(counts)
                place = np.cumsum(counts > 0) - 1
                sums = np.empty((len(own), CLASSES), np.float32)
                keys = place[some.ravel()]
                for c in columns:
                    sums[:, c] = np.bincount(keys, np.tile(slope[:, c], len(some)), len(own))
                sums[-1] = slope.sum(axis=0)
                sums /= np.sqrt(counts[own])[:, None].astype(np.float32)
                square = squares[own] + sums * sums
                squares[own] = square
                weights[own] -= STEP * sums / np.sqrt(square)
                touched += counts
                seen += len(right)
                at += most
        if not seen:
            return
        part = TaskContext.get().partitionId()
        for at in range(0, len(weights), BLOCK):
            own = np.flatnonzero(touched[at : at + BLOCK])
            if len(own):
                yield _row(0, at // BLOCK, part, own.astype(np.int32), (weights[at + own] - model.weights[at + own]).astype(np.float16), touched[at + own])
        follows, pairs = follows.reshape(2, CONTEXTS, size), pairs.reshape(CLASSES, CONTEXTS, CONTEXTS)
        for c in range(1 + HEAD_CLASSES):
            words = np.flatnonzero(model.classes == c)
            if len(words) and pairs[c].any():
                yield _row(1, c, part, follows[0][:, words], follows[1][:, words], pairs[c].astype(np.int64))

    return run


def _row(kind: int, block: int, part: int, *parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (kind, block, part)), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["kind", "block", "part", "rows", "change", "touched"])


def _summed(rows: Iterator[tuple[bytes, bytes, bytes]], kind: int) -> tuple[np.ndarray, ...]:
    """What some partitions found of a block or class, as one: (rows, mean change, touched) or counts.

    Changes are averaged by how often a row was touched; counts are added up.
    """
    if kind == 0:
        change, touched = np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK, np.int64)
        for own, c, n in rows:
            own, n = np.frombuffer(own, np.int32), np.frombuffer(n, np.int64)
            change[own] += np.frombuffer(c, np.float16).reshape(-1, CLASSES) * n[:, None].astype(np.float64)
            touched[own] += n
        own = np.flatnonzero(touched)
        return own.astype(np.int32), change[own] / touched[own][:, None], touched[own]
    one, two, pairs = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(next(rows), (np.int32, np.int32, np.int64), strict=True))
    for a, b, p in rows:
        one += np.frombuffer(a, np.int32)
        two += np.frombuffer(b, np.int32)
        pairs += np.frombuffer(p, np.int64)
    return one, two, pairs


def _grouped(finish):
    """A grouped Arrow function: reads a group's rows one at a time and yields what ``finish`` makes of their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list[int] = []

        def rows() -> Iterator[tuple[bytes, bytes, bytes]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    key[:] = (batch.column(k)[i].as_py() for k in range(3))
                    yield tuple(batch.column(k)[i].as_py() for k in (3, 4, 5))

        every = rows()
        first = next(every)
        yield finish(*key, _summed((x for part in ((first,), every) for x in part), key[0]))

    return run


def _partial(kind: int, block: int, part: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    a, b, c = found
    return _row(kind, block, part, a.astype(np.int32), b.astype(np.float16 if kind == 0 else np.int32), c)


def _final(shared):
    def finish(kind: int, block: int, part: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b, c = found
        if kind == 0:
            out = np.zeros((BLOCK, CLASSES), np.float32)
            out[a] = b
        else:
            model: Model = shared.value
            follows = np.stack([a, b]).reshape(2, CONTEXTS, -1).astype(np.float64)
            out = in_class_weights(model.bias[model.classes == block], follows, c.reshape(CONTEXTS, CONTEXTS).astype(np.float64)).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["kind", "block", "found"])

    return finish


def in_class_weights(bias: np.ndarray, follows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Weights (2, CONTEXTS, words) of a class's words after each class at either distance.

    ``follows`` counts each word after each context at both distances, ``pairs`` the class's places by
    both contexts. A step goes up the gradient, counted minus expected, with rare features held back.
    """
    after = np.zeros(follows.shape)
    for _ in range(IN_CLASS_STEPS):
        expected = np.zeros(follows.shape)
        for one in range(CONTEXTS):
            some = np.flatnonzero(pairs[one])
            logits = bias + after[0, one] + after[1, some]
            p = np.exp(logits - logits.max(axis=1, keepdims=True, initial=-np.inf)) if len(some) else logits
            p *= (pairs[one, some] / np.maximum(p.sum(axis=1), 1e-300))[:, None]
            expected[0, one] += p.sum(axis=0)
            expected[1, some] += p
        slope = (follows - expected - IN_CLASS_PRIOR * after) / (expected + IN_CLASS_PRIOR)
        after += 0.5 * np.clip(slope, -IN_CLASS_REACH, IN_CLASS_REACH)
    return after


def _head(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, at most HEAD_WORDS, and the end mark, by count and word.

    Words are first counted by the logarithm of their count, a few hundred rows; the head is all
    from the lowest step that fits, and of the next step the words with the lowest hashes, as far as
    there is room. No task sends the driver more than that.
    """
    step, share = F.floor(16 * F.log2("n")), F.pmod(F.crc32("word"), F.lit(4096))
    steps = sorted(((r.s, r.k) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    room, lowest, upto = HEAD_WORDS, None, -1
    for s, k in steps:
        lowest = s
        if k > room:
            upto = -1
            shares = sorted((r.h, r.k) for r in counts.filter(step == s).groupBy(share.alias("h")).agg(F.count("*").alias("k")).collect())
            for h, n in shares:
                if n > room:
                    break
                room, upto = room - n, h
            break
        room, upto = room - k, 4095
    inside = F.lit(False) if lowest is None else (step > lowest) | (step == lowest) & (share <= upto)
    chosen = (F.col("word") == F.lit(END)) | inside
    return sorted(((bytes(r.word), r.n) for r in counts.filter(chosen).collect()), key=lambda x: (-x[1], x[0]))


def train(train_docs: DataFrame, counts: DataFrame, text_col: str = "text", rounds: int = 1) -> Model:
    """The model for the training texts; ``counts`` are their word counts, pinned.

    The driver gets the head, class totals, one mean change of the weights a round and the weights of
    the classes' words, all of bounded size. What the partitions found is summed on the executors.
    """
    spark = counts.sparkSession
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _head(counts.filter(F.octet_length("word") <= HEAD_BYTES))
    total = {bytes(w): n for w, n in head}
    tail_class = F.pmod(F.crc32("word"), F.lit(TAIL_CLASSES))
    every = {r.c: (r.t, r.k) for r in counts.groupBy(tail_class.alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("k")).collect()}
    for w, n in total.items():
        c = zlib.crc32(w) % TAIL_CLASSES
        every[c] = (every[c][0] - n, every[c][1] - 1)
    model = Model(head, every, size[0], size[1])
    lines = train_docs.select(utf8(text_col).alias("text"))
    groups = 1 + math.isqrt(size[0] // PARTITION_TOKENS)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        # a block's or class's rows meet in two steps, so that no task reads those of all partitions
        found = lines.mapInArrow(_train_batches(shared), _CHANGE).withColumn("part", F.pmod("part", F.lit(groups)))
        found = found.groupBy("kind", "block", "part").applyInArrow(_grouped(_partial), _CHANGE)
        found = found.groupBy("kind", "block").applyInArrow(_grouped(_final(shared)), "kind int, block int, found binary")
        for r in found.toLocalIterator():
            values = np.frombuffer(r.found, np.float32)
            if r.kind == 0:
                own = model.weights[r.block * BLOCK : (r.block + 1) * BLOCK]
                own += values.reshape(-1, CLASSES)[: len(own)]
            else:
                model.after[:, :, model.classes == r.block] = values.reshape(2, CONTEXTS, -1)
        shared.unpersist()
    model.settle()
    return model


_PARTS = "struct<n: bigint, known: bigint, base: double, score: double, rare: array<struct<word: binary, n: bigint>>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def _score_batches(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = shared.value
        size, ten = len(model.index), math.log(10)
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            known, base, score = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch))
            rare: list[Counter[bytes]] = [Counter() for _ in range(len(batch))]
            rows = enumerate(x for part in texts(batch) for x in part)
            for ids, starts, owners, tails in _batched(model, rows):
                real = owners >= 0
                history, own, words = _history(ids, starts)[:, real], owners[real], ids[real]
                features, head = _rows(history, model.bits), words < size
                at = np.minimum(words, size - 1)
                right = model.classes_of(words)
                values = np.zeros(len(words))
                values[head] = model.in_class(words[head], right[head], model.contexts_of(history)[:, head])
                for a in range(0, len(own), MINIBATCH[1]):
                    some = _softmax(model.weights, features[:, a : a + MINIBATCH[1]])
                    values[a : a + MINIBATCH[1]] += some[np.arange(len(some)), right[a : a + MINIBATCH[1]]] / ten
                low, width = own.min(), own.max() - own.min() + 1
                for out, x in ((score, values), (base, np.where(head, model.base[at], 0.0)), (known, head & model.known[at])):
                    out[low : low + width] += np.bincount(own - low, x, width)
                n[low : low + width] += np.bincount(own - low, minlength=width)
                for owner, tail in tails:
                    rare[owner].update(tail)
            listed = [[{"word": w, "n": k} for w, k in c.items()] for c in rare]
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(listed, _RARE)], ["n", "known", "base", "score", "rare"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of ``docs``.

    Null and empty texts have one token, the end. A text's words outside the head are joined with
    ``counts`` as distinct words; a word that many texts hold meets the join's split partitions.
    Rows with the same id stay apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = F.arrow_udf(_score_batches(shared), _PARTS).asNondeterministic()
    scored = pin(docs.select(F.col(id_col).alias("id"), is_training(id_col, fold).alias("training"), parts(utf8(text_col)).alias("p")).select("id", "training", "p.*").withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", F.col("w.n").alias("tf"))
    totals = F.array(*(F.lit(float(x)) for x in model.class_total[1 + HEAD_CLASSES :]))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    in_class = F.log10((F.col("c") + ADD) / F.element_at(totals, (F.pmod(F.crc32("word"), F.lit(TAIL_CLASSES)) + 1).cast("int")))
    base = F.log10((F.col("c") + ADD) / F.lit(base_total(model.tokens, model.types)))
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * base).alias("more_base"),
        F.sum(F.col("tf") * in_class).alias("more_score"),
    )
    out = scored.join(added, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "id",
        (~F.col("training")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        plus("known", "more_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """Train on the rows whose crc32(id) mod ``fold`` is not 0 and score all rows.

    A null id hashes as the empty string. Without training rows every word is unseen. An empty
    table gives an empty result; other columns are not read.
    """
    training = docs.filter(is_training(id_col, fold))
    counts = pin(word_counts(training, text_col))
    return score(docs, train(training, counts, text_col), counts, id_col, text_col, fold)
