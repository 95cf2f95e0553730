"""Token counts under a unigram segmentation, with forward scores shared along common prefixes.

A text is cut into pre-tokens at white space, each with the word mark in front. Distinct
pre-tokens are inserted in a trie. A node holds the best score of any segmentation of its prefix
and that segmentation's number of tokens, worked out once from the nodes above it, whichever batch
brings the prefix first; the last node's number is the word's terminal count. The trie lives as long
as its worker and starts anew beyond NODES nodes or KEEP words; that costs time only. Words over
MAX_SHARED bytes are segmented alone, so that one word can't fill the trie.

The vocabulary is a published one, given by its path. It ranks its pieces but has no
probabilities, so a piece of rank r scores as in Zipf's law, -log(r + 2) - log(log(size)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, utf8, word_blocks

MARK = "▁"
#: A character outside the vocabulary scores so much below the worst piece and counts its bytes.
UNKNOWN_PENALTY = 10.0
#: Nodes and terminal counts that a worker keeps before it starts anew, and words that it looks up together.
NODES = 600_000
KEEP = 600_000
TOGETHER = 400_000
#: Words of more bytes are segmented alone and not kept.
MAX_SHARED = 256


#: The vocabulary file where none is given: a SentencePiece model on the driver's disk.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def piece_scores(path: str) -> dict[str, float]:
    """The vocabulary's pieces and scores; control, byte and white-space pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scale = math.log(math.log(max(3, model.get_piece_size())))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    words = [(model.id_to_piece(i), model.get_score(i)) for i in plain]
    return {p: -math.log(2 - score) - scale for p, score in words if p.strip(MARK) or p == MARK}


def _backwards(scores: dict[str, float]) -> dict:
    """The pieces as nested dicts from last character to first; "" holds a piece's score."""
    root: dict = {}
    for piece, score in scores.items():
        at = root
        for char in reversed(piece):
            at = at.setdefault(char, {})
        at[""] = score
    return root


class Trie:
    """Forward scores of word prefixes by node, and the terminal counts of words.

    A node is a number; an edge leads from a node and a character to a node.
    """

    def __init__(self, scores: dict[str, float]):
        self.pieces = _backwards(scores)
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._clear()

    def _clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    @property
    def nodes(self) -> int:
        return len(self.best) - 1

    def _last(self, word: str, end: int, base: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and fewest tokens of word[:end]; best[i] and tokens[i] are of word[: base + i]."""
        top, fewest, at = None, 0, self.pieces
        for start in range(end - 1, base - 1, -1):
            at = at.get(word[start])
            if at is None:
                break
            score = at.get("")
            if score is not None:
                total, n = best[start - base] + score, tokens[start - base] + 1
                if top is None or total > top or total == top and n < fewest:
                    top, fewest = total, n
        char = word[end - 1]
        if "" not in self.pieces.get(char, ()):
            total, n = best[end - 1 - base] + self.unknown, tokens[end - 1 - base] + len(char.encode())
            if top is None or total > top or total == top and n < fewest:
                top, fewest = total, n
        return top, fewest

    def _alone(self, word: str) -> int:
        """A long word: only the scores that a longest piece can reach back to are kept."""
        best, tokens, base = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            b, t = self._last(word, end, base, best, tokens)
            best.append(b)
            tokens.append(t)
            if len(best) > 64 * self.longest:
                base += len(best) - self.longest
                del best[: -self.longest], tokens[: -self.longest]
        return tokens[-1]

    def learn(self, words: set[bytes]) -> None:
        """Insert the words that are new and store their terminal counts."""
        if len(self.terminal) + len(words) > KEEP or self.nodes > NODES:
            self._clear()
        for word in words:
            if len(word) <= MAX_SHARED and word not in self.terminal:
                self.terminal[word] = self._insert(MARK + word.decode())

    def _insert(self, text: str) -> int:
        edges, node, best, tokens = self.edges, 0, [0.0], [0]
        for end, char in enumerate(text, 1):
            edge = node << 21 | ord(char)
            below = edges.get(edge)
            if below is None:
                b, t = self._last(text, end, 0, best, tokens)
                below = edges[edge] = len(self.best)
                self.best.append(b)
                self.tokens.append(t)
            node = below
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        return tokens[-1]

    def count(self, words: list[bytes]) -> int:
        """The number of tokens of a list of pre-tokens that were learnt, or are long."""
        own = self.terminal.get
        return sum(n if (n := own(word)) is not None else self._alone(MARK + word.decode()) for word in words)


def _counts(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(shared.value)
        for batch in batches:
            words, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            waiting: list[tuple[int, list[bytes]]] = []
            held = 0

            def flush() -> None:
                nonlocal held
                trie.learn({w for _, block in waiting for w in block})
                for i, block in waiting:
                    words[i] += len(block)
                    tokens[i] += trie.count(block)
                waiting.clear()
                held = 0

            for i, data in enumerate(x for part in texts(batch) for x in part):
                for block in word_blocks(data):
                    waiting.append((i, block))
                    held += len(block)
                    if held >= TOGETHER:
                        flush()
            flush()
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(tokens)], ["n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, text: str | Column = "text", vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """``docs`` with a column ``out`` of (n_words, n_tokens), without a shuffle.

    Null, empty and blank texts have no words and no tokens; equal texts have equal counts. Rows and other columns stay; a column
    already named ``out`` is replaced. The vocabulary file bounds what is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(vocabulary or VOCABULARY))
    run = _counts(shared)
    return docs.withColumn(out, F.arrow_udf(run, "struct<n_words: bigint, n_tokens: bigint>").asNondeterministic()(utf8(text)))
