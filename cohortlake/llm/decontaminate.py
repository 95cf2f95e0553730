"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A window is a run of consecutive words of a benchmark item. Its tokens are its shingles of three
words (a window of fewer words is one shingle). Tokens are ordered by rarity, the number of their
places in all items; as a window has to be contained whole, its necessary prefix is its single rarest
shingle. Windows are filed under the hash of that token, with the token's place in the window.

Documents are probed by the hashes of their shingles. A bitmap of the prefix tokens' hashes, of a
bounded size, tells in one pass which places can meet at all; only these travel, each with the words
around it, and are joined with the windows by token. Positional and length bounds decide whether the
window fits there, then it is compared word by word. So neither a task nor the driver holds the
benchmark: items, tokens and windows are tables, and the join's side is chosen by its measured size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, texts, utf8, word_blocks

WINDOW = 13
SHINGLE = 3
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Bits of the bitmap: so many per token, at least and at most 2 ** these. A full bitmap lets more places travel.
BITS_PER_TOKEN = 64
BITMAP = (16, 28)
#: Words whose hashes a worker keeps before it starts anew.
KEEP = 500_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))
_SEED = 7


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Hashes:
    """Hashes of words, kept for the words seen, and of shingles from those."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEEP:
            known.clear()
        new = {w for w in words if w not in known}
        known.update((w, xxhash.xxh64_intdigest(w, _SEED)) for w in new)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    @staticmethod
    def shingles(hashed: np.ndarray, length: int) -> np.ndarray:
        """One hash for each run of ``length`` words."""
        n = max(0, len(hashed) - length + 1)
        out = np.full(n, length, np.uint64)
        for i in range(length):
            out = (out ^ hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


# -- the benchmark's side -------------------------------------------------------------------------

_TOKENS = "item_row long, place int, token long"
_WINDOWS = "token long, place int, n int, words string, item string"


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(data.as_py())
            tokens = hashes.shingles(hashes.words(words), min(SHINGLE, len(words))) if words else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), row)), pa.array(np.arange(len(tokens)), pa.int32()), pa.array(tokens.view(np.int64))], ["item_row", "place", "token"])


def _rarest(often: np.ndarray, tokens: np.ndarray, reach: int) -> np.ndarray:
    """The place of the rarest token in each run of ``reach`` tokens; ties go to the smaller hash, then the first."""
    order = np.empty(len(tokens), np.int64)
    order[np.lexsort((np.arange(len(tokens)), tokens, often))] = np.arange(len(tokens))
    runs = len(tokens) - reach + 1
    best = np.arange(runs)
    for i in range(1, reach):
        best = np.where(order[i : i + runs] < order[best], np.arange(i, i + runs), best)
    return best


def _window_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data, tokens, often in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = [w.decode() for w in words_of(data.as_py())]
                tokens, often = np.array(tokens.as_py(), np.int64), np.array(often.as_py(), np.int64)
                n = min(window, len(words))
                best = _rarest(often, tokens.view(np.uint64), n - min(SHINGLE, len(words)) + 1)
                for at in range(0, len(best), 4096):
                    part = best[at : at + 4096]
                    joined = [" ".join(words[i : i + n]) for i in range(at, at + len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[part]), pa.array(part - np.arange(at, at + len(part)), pa.int32()), pa.array(np.full(len(part), n), pa.int32()), pa.array(joined), pa.array([item.as_py()] * len(part), pa.string())], ["token", "place", "n", "words", "item"])

    return run


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(token, place, n, words, item): every window of every item, filed under its rarest shingle.

    Items that share an id count once; a null id counts as the empty string; wordless items have no
    window. Equal windows are filed alike, whichever item they are from.
    """
    items = pin(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("text")).withColumn("item_row", F.monotonically_increasing_id()))
    tokens = pin(items.select("item_row", "text").mapInArrow(_token_batches, _TOKENS))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    placed = tokens.join(often, "token").groupBy("item_row").agg(F.sort_array(F.collect_list(F.struct("place", "token", "often"))).alias("t"))
    whole = items.join(placed, "item_row").select("item", "text", F.col("t.token").alias("tokens"), F.col("t.often").alias("often"))
    return whole.mapInArrow(_window_batches(window), _WINDOWS).distinct()


def prefix_bitmap(filed: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the first bits of all tokens; the driver gets blocks of 4 KB, at most 2 ** BITMAP[1] bits."""
    n = filed.agg(F.count_distinct("token")).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * BITS_PER_TOKEN)), *BITMAP))
    place = F.expr(f"shiftrightunsigned(token, {64 - bits})")
    blocks = filed.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    out = np.zeros(max(1 << (bits - 3), 1 << 12), np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, out


# -- the documents' side --------------------------------------------------------------------------
_PLACES = "struct<n_words: bigint, places: array<struct<token: bigint, pos: bigint, lead: int, around: string>>>"
_PLACES_ARROW = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("around", pa.string())])))])


class Probe:
    """Finds the places of a text whose shingle may be a window's prefix."""

    def __init__(self, bits: int, bitmap: np.ndarray, lengths: list[int], window: int):
        self.bits, self.bitmap, self.lengths, self.window = bits, bitmap, lengths, window
        self.hashes = Hashes()

    def __call__(self, text: bytes) -> dict:
        """n_words, and (token, pos, lead, around): the words from ``lead`` before the place to a window behind it."""
        words, base, done, places = [], 0, 0, []
        blocks = word_blocks(text.translate(_LOWER))
        block = next(blocks, None)
        while block is not None:
            after = next(blocks, None)
            words += block
            limit = len(words) if after is None else max(done - base, len(words) - self.window + 1)
            self._look(words, base, done - base, limit, places)
            done, drop, block = base + limit, max(0, limit - self.window), after
            if block is not None:
                words, base = words[drop:], base + drop
        return {"n_words": base + len(words), "places": places}

    def _look(self, words: list[bytes], base: int, first: int, limit: int, places: list[dict]) -> None:
        hashed = self.hashes.words(words)
        for length in self.lengths:
            tokens = Hashes.shingles(hashed, length)[first:limit]
            at = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
            for i in np.flatnonzero(self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                p = first + i
                lead = min(p, self.window - 1)
                places.append({"token": int(tokens[i].view(np.int64)), "pos": base + p, "lead": lead, "around": b" ".join(words[p - lead : p + self.window]).decode()})


def _probe_batches(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        probe = Probe(*shared.value)
        for batch in batches:
            yield pa.array([probe(x) for part in texts(batch) for x in part], _PLACES_ARROW)

    return run


def digest(text: str) -> Column:
    """What names a text: its SHA-256. Null counts as empty."""
    return F.unhex(F.sha2(utf8(text), 256))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RANGES = "struct<starts: array<bigint>, ends: array<bigint>>"


def _merge_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    for batch in batches:
        rows = [merged([(x["start"], x["end"]) for x in ranges]) for ranges in batch.to_pylist()]
        yield pa.array([{"starts": [a for a, _ in r], "ends": [b for _, b in r]} for r in rows], kind)


def _probed(docs: DataFrame, filed: DataFrame, window: int, text_col: str) -> DataFrame:
    """The columns of ``docs`` but the text, and (digest, n_words, places), pinned."""
    bits, bitmap = prefix_bitmap(filed)
    lengths = sorted(r.n for r in filed.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((bits, bitmap, lengths, window))
    probe = F.arrow_udf(_probe_batches(shared), _PLACES).asNondeterministic()
    return pin(docs.select(*(c for c in docs.columns if c != text_col), digest(text_col).alias("digest"), probe(utf8(text_col)).alias("p")).select("*", "p.*").drop("p"))


def _hits(probed: DataFrame, filed: DataFrame) -> DataFrame:
    """(digest, starts, ends, items): one row per distinct text in which a window occurs."""
    places = probed.select("digest", F.explode("places").alias("c")).select("digest", "c.*").distinct()
    own = filed.select("token", "place", "n", "words").distinct()
    around, first = F.split("around", " "), F.col("lead") - F.col("place")
    fits = (first >= 0) & (F.size(around) - first >= F.col("n"))
    same = F.array_join(F.slice(around, F.greatest(first, F.lit(0)) + 1, F.col("n")), " ") == F.col("words")
    met = places.join(own, "token").filter(fits & same)
    hits = pin(met.select("digest", (F.col("pos") - F.col("place")).alias("start"), "n", "words"))
    ranges = hits.groupBy("digest").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("ranges"))
    merge = F.arrow_udf(_merge_batches, _RANGES).asNondeterministic()
    names = hits.select("digest", "words").distinct().join(filed.select("words", "item").distinct(), "words").select("digest", "item").distinct()
    items = names.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return ranges.select("digest", merge("ranges").alias("r")).join(items, "digest").select("digest", "r.starts", "r.ends", "items")


def found_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(digest, found): a row per distinct text with a hit; found is (n_words, starts, ends, items).

    starts and ends are the merged hit ranges in words. Null and wordless texts have no hit.
    """
    filed = pin(windows(benchmark, item_col, item_text_col, window))
    probed = _probed(docs.select(text_col), filed, window, text_col)
    sizes = probed.filter(F.size("places") > 0).groupBy("digest").agg(F.max("n_words").alias("n_words"))
    return sizes.join(_hits(probed, filed), "digest").select("digest", F.struct("n_words", "starts", "ends", "items").alias("found"))


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` but the text, and found: n_words, starts, ends (hit ranges in words) and items.

    One row per row of ``docs``. Null and wordless texts have no words and no hits; wordless items
    have no window. An item shorter than the window is one window. Items that share an id count once;
    a null id counts as the empty string. Equal texts are searched together and have equal results.
    Other columns must not be named digest, n_words, places, starts, ends, items or found. Without
    items, nothing is hit; an empty table gives an empty result.
    """
    filed = pin(windows(benchmark, item_col, item_text_col, window))
    probed = _probed(docs, filed, window, text_col)
    none, nobody = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    found = F.struct("n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", nobody).alias("items"))
    kept = [c for c in docs.columns if c != text_col]
    return probed.drop("places").join(_hits(probed, filed), "digest", "left").select(*kept, found.alias("found"))


def n_hit(found: str = "found") -> Column:
    """Words that are hit, from the merged ranges."""
    spans = F.zip_with(f"{found}.starts", f"{found}.ends", lambda a, b: b - a)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)


def contaminated(found: str = "found") -> Column:
    hit = n_hit(found)
    return (hit > 0) & (ONE_IN * hit >= F.col(f"{found}.n_words"))
