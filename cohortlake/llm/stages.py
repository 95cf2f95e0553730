"""Operators as steps of a corpus pipeline: documents in, documents out.

Decisions that need the whole corpus are worked out on narrow rows and joined back by id. Ids
that repeat are rare, so they take a path of their own that tells their rows apart; nothing is
dropped for having a repeated or a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import decontaminate, mixing, sharding, simhash, toxicity
from .common import pin, unused


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that score below 0.5. Null and empty texts stay unless such a text scores 0.5.

    Repeated rows score alike and stay or leave together; columns of any name stay as they are.
    """
    (mark,) = unused(docs.columns, "score")
    scored = toxicity.toxicity(docs, labels, out=mark)
    return scored.filter(F.col(mark) < 0.5).select(*docs.columns)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near-copies: that with the smallest id.

    If rows of a group share that id, the one with the smallest fingerprint stays. A group whose
    ids are all null keeps one row. Wordless texts, null ones among them, are one group. Columns of
    any name stay as they are.
    """
    found = pin(simhash.near_duplicates(docs))
    chosen = found.filter(F.col("id").eqNullSafe(F.col("component_id")))
    stays = chosen.groupBy("group").agg(F.min("fp").alias("fp"), F.min("id").alias("id"))
    repeated = found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id")
    return _split(docs, repeated, lambda rest: _once(rest, stays), stays.select("id"))


def _split(docs: DataFrame, repeated: DataFrame, odd, kept: DataFrame) -> DataFrame:
    """Rows with an id in ``kept``; those with a repeated or null id go through ``odd``."""
    (key,) = unused(docs.columns, "key")
    only = kept.join(repeated, kept.id.eqNullSafe(repeated.id), "left_anti").withColumnRenamed("id", key)
    plain = docs.join(only, F.col("doc_id") == F.col(key), "left_semi")
    if repeated.isEmpty():
        return plain
    rest = docs.join(repeated.withColumnRenamed("id", key), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    return plain.unionByName(odd(rest))


def _once(rest: DataFrame, stays: DataFrame) -> DataFrame:
    mark, key, fp = unused(rest.columns, "print", "key", "fp")
    marked = rest.withColumn(mark, simhash.fingerprint_column("text"))
    wanted = stays.select(F.col("id").alias(key), F.col("fp").alias(fp))
    chosen = marked.join(wanted, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(fp)), "left_semi")
    return chosen.dropDuplicates(["doc_id", mark]).select(*rest.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that are not contaminated by a benchmark.

    Null and wordless texts stay. Repeated texts stay or leave together, whatever their ids; columns
    of any name stay as they are. Without items every row stays.
    """
    (mark,) = unused(docs.columns, "digest")
    found = decontaminate.found_texts(docs, benchmark)
    bad = found.filter(decontaminate.contaminated()).select(F.col("digest").alias(mark))
    clean = docs.withColumn(mark, decontaminate.digest("text")).join(bad, mark, "left_anti")
    return clean.select(*docs.columns)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it; the row at a source's cut is taken whole.

    Rows that the mix takes nothing of, wordless and null texts among them, leave. Rows that share an
    id, or have none, are told apart by source and size. Columns of any name stay as they are.
    """
    key, mark = unused(docs.columns, "key", "copies")
    mixed = pin(mixing.mix(docs))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = mixed.select("id", "source", "size", copies.alias("copies"))
    repeated = plan.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id")
    single = plan.filter("copies > 0").join(repeated, plan.id.eqNullSafe(repeated.id), "left_anti").select(F.col("id").alias(key), F.col("copies").alias(mark))
    out = docs.join(single, F.col("doc_id") == F.col(key)).drop(key)
    if not repeated.isEmpty():
        rest = docs.join(repeated.withColumnRenamed("id", key), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
        out = out.unionByName(_odd_copies(rest, plan.join(repeated, plan.id.eqNullSafe(repeated.id), "left_semi"), mark))
    return out.withColumn(mark, F.explode(F.sequence(F.lit(1), F.col(mark)))).select(*docs.columns)


def _odd_copies(rest: DataFrame, plan: DataFrame, mark: str) -> DataFrame:
    """Rows that share an id: the n-th of those alike in id, source and size gets the n-th number of copies."""
    size, place, key, source, words, at = unused([*rest.columns, mark], "size", "nth", "key", "of", "words", "at")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by[:3]).orderBy(by[3]))
    left = rest.withColumn(size, mixing.n_words("text")).withColumn(place, nth("doc_id", "source", size, "text"))
    right = plan.select(F.col("id").alias(key), F.col("source").alias(source), F.col("size").alias(words), F.col("copies").alias(mark), nth("id", "source", "size", F.desc("copies")).alias(at))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(words)) & (F.col(place) == F.col(at))
    return left.join(right, same).filter(F.col(mark) > 0).select(*rest.columns, mark)


def place(docs: DataFrame) -> DataFrame:
    """Rows with their virtual slot, shard, and the shard if there were one more.

    No row leaves; rows with a null id share a slot, null texts count as empty, repeated rows go the
    same way. Columns named virtual_slot, shard or grown_shard are replaced, others stay.
    """
    return sharding.assign(docs)
