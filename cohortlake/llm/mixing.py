"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. The key's leading hex digits cut every source into key
ranges of even size, so a source that holds most of the corpus is still sorted by many tasks.
Range totals give each range its offset and a running sum inside the range does the rest: a
distributed prefix sum of sizes in key order. The source is cut where its budget ends exactly.
Budgets above the source's size take whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, pin

#: A target stops at so many times its source's size.
MAX_EPOCHS = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Hex digits of the key that name its range: 16 ** 3 ranges for each source.
RANGE_DIGITS = 3


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """(id, source, size, key): size in words (null text: 0), key a hash of seed, id and text.

    Rows with one id, or none, still get keys of their own as long as their texts differ.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest).cast("binary"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row per source, null last.

    The sum of all sizes is shared by weight. A target that would pass its cap stops there and
    the excess is reshared: with sources ordered by cap over weight, the first k are capped and
    the others share what is left by weight, for the smallest k where none of them is above.
    One row per source is windowed in one place, never the documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", MAX_EPOCHS * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # this source and all after it stay below their caps
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("weight_left"))
        .withColumn("open", F.max(F.col("fits").cast("int")).over(upto) == 1)
        .withColumn("open_left", F.first(F.when(F.col("fits"), F.col("left")), ignorenulls=True).over(every))
        .withColumn("open_weight", F.first(F.when(F.col("fits"), F.col("weight_left")), ignorenulls=True).over(every))
    )
    target = F.when(F.col("open"), F.col("weight") * F.col("open_left") / F.col("open_weight")).otherwise(F.col("cap").cast("double"))
    return shares.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(id, source, size, key, source_size, target, taken): one row per row of ``docs``.

    taken is the number of words the mix takes from the document, repeats counted; the sum over
    a source is its target rounded down. Null texts have size 0 and take nothing. A null source
    is a source of its own, the last one. Rows that repeat with the same id and text share a key and
    are interchangeable: they travel as one row with their number. Ties in key order fall back to id and size. If all sizes are 0, so
    are all targets. Other columns of ``docs`` are not read.
    """
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    sized = pin(sizes(docs, id_col, text_col, source_col, seed)).withColumns({"group": group, "range": F.substring("key", 1, RANGE_DIGITS)})
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("group", "range").agg(F.sum("size").alias("range_size"))
    offsets = ranges.select("group", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    shares = targets(sized, weights).select(group.alias("group"), "source_size", "target")
    inside = Window.partitionBy("group", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = sized.groupBy("group", "range", "key", "id", "size", "source").agg(F.count("*").alias("n"))
    running = alike.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
    each = numbered(running, "n", "nth").withColumn("inside", F.col("before") + F.col("nth") * F.col("size"))
    placed = each.join(offsets.join(shares, "group"), ["group", "range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select("id", "source", "size", "key", "source_size", "target", taken.alias("taken"))
