"""Discovery of burned-in text: sampling, classes, clusters, zones and density."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD_X, PAD_Y = 20, 10
MIN_OCCURRENCE = 0.1
MIN_SIDE = 5
#: Candidates of one machine that are clustered together: a sample of instances bounds them.
SAMPLE = 50


def sample_instances(instances: DataFrame, n: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``n`` instances, the first by a hash of the uid: the same ones on every run."""
    return instances.orderBy(F.xxhash64(F.lit(seed), "sop_instance_uid"), "sop_instance_uid").limit(n)


def classify_text(text: Column) -> Column:
    """NAME_PATTERN (a caret and a letter), PROPER_NOUN_CANDIDATE (a longer word with a capital), TEXT."""
    clean = F.trim(text)
    names = F.contains(clean, F.lit("^")) & clean.rlike(r"\p{L}")
    word = r"(?U)(?:^|\s)[^\w\s]*\p{Lu}[^\w\s]*\w"
    return F.when(names, "NAME_PATTERN").when(clean.rlike(word), "PROPER_NOUN_CANDIDATE").otherwise("TEXT")


def density(candidates: DataFrame, rows: int = 10, cols: int = 10) -> DataFrame:
    """(r, c, n) for every cell: centres of the boxes, scaled by the largest left and top edge."""
    spark = candidates.sparkSession
    most = candidates.agg(F.max("x").alias("mx"), F.max("y").alias("my")).select(F.when(F.col("mx") == 0, 1).otherwise(F.col("mx")).alias("mx"), F.when(F.col("my") == 0, 1).otherwise(F.col("my")).alias("my"))
    half = lambda at, side: F.col(at) + F.floor(F.col(side) / 2)
    cell = lambda at, side, top, n: F.least(F.floor(half(at, side) / F.col(top) * n), F.lit(n - 1)).cast("int")
    found = candidates.crossJoin(F.broadcast(most)).groupBy(cell("y", "h", "my", rows).alias("r"), cell("x", "w", "mx", cols).alias("c")).agg(F.count("*").alias("n"))
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return grid.join(found, ["r", "c"], "left").select("r", "c", F.coalesce("n", F.lit(0)).alias("n"))


def heat_map(cells: DataFrame) -> str:
    """The density as text; a grid has a fixed number of cells."""
    by_cell = {(r.r, r.c): r.n for r in cells.collect()}
    mark = lambda n: "#" if n > 50 else "O" if n > 10 else "o" if n > 5 else "." if n else " "
    rows, cols = max((r for r, _ in by_cell), default=-1) + 1, max((c for _, c in by_cell), default=-1) + 1
    return "\n".join("|" + "".join(mark(by_cell.get((r, c), 0)) for c in range(cols)) + "|" for r in range(rows))


def _roots(pdf):
    """Connected boxes by a sweep over x: only boxes that are still open are compared."""
    import numpy as np

    pdf = pdf.sort_values("candidate").reset_index(drop=True)
    left, right = pdf.x.to_numpy() - pdf.pad_x.to_numpy(), (pdf.x + pdf.w).to_numpy()
    top, bottom = pdf.y.to_numpy() - pdf.pad_y.to_numpy(), (pdf.y + pdf.h).to_numpy()
    parent = np.arange(len(pdf))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    open_: list[int] = []
    for i in np.argsort(left, kind="stable"):
        open_ = [j for j in open_ if right[j] >= left[i]]
        for j in open_:
            if top[i] <= bottom[j] and top[j] <= bottom[i]:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        open_.append(i)
    ids = pdf.candidate.to_numpy()
    lowest: dict[int, int] = {}
    for i in range(len(pdf)):
        lowest[find(i)] = min(lowest.get(find(i), ids[i]), ids[i])
    return pdf.assign(cluster=[lowest[find(i)] for i in range(len(pdf))])


def clusters(candidates: DataFrame, pad_x: int = PAD_X, pad_y: int = PAD_Y, by: str = "serial_number") -> DataFrame:
    """``candidates`` (by, candidate, x, y, w, h, ...) with cluster, the smallest candidate connected.

    Boxes connect when they touch after one of them is padded. Only the boxes of one machine are
    compared; its sample of instances bounds them.
    """
    padded = candidates.select(by, "candidate", "x", "y", "w", "h").withColumns({"pad_x": F.lit(pad_x), "pad_y": F.lit(pad_y)})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in padded.schema) + ", cluster bigint"
    found = padded.groupBy(by).applyInPandas(_roots, schema).select(by, "candidate", "cluster")
    return candidates.join(found, [by, "candidate"])


def zones(clustered: DataFrame, n_sources: int, min_occurrence: float = MIN_OCCURRENCE, by: str = "serial_number") -> DataFrame:
    """Zones of clusters that occur in enough sources and are larger than noise.

    (by, cluster, r1, r2, c1, c2, occurrence, type, examples, confidence)
    """
    kind = lambda k: F.bool_or(F.col("classification") == k)
    noun = F.bool_or(F.col("classification").isin("PROPER_NOUN", "PROPER_NOUN_CANDIDATE"))
    merged = clustered.groupBy(by, "cluster").agg(
        F.min("y").alias("r1"), F.max(F.col("y") + F.col("h")).alias("r2"), F.min("x").alias("c1"), F.max(F.col("x") + F.col("w")).alias("c2"),
        (F.countDistinct("source_index") / F.lit(n_sources)).alias("occurrence"),
        F.when(kind("NAME_PATTERN"), "LIKELY_NAME").when(noun, "PROPER_NOUN").otherwise("TEXT").alias("type"),
        F.slice(F.array_sort(F.collect_set("text")), 1, 3).alias("examples"),
        F.avg("confidence").alias("confidence"),
    )
    return merged.filter((F.col("occurrence") >= min_occurrence) & (F.col("c2") - F.col("c1") > MIN_SIDE) & (F.col("r2") - F.col("r1") > MIN_SIDE))


def stability(found: DataFrame) -> DataFrame:
    """Zones with STATIC_ALWAYS (over 0.9 of sources), STATIC_FREQUENT (over half) or TRANSIENT."""
    o = F.col("occurrence")
    return found.withColumn("status", F.when(o > 0.9, "STATIC_ALWAYS").when(o > 0.5, "STATIC_FREQUENT").otherwise("TRANSIENT"))


def merged_boxes(clustered: DataFrame, by: str = "serial_number") -> DataFrame:
    """One union box (x, y, w, h) per cluster, with the candidates in it."""
    return clustered.groupBy(by, "cluster").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.array_sort(F.collect_list("candidate")).alias("candidates")
    )


def confident(regions: DataFrame, least: float = 80.0) -> DataFrame:
    """Regions with some text and enough confidence."""
    return regions.filter((F.length(F.trim("text")) > 0) & (F.col("confidence") > 0) & (F.col("confidence") >= least))


def filtered(candidates: DataFrame, predicate: float | Column = 0.0) -> DataFrame:
    """Candidates of at least some confidence, or those that a condition holds for."""
    return candidates.filter(predicate if isinstance(predicate, Column) else F.col("confidence") >= predicate)


def named_entities(candidates: DataFrame, factory: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """``candidates`` with PROPER_NOUN where a recogniser finds a person or organisation in a text.

    ``factory`` makes the recogniser, once per Python worker; name patterns stay what they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finds = factory()
        for batch in batches:
            yield pa.array([bool(t and t.strip() and finds(t.strip())) for t in batch.to_pylist()])

    hit = F.arrow_udf(run, "boolean").asNondeterministic()("text")
    marked = candidates.withColumn("_entity", hit)
    return marked.withColumn("classification", F.when((F.col("classification") != "NAME_PATTERN") & F.col("_entity"), "PROPER_NOUN").otherwise(F.col("classification"))).drop("_entity")
