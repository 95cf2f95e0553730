"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; below the warehouse on a local master without one.

    A cluster without the setting is refused, as its executors share no folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: the executors need a shared folder")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores behind it as no column of the table has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def wide(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt over all tasks by ``columns``, before a step that makes many rows of one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, n: str, out: str) -> DataFrame:
    """Each row as often as its column ``n`` says, with 0, 1, ... in ``out``; big numbers go in steps, so no long array is made."""
    step = 1 << 14
    stepped = df.withColumn(out, F.explode(F.expr(f"sequence(0L, {n} - 1, {step}L)")))
    return stepped.withColumn(out, F.explode(F.expr(f"sequence({out}, least({out} + {step - 1}, {n} - 1))")))


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists made from about ``size`` bytes each.

    A very long text is never split into words all at once, so memory stays bounded.
    """
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, min(at + size, len(data)))
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def texts(array, at_once: int = 256) -> Iterator[list[bytes]]:
    """The values of an Arrow binary array, in lists of at most ``at_once``."""
    for start in range(0, len(array), at_once):
        yield array.slice(start, at_once).to_pylist()
