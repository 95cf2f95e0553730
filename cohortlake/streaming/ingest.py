"""Files into a session's cohort as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from ..sources import dicom


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files below a folder as they appear."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)


def ingest_stream(session: Session, folder: str, checkpoint: str, name: str = "stream"):
    """A query that parses new files and adds them to the session's cohort.

    A batch that comes twice adds nothing the second time: its instances are known, and its rows carry
    the stream's name and the batch's number as a tag.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        session.add_records(batch.select("path", dicom.parsed("content", session.codecs).alias("record")), f"{name}-{batch_id}")

    return file_stream(session.spark, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
