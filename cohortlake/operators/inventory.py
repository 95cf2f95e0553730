"""Counts, equipment, the audit log's summaries and the compliance status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import BURNED_IN, is_burned_in, is_derived
from ..plans.cohort import Cohort

MACHINE = ("manufacturer", "model_name", "device_serial_number")


def counts(cohort: Cohort) -> DataFrame:
    """(level, n) for the four levels."""
    parts = [getattr(cohort, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("level"), "n") for t in ("patients", "studies", "series", "instances")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def equipment_counts(cohort: Cohort) -> DataFrame:
    """Instances per manufacturer and model; series without equipment don't count.

    Instances are counted per series before the join, so the join moves one row per series.
    """
    per_series = cohort.instances.groupBy("series_instance_uid").agg(F.count("*").alias("n"))
    known = cohort.series.filter("manufacturer is not null or model_name is not null")
    return known.join(per_series, "series_instance_uid").groupBy("manufacturer", "model_name").agg(F.sum("n").alias("n"))


def distinct_equipment(cohort: Cohort) -> DataFrame:
    return cohort.series.select(*MACHINE).filter("coalesce(manufacturer, model_name, device_serial_number) is not null").distinct()


def unsafe_attributes(cohort: Cohort) -> DataFrame:
    return cohort.instances.filter(is_burned_in(F.col("attributes"))).select("sop_instance_uid", "file_path")


def untreated_burned_in(cohort: Cohort) -> DataFrame:
    a = F.col("attributes")
    return cohort.instances.filter(is_burned_in(a) & ~is_derived(a)).select("sop_instance_uid")


def burned_in_by_machine(cohort: Cohort) -> DataFrame:
    per_series = cohort.instances.groupBy("series_instance_uid").agg(F.count_if(is_burned_in(F.col("attributes"))).alias("n"))
    return cohort.series.filter("device_serial_number <> ''").join(per_series, "series_instance_uid").groupBy("device_serial_number").agg(F.sum("n").alias("n"))


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("action_type").agg(F.count("*").alias("n"))


def log_errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("action_type").isin("ERROR", "WARNING")).orderBy("ts", "entity_uid")


def compliance(log: DataFrame) -> DataFrame:
    """PASS if something was logged and nothing failed, with the counts behind it."""
    failed = F.count_if(F.col("action_type").isin("ERROR", "WARNING"))
    return log.agg(F.count("*").alias("n_actions"), failed.alias("n_exceptions"), F.count_if(F.col("action_type") == "RISK").alias("n_risks")).select(
        "*", F.when((F.col("n_actions") > 0) & (F.col("n_exceptions") == 0), "PASS").otherwise("REVIEW_REQUIRED").alias("status")
    )


def manifest_totals(items: DataFrame) -> DataFrame:
    """(n_items, total_bytes) of rows with a size."""
    return items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def export_summary(results: DataFrame) -> DataFrame:
    """(n, n_ok, n_failed, first_error) of exported (path, error) rows."""
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.min("error").alias("first_error"))


def exactly_burned_in(cohort: Cohort) -> DataFrame:
    """Instances whose flag is spelled YES and nothing else."""
    return cohort.instances.filter(F.col("attributes")[BURNED_IN] == "YES").select("sop_instance_uid", "file_path")
