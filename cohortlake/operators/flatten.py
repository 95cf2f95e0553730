"""Flattening, subsets, and the safe-export filter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..plans.cohort import Cohort

#: Levels from the narrowest to the widest, as they are named in reports.
LEVELS = {"SOPInstanceUID": "sop_instance_uid", "SeriesInstanceUID": "series_instance_uid", "StudyInstanceUID": "study_instance_uid", "PatientID": "patient_id"}


def flatten(cohort: Cohort, patient_ids: list[str] | None = None, instance_uids: list[str] | None = None) -> DataFrame:
    """One row per instance with its series, study and patient; empty lists mean no filter."""
    patients, instances = cohort.patients, cohort.instances
    if patient_ids:
        patients = patients.filter(F.col("patient_id").isin(patient_ids))
    if instance_uids:
        instances = instances.filter(F.col("sop_instance_uid").isin(instance_uids))
    return instances.join(cohort.series, "series_instance_uid").join(cohort.studies, "study_instance_uid").join(patients, "patient_id")


def cohort_report(cohort: Cohort, metadata: list[str] | None = None) -> DataFrame:
    """The report columns, and one more for each attribute in ``metadata``.

    Missing equipment is an empty string. An attribute named like a report column overrides it.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    columns = {
        "PatientID": F.col("patient_id"),
        "PatientName": F.col("patient_name"),
        "StudyInstanceUID": F.col("study_instance_uid"),
        "StudyDate": F.col("study_date").cast("string"),
        "SeriesInstanceUID": F.col("series_instance_uid"),
        "Modality": F.col("modality"),
        "SOPInstanceUID": F.col("sop_instance_uid"),
        "Manufacturer": text("manufacturer"),
        "Model": text("model_name"),
        "DeviceSerial": text("device_serial_number"),
    }
    columns |= {tag: F.col("attributes")[tag] for tag in metadata or ()}
    return flatten(cohort).select(*(c.alias(k) for k, c in columns.items()))


def attribute_keys(instances: DataFrame) -> list[str]:
    """All attribute keys seen; one column each in an expanded report."""
    return sorted(r.k for r in instances.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().collect())


def _condition(query: str) -> str:
    """A pandas-style query in Spark's SQL: quotes, ==, and/or/not/in and backticks carry over."""
    parts = re.split(r"('[^']*'|\"[^\"]*\")", query)
    for i, part in enumerate(parts):
        if i % 2:
            parts[i] = "'" + part[1:-1].replace("\\", "\\\\").replace("'", "\\'") + "'"
        else:
            parts[i] = part.replace("[", "(").replace("]", ")").replace("&", " and ").replace("|", " or ").replace("~", " not ")
    return "".join(parts)


def subset_query(report: DataFrame, query: str) -> DataFrame:
    return report.filter(F.expr(_condition(query)))


def subset_frame(report: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the report whose id is in ``chosen``, by the narrowest level that it has."""
    level = next((c for c in LEVELS if c in chosen.columns), None)
    if level is None:
        raise ValueError(f"none of {', '.join(LEVELS)} in the subset")
    return report.join(chosen.select(level).distinct(), level, "left_semi")


def subset_ids(report: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the report with any of their four ids in the one column of ``ids``.

    The three wider ids are looked up once per series; of the instances, only those of other series
    are looked up by their own.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    wide = report.select("SeriesInstanceUID", "StudyInstanceUID", "PatientID").distinct()
    chosen = wide.select("SeriesInstanceUID", F.explode(F.array("SeriesInstanceUID", "StudyInstanceUID", "PatientID")).alias("id")).join(wanted, "id", "left_semi").select("SeriesInstanceUID").distinct()
    rest = report.join(chosen, "SeriesInstanceUID", "left_anti").join(wanted, F.col("SOPInstanceUID") == F.col("id"), "left_semi")
    return report.join(chosen, "SeriesInstanceUID", "left_semi").select(*report.columns).unionByName(rest.select(*report.columns))


def safe_cohort(cohort: Cohort, findings: DataFrame) -> Cohort:
    """The cohort without rows that have a finding: each level's table meets its own ids, before any fan-out."""
    dirty = findings.select("entity_uid").filter("entity_uid is not null").distinct()
    clean = lambda df, key: df.join(dirty, F.col(key) == F.col("entity_uid"), "left_anti")
    return cohort.map(
        patients=lambda df: clean(df, "patient_id"), studies=lambda df: clean(df, "study_instance_uid"),
        series=lambda df: clean(df, "series_instance_uid"), instances=lambda df: clean(df, "sop_instance_uid"),
    )


def safe_export(cohort: Cohort, findings: DataFrame, patient_ids: list[str] | None = None) -> DataFrame:
    """Flattened instances without a finding on them or any ancestor."""
    return flatten(safe_cohort(cohort, findings), patient_ids)


def export_paths(cohort: Cohort, folder: str = "") -> DataFrame:
    """(sop_instance_uid, path): Subject/Study/Series/instance.dcm.

    Descriptions are those of the first instance, by uid, of the study and series. Instances are
    gathered once per series; studies and names are worked out on one row per series.
    """
    tag = lambda t: F.col("attributes")[t]
    first = cohort.instances.groupBy("series_instance_uid").agg(
        F.min("sop_instance_uid").alias("first_uid"), F.min_by(tag("0008,1030"), "sop_instance_uid").alias("first_study"), F.min_by(tag("0008,103e"), "sop_instance_uid").alias("series_description")
    )
    series = cohort.series.join(first, "series_instance_uid")
    study = series.groupBy("study_instance_uid").agg(F.min_by("first_study", "first_uid").alias("study_description"))
    named = series.join(study, "study_instance_uid").join(cohort.studies, "study_instance_uid").join(cohort.patients.select("patient_id"), "patient_id")
    start = F.concat_ws(
        "/",
        naming.subject_folder(F.col("patient_id")),
        naming.study_folder(F.col("study_date"), F.col("study_description"), F.col("study_instance_uid")),
        naming.series_folder(F.col("series_number"), F.col("modality"), F.col("series_description"), F.col("series_instance_uid")),
    )
    start = F.concat(F.lit(folder.rstrip("/") + "/"), start) if folder else start
    path = F.concat("start", F.lit("/"), "sop_instance_uid", F.lit(".dcm"))
    return cohort.instances.select("sop_instance_uid", "series_instance_uid").join(named.select("series_instance_uid", start.alias("start")), "series_instance_uid").select("sop_instance_uid", path.alias("path"))


def findings_rows(findings: DataFrame) -> DataFrame:
    """The eight report columns of findings, values as text."""
    return findings.select("patient_id", "entity_type", "entity_uid", F.col("field_name").alias("field"), F.col("value").cast("string").alias("value"), "reason", F.col("action_type").alias("action"), F.col("new_value").alias("proposed_value"))
