"""Names of exported folders and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_filename(name: Column) -> Column:
    """Stripped, spaces as underscores, only word characters, dots and hyphens (any script)."""
    return F.regexp_replace(F.replace(F.trim(name), F.lit(" "), F.lit("_")), r"(?U)[^-\w.]", "")


def clean_label(name: Column) -> Column:
    """Letters, digits, blanks, dots, underscores and hyphens, stripped; ``Unknown`` if none is left."""
    kept = F.replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} ._-]", "")), F.lit(" "), F.lit("_"))
    return F.when(kept.isNull() | (kept == ""), "Unknown").otherwise(kept)


def subject_folder(patient_id: Column) -> Column:
    given = F.when(patient_id.isNull() | (patient_id == ""), "UnknownPatient").otherwise(patient_id)
    return F.concat(F.lit("Subject_"), clean_filename(given))


def study_folder(study_date: Column, description: Column, uid: Column) -> Column:
    name = F.concat_ws("_", F.lit("Study"), F.coalesce(study_date.cast("string"), F.lit("NoDate")), F.coalesce(description, F.lit("Study")), F.right(uid, F.lit(5)))
    return clean_filename(name)


def series_folder(number: Column, modality: Column, description: Column, uid: Column) -> Column:
    name = F.concat_ws("_", F.lit("Series"), number.cast("string"), F.coalesce(modality, F.lit("OT")), F.coalesce(description, F.lit("Series")), F.right(uid, F.lit(5)))
    return clean_filename(name)


def numbered_file(instance_number: Column, uid: Column) -> Column:
    """Four digits at least, or the uid where there is no number."""
    return F.when(instance_number.isNotNull(), F.concat(F.format_string("%04d", instance_number), F.lit(".dcm"))).otherwise(F.concat(uid, F.lit(".dcm")))
