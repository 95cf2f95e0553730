"""Checks of instances against the attributes their class requires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required attributes by module, type 1 (present and not empty) or 2 (present),
# and the modules of each checked class.
MODULES = {
    "Common": {"0008,0016": 1, "0008,0018": 1, "0008,0020": 1, "0008,0030": 1, "0008,0060": 1, "0020,000e": 1},
    "CTImage": {"0018,0050": 2, "0018,0060": 2, "0020,0032": 1, "0020,0037": 1, "0028,0030": 1},
}
CLASSES = {"1.2.840.10008.5.1.4.1.1.2": ("Common", "CTImage")}
# Modalities whose instances must have pixels.
IMAGE_MODALITIES = ("CT", "MR", "US", "DX", "CR", "MG", "NM", "PT", "XA", "RF", "SC", "OT")


def missing_attributes(sop_class: Column, attributes: Column) -> Column:
    """Array of messages; empty for classes without rules."""
    checks = []
    for sop, modules in CLASSES.items():
        for module in modules:
            for tag, kind in MODULES[module].items():
                value = F.element_at(attributes, F.lit(tag))
                lacks = value.isNull() | (value == "") if kind == 1 else ~F.map_contains_key(attributes, F.lit(tag))
                checks.append(F.when((sop_class == sop) & lacks, F.lit(f"[Type {kind} Error] Missing {tag} in {module}")))
    return F.array_compact(F.array(*checks))


def invalid(instances: DataFrame) -> DataFrame:
    errors = missing_attributes(F.col("sop_class_uid"), F.col("attributes"))
    return instances.select("sop_instance_uid", errors.alias("errors")).filter(F.size("errors") > 0)


def lacks_pixels(modality: Column, pixels: Column) -> Column:
    """Whether an image has no pixels; other kinds of documents need none."""
    return modality.isin(*IMAGE_MODALITIES) & pixels.isNull()
