"""Remediation: the findings' proposals applied as one projection per level."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import shift_date, shift_days, shift_text, unreadable
from ..functions.tags import BURNED_IN, IMAGE_TYPE, canonical, is_private
from ..plans.cohort import HOME, Cohort
from ..sources.policy import Configuration
from .audit import NAME_REPLACEMENT, PSEUDONYM, audit, own_proposals, owners, pseudonym

DEID_METHOD, DEID_METHOD_CODES = "0012,0063", "0012,0064"
DERIVATION, DERIVATION_CODES = "0008,2111", "0008,9215"
REDACTED = "Pixel redaction: burned-in PHI removed"
# Fixed values of the standard's code tables.
PIXEL_CODE, BASIC_CODE = "113062", "113100"


def first_of_each(findings: DataFrame, keys: tuple[str, ...] = ("entity_uid", "item_path", "tag", "action_type"), order: tuple[str, ...] = ("field_name", "value")) -> DataFrame:
    """One finding per key; the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _edits(findings: DataFrame) -> DataFrame:
    """Per instance: the tags to remove, to replace (a map) and to shift."""
    tags = lambda action: F.collect_set(F.when(F.col("action_type") == action, F.col("target_attr")))
    new = F.map_from_entries(F.collect_list(F.when(F.col("action_type") == "REPLACE_TAG", F.struct("target_attr", "new_value"))))
    direct = first_of_each(findings.filter("entity_type = 'Instance' and item_path is null and action_type is not null"), ("entity_uid", "target_attr"), ("action_type", "field_name", "new_value"))
    return direct.groupBy("entity_uid").agg(tags("REMOVE_TAG").alias("_remove"), new.alias("_replace"), tags("SHIFT_DATE").alias("_shift"), F.first("patient_id").alias("_patient"))


def _own_edits(instances: DataFrame, config: Configuration) -> DataFrame:
    """Placed instances with the same edits, from their own findings, which stay beside them."""
    found = instances.withColumn("_found", F.sort_array(own_proposals(config, F.col("of_shifted"))))
    first = found.withColumn("_found", F.filter("_found", lambda f, i: (i == 0) | (f.target_attr != F.get("_found", i - 1).target_attr)))
    of = lambda action: F.filter("_found", lambda f: f.action_type == action)
    tags = lambda action: F.transform(of(action), lambda f: f.target_attr)
    new = F.map_from_entries(F.transform(of("REPLACE_TAG"), lambda f: F.struct(f.target_attr, f.new_value)))
    return first.withColumns({"_remove": tags("REMOVE_TAG"), "_replace": new, "_shift": tags("SHIFT_DATE"), "_patient": F.col("of_patient")})


def remediate_own(cohort: Cohort, config: Configuration) -> Cohort:
    """A placed cohort with every proposal of its own audit carried out.

    The same as ``remediate`` with all findings, but an instance's findings never leave its row.
    """
    return remediate(cohort, audit(cohort, config, own=False), config, own=True)


def remediate(cohort: Cohort, findings: DataFrame, config: Configuration, own: bool = False) -> Cohort:
    """The cohort with every proposal carried out. Unreadable dates stay as they are.

    With ``own``, placed instances are audited here, and the findings are all others.
    """
    low, high = config.date_jitter
    proposed = findings.filter("action_type is not null")
    of = lambda kind: proposed.filter(F.col("entity_type") == kind)

    changes = of("Patient").groupBy("entity_uid").agg(
        F.max(F.when(F.col("target_attr") == "patient_name", F.col("new_value"))).alias("_name"),
        F.max(F.when(F.col("target_attr") == "patient_id", F.col("new_value"))).alias("_id"),
    )
    new_ids = changes.filter("_id is not null").select("entity_uid", "_id")
    patients = cohort.patients.join(changes, F.col("patient_id") == F.col("entity_uid"), "left").select(F.coalesce("_id", "patient_id").alias("patient_id"), F.coalesce("_name", "patient_name").alias("patient_name"))

    days = shift_days(F.col("patient_id"), low, high)
    shifted = of("Study").filter("action_type = 'SHIFT_DATE'").select(F.col("entity_uid").alias("_study")).distinct()
    dated = cohort.studies.join(shifted, F.col("study_instance_uid") == F.col("_study"), "left")
    moves = F.col("_study").isNotNull() & F.col("study_date").isNotNull()
    dated = dated.withColumn("study_date", F.when(moves, shift_date(F.col("study_date"), days)).otherwise(F.col("study_date"))).withColumn("date_shifted", F.coalesce("date_shifted", F.lit(False)) | moves).drop("_study")
    studies = dated.join(new_ids, F.col("patient_id") == F.col("entity_uid"), "left").withColumn("patient_id", F.coalesce("_id", "patient_id")).select(cohort.studies.columns)

    edits = _own_edits(cohort.instances, config) if own else cohort.instances.join(_edits(proposed), F.col("sop_instance_uid") == F.col("entity_uid"), "left")
    instances = edits.withColumn("attributes", _edited(low, high))
    if cohort.placed:
        now = studies.select(*(F.col(c).alias(h) for c, h in zip(("study_instance_uid", "patient_id", "study_date", "date_shifted"), HOME)))
        instances = instances.drop(*HOME[1:]).join(now, "of_study", "left")
    instances = instances.select(cohort.instances.columns)
    out = replace(cohort, patients=patients, studies=studies, instances=instances)
    return replace(out, seq_items=_nested(cohort.seq_items, proposed, low, high)) if cohort.seq_items is not None else out


def _edited(low: int, high: int) -> Column:
    days = shift_days(F.col("_patient"), low, high)
    kept = F.map_filter("attributes", lambda k, v: ~F.array_contains("_remove", k))
    moved = F.transform_values(
        kept,
        lambda k, v: F.when(F.map_contains_key("_replace", k), F.element_at("_replace", k)).when(F.array_contains("_shift", k), F.coalesce(shift_text(v, days), v)).otherwise(v),
    )
    return F.when(F.col("_remove").isNull(), F.col("attributes")).otherwise(moved)


def _nested(items: DataFrame, proposed: DataFrame, low: int, high: int) -> DataFrame:
    deep = first_of_each(proposed.filter("item_path is not null"), ("entity_uid", "item_path", "target_attr"), ("action_type", "field_name", "new_value")).select(F.col("entity_uid").alias("_uid"), F.col("item_path").alias("_path"), F.col("target_attr").alias("_tag"), F.col("action_type").alias("_do"), F.col("new_value").alias("_new"), F.col("patient_id").alias("_patient"))
    met = items.join(deep, (items.sop_instance_uid == deep._uid) & (items.item_path == deep._path) & (items.tag == deep._tag), "left")
    value = F.when(F.col("_do") == "REPLACE_TAG", F.col("_new")).when(F.col("_do") == "SHIFT_DATE", F.coalesce(shift_text(F.col("value"), shift_days(F.col("_patient"), low, high)), "value")).otherwise(F.col("value"))
    return met.filter("_do is null or _do <> 'REMOVE_TAG'").withColumn("value", value).select(items.columns)


def apply_policy(cohort: Cohort, config: Configuration) -> Cohort:
    """The cohort as remediating all findings of its audit leaves it, without listing a finding.

    Names, ids, dates and attributes change where they stand; the policy is part of the plan. Only
    if it shifts dates do instances meet their series' patient, in one join.
    """
    low, high = config.date_jitter
    pid, name = F.col("patient_id"), F.col("patient_name")
    renamed = lambda x: F.when((x != "") & (x != "UNKNOWN") & ~x.startswith(PSEUDONYM), pseudonym(x)).otherwise(x)
    new_id = renamed(pid)
    new_name = F.when((name != "") & ~name.isin("Unknown", NAME_REPLACEMENT), NAME_REPLACEMENT).otherwise(name)
    was = F.coalesce("date_shifted", F.lit(False))
    moved = F.when(F.col("study_date").isNotNull() & ~was, shift_date(F.col("study_date"), shift_days(pid, low, high))).otherwise(F.col("study_date"))
    patients = cohort.patients.select(new_id.alias("patient_id"), new_name.alias("patient_name"))
    studies = cohort.studies.withColumns({"study_date": moved, "date_shifted": was | F.col("study_date").isNotNull(), "patient_id": new_id}).select(cohort.studies.columns)

    of = lambda *actions: [t for t, p in config.phi_tags.items() if p.action in actions]
    inside = lambda k, tags: canonical(k).isin(tags) if tags else F.lit(False)
    removed = lambda k: inside(k, of("REMOVE")) | (is_private(k) if config.remove_private_tags else F.lit(False))
    by_text: dict[str, list[str]] = {}
    for tag in of("REPLACE"):
        given = config.phi_tags[tag].replacement
        by_text.setdefault(NAME_REPLACEMENT if given is None else given, []).append(tag)

    def new_value(k: Column, v: Column) -> Column:
        out = F.when(v.isNull() | (v == "") | ~inside(k, of("EMPTY", "REPLACE", "SHIFT", "JITTER")), v).when(inside(k, of("EMPTY")), "")
        for text, tags in by_text.items():
            out = out.when(inside(k, tags), text)
        if of("SHIFT", "JITTER"):
            out = out.when(inside(k, of("SHIFT", "JITTER")) & F.col("_days").isNotNull(), F.coalesce(shift_text(v, F.col("_days")), v))
        return out.otherwise(v)

    instances, items = cohort.instances, cohort.seq_items
    if of("SHIFT", "JITTER"):
        if cohort.placed:
            instances = instances.withColumn("_days", F.when(~F.col("of_shifted"), shift_days(F.col("of_patient"), low, high)))
        else:
            days = owners(cohort).filter("not date_shifted").select("series_instance_uid", shift_days(pid, low, high).alias("_days"))
            instances = instances.join(days, "series_instance_uid", "left")
        items = items.join(instances.select("sop_instance_uid", "_days"), "sop_instance_uid", "left") if items is not None else None
    kept = F.map_filter("attributes", lambda k, v: ~removed(k))
    instances = instances.withColumn("attributes", F.transform_values(kept, new_value))
    if cohort.placed:
        instances = instances.withColumns({"of_date": F.when(F.col("of_shifted"), F.col("of_date")).otherwise(shift_date(F.col("of_date"), shift_days(F.col("of_patient"), low, high))), "of_shifted": F.col("of_shifted") | F.col("of_date").isNotNull(), "of_patient": renamed(F.col("of_patient"))})
    instances = instances.select(cohort.instances.columns)
    out = replace(cohort, patients=patients, studies=studies, instances=instances)
    if items is None:
        return out
    left = items.filter(~(inside(F.col("tag"), of("REMOVE")) & F.col("value").isNotNull()))
    return replace(out, seq_items=left.withColumn("value", new_value(F.col("tag"), F.col("value"))).select(cohort.seq_items.columns))


def log_rows(findings: DataFrame) -> DataFrame:
    """Audit-log rows of the proposals; no values of patients in them.

    A date that no shift can move stays, and is a warning instead of a remediation.
    """
    kinds = F.create_map(*(F.lit(x) for pair in (("REPLACE_TAG", "REMEDIATION_REPLACE"), ("REMOVE_TAG", "REMEDIATION_REMOVE"), ("SHIFT_DATE", "REMEDIATION_SHIFT_DATE")) for x in pair))
    stays = (F.col("action_type") == "SHIFT_DATE") & (F.col("entity_type") == "Instance") & unreadable(F.col("value"))
    return first_of_each(findings.filter("action_type is not null")).select(
        F.when(stays, "WARNING").otherwise(kinds[F.col("action_type")]).alias("action_type"), "entity_uid", F.concat_ws(" ", F.when(stays, "date not shifted:"), F.lit("tag"), "target_attr").alias("details")
    )


def stamp_deidentified(attributes: Column, method: str) -> Column:
    """The method is appended once; the code marks the attribute map as basic-profile."""
    had = F.coalesce(attributes[DEID_METHOD], F.lit(""))
    methods = F.array_union(F.filter(F.split(had, r"\\"), lambda x: x != ""), F.array(F.lit(method)))
    return F.map_concat(F.map_filter(attributes, lambda k, v: ~k.isin(DEID_METHOD, DEID_METHOD_CODES)), F.create_map(F.lit(DEID_METHOD), F.array_join(methods, "\\"), F.lit(DEID_METHOD_CODES), F.lit(BASIC_CODE)))


def stamp_redacted(attributes: Column) -> Column:
    """ImageType begins with DERIVED and never says ORIGINAL; the burned-in flag is NO."""
    rest = F.filter(F.split(F.coalesce(attributes[IMAGE_TYPE], F.lit("")), r"\\"), lambda x: ~x.isin("", "ORIGINAL", "DERIVED"))
    kind = F.concat(F.array(F.lit("DERIVED")), F.when(F.size(rest) == 0, F.array(F.lit("SECONDARY"))).otherwise(rest))
    fixed = {IMAGE_TYPE: F.array_join(kind, "\\"), BURNED_IN: F.lit("NO"), DERIVATION: F.lit(REDACTED), DERIVATION_CODES: F.lit(PIXEL_CODE)}
    return F.map_concat(F.map_filter(attributes, lambda k, v: ~k.isin(*fixed)), F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), v))))


def new_uid(uid: Column, reason: str = "redacted") -> Column:
    """A uid under 2.25 derived from the old one, so that reruns agree."""
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(reason + ":"), uid).cast("binary"), 256), 1, 15), 16, 10)
    return F.concat(F.lit("2.25."), digits)
