"""The privacy audit: one plan that unions the rules for each level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import unreadable
from ..functions.tags import canonical, is_private
from ..plans.cohort import Cohort
from ..sources.policy import Configuration

COLUMNS = ("entity_uid", "entity_type", "field_name", "value", "reason", "tag", "patient_id", "action_type", "target_attr", "new_value", "item_path")
NAME_REPLACEMENT = "ANONYMIZED"
PSEUDONYM = "ANON_"


def pseudonym(patient_id: Column) -> Column:
    return F.concat(F.lit(PSEUDONYM), F.substring(F.sha2(patient_id.cast("binary"), 256), 1, 12))


def _finding(**columns: Column | str | None) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [as_column(columns.get(c)).cast("string").alias(c) for c in COLUMNS]


def patient_names(patients: DataFrame) -> DataFrame:
    name = F.col("patient_name")
    return patients.filter((name != "") & ~name.isin("Unknown", NAME_REPLACEMENT)).select(
        *_finding(entity_uid=F.col("patient_id"), entity_type="Patient", field_name="patient_name", value=name, reason="Names are PHI", tag="0010,0010", patient_id=F.col("patient_id"), action_type="REPLACE_TAG", target_attr="patient_name", new_value=NAME_REPLACEMENT)
    )


def patient_ids(patients: DataFrame) -> DataFrame:
    pid = F.col("patient_id")
    return patients.filter((pid != "") & (pid != "UNKNOWN") & ~pid.startswith(PSEUDONYM)).select(
        *_finding(entity_uid=pid, entity_type="Patient", field_name="patient_id", value=pid, reason="Medical Record Numbers are PHI", tag="0010,0020", patient_id=pid, action_type="REPLACE_TAG", target_attr="patient_id", new_value=pseudonym(pid))
    )


def study_dates(studies: DataFrame) -> DataFrame:
    return studies.filter(F.col("study_date").isNotNull() & ~F.coalesce("date_shifted", F.lit(False))).select(
        *_finding(entity_uid=F.col("study_instance_uid"), entity_type="Study", field_name="study_date", value=F.col("study_date"), reason="Dates are Safe Harbor restricted", tag="0008,0020", patient_id=F.col("patient_id"), action_type="SHIFT_DATE", target_attr="study_date")
    )


def owners(cohort: Cohort) -> DataFrame:
    """Series to patient and whether the study's dates are shifted: no instance columns."""
    return cohort.series.select("series_instance_uid", "study_instance_uid").join(cohort.studies.select("study_instance_uid", "patient_id", F.coalesce("date_shifted", F.lit(False)).alias("date_shifted")), "study_instance_uid")


def _entries(config: Configuration) -> Column:
    """An attribute map pruned to its private tags and the policy's: a struct for each finding it may give."""
    policy = config.phi_tags
    private = (lambda k: is_private(k)) if config.remove_private_tags else lambda k: F.lit(False)

    def of_entry(e: Column) -> Column:
        # a private tag is one finding, and one more if the policy names it too
        found = lambda kind: F.struct(e.key.alias("own_tag"), e.value.alias("value"), F.lit(kind).alias("kind"), _actions(config)[F.lower(e.key)].alias("action"))
        listed = e.value.isNotNull() & F.lower(e.key).isin(list(policy)) if policy else F.lit(False)
        return F.filter(F.array(F.when(private(e.key), found("private")), F.when(listed, found("policy"))), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.map_entries("attributes"), of_entry))


def _texts(config: Configuration, f: Callable) -> Column:
    policy = config.phi_tags
    return F.create_map(*(F.lit(x) for t, p in policy.items() for x in (t, f(p))), *([] if policy else [F.lit(""), F.lit(None).cast("string")]))


def _actions(config: Configuration) -> Column:
    return _texts(config, lambda p: p.action)


def _proposal(config: Configuration, own_tag: Column, value: Column, kind: Column, action: Column, shifted: Column, path: Column) -> dict[str, Column]:
    """What a finding says of an element, and its action: null if it isn't one. The policy is a small map in the plan."""
    tag, of_policy = F.lower(own_tag), kind == "policy"
    name, replacement = (_texts(config, f)[tag] for f in (lambda p: p.name, lambda p: p.replacement if p.replacement is not None else NAME_REPLACEMENT))
    needed = (
        F.when(~of_policy, F.lit("REMOVE_TAG"))
        .when(action == "REMOVE", F.lit("REMOVE_TAG"))
        .when((action == "EMPTY") & (value != ""), F.lit("REPLACE_TAG"))
        .when(action.isin("SHIFT", "JITTER") & (~shifted | unreadable(value)), F.lit("SHIFT_DATE"))
        .when((action == "REPLACE") & (value != "") & (value != replacement), F.lit("REPLACE_TAG"))
    )
    new = F.when(of_policy & (action == "EMPTY"), "").when(of_policy & (action == "REPLACE"), replacement)
    deep = F.when(path.isNotNull(), F.concat(name, F.lit(" (Deep)"))).otherwise(name)
    either = lambda a, b: F.when(of_policy, a).otherwise(b)
    # The reasons as they are reported.
    reason = either(F.concat(F.lit("Matched PHI Tag "), tag, F.lit(" ("), name, F.lit(")")), F.lit("Private Tag Removal Requested"))
    return {"field_name": either(deep, F.concat(F.lit("Private Tag "), own_tag)), "value": either(value, F.lit("<PRIVATE>")), "reason": reason, "tag": either(tag, own_tag), "action_type": needed, "target_attr": own_tag, "new_value": new, "item_path": path}


def own_proposals(config: Configuration, shifted: Column) -> Column:
    """The findings of an instance's attributes as an array beside them: what remediation needs of each."""

    def one(e: Column) -> Column:
        found = _proposal(config, e.own_tag, e.value, e.kind, e.action, shifted, F.lit(None).cast("string"))
        return F.struct(*(found[c].cast("string").alias(c) for c in ("target_attr", "action_type", "field_name", "new_value")))

    return F.filter(F.transform(_entries(config), one), lambda f: f.action_type.isNotNull())


def nested_rows(cohort: Cohort, config: Configuration, home: list) -> DataFrame:
    """Nested elements that the policy names, with the ``home`` columns of their instance."""
    nested = cohort.seq_items.filter(canonical("tag").isin(list(config.phi_tags)) & F.col("value").isNotNull())
    return nested.join(cohort.instances.select("sop_instance_uid", *home), "sop_instance_uid").withColumnRenamed("tag", "own_tag").withColumns({"kind": F.lit("policy"), "action": _actions(config)[F.lower("own_tag")]})


def attribute_findings(cohort: Cohort, config: Configuration, own: bool = True) -> DataFrame:
    """Findings of private attributes and of the tag policy, on attributes (if ``own``) and nested elements.

    Each attribute map is pruned to its private tags and the policy's, exploded once and joined once
    with its series' patient, unless instances are placed. The policy is a small configuration that
    stands in the plan as a map.
    """
    home = [F.col("of_patient").alias("patient_id"), F.col("of_shifted").alias("date_shifted")] if cohort.placed else [F.col("series_instance_uid")]
    rows = cohort.instances.filter(F.lit(own)).select("sop_instance_uid", *home, F.explode(_entries(config)).alias("e")).select("*", "e.*", F.lit(None).cast("string").alias("item_path")).drop("e")
    if cohort.seq_items is not None and config.phi_tags:
        rows = rows.unionByName(nested_rows(cohort, config, home).select(rows.columns))
    met = rows if cohort.placed else rows.join(owners(cohort), "series_instance_uid")
    found = _proposal(config, *(F.col(c) for c in ("own_tag", "value", "kind", "action", "date_shifted", "item_path")))
    return met.select(*_finding(entity_uid=F.col("sop_instance_uid"), entity_type="Instance", patient_id=F.col("patient_id"), **found)).filter("action_type is not null")


def audit(cohort: Cohort, config: Configuration, own: bool = True) -> DataFrame:
    """All findings, or all but those of instances' ``own`` attributes.

    An empty policy still audits names, ids, study dates and private tags.
    """
    parts = [patient_names(cohort.patients), patient_ids(cohort.patients), study_dates(cohort.studies)]
    if (own and config.remove_private_tags) or (config.phi_tags and (own or cohort.seq_items is not None)):
        parts.append(attribute_findings(cohort, config, own))
    return reduce(DataFrame.unionByName, parts)


def safety_feedback(findings: DataFrame) -> DataFrame:
    """Per tag: count, smallest value by entity as an example (30 characters), reason (28)."""
    by = F.struct("entity_uid", "field_name")
    return findings.groupBy(F.coalesce("tag", "field_name").alias("tag")).agg(
        F.count("*").alias("n"),
        F.substring(F.min_by("value", by), 1, 30).alias("example"),
        F.substring(F.max_by("reason", by), 1, 28).alias("reason"),
    )
