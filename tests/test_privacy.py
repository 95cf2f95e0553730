import datetime

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import audit, flatten, identity, remediate
from cohortlake.plans.cohort import INSTANCES, PATIENTS, SEQ_ITEMS, SERIES, STUDIES, Cohort
from cohortlake.sources.policy import Configuration, TagPolicy, check_rule, profile


def cohort(spark, name="John Doe", pid="MRN123", shifted=False, attributes=None, items=()):
    return Cohort(
        spark.createDataFrame([(pid, name)], PATIENTS),
        spark.createDataFrame([("st", pid, datetime.date(2023, 1, 1), None, shifted)], STUDIES),
        spark.createDataFrame([("se", "st", "CT", 1, "Manu", "Model", "SN-1")], SERIES),
        spark.createDataFrame([("i1", "se", "1.2", 1, "/f", attributes or {})], INSTANCES),
        spark.createDataFrame(list(items), SEQ_ITEMS),
    )


def fields(df):
    return sorted(r.field_name for r in df.collect())


def test_three_findings_and_none(spark):
    plain = Configuration(remove_private_tags=False)
    assert fields(audit.audit(cohort(spark), plain)) == ["patient_id", "patient_name", "study_date"]
    assert fields(audit.audit(cohort(spark, "Unknown", "UNKNOWN", True), plain)) == []
    assert fields(audit.audit(cohort(spark, "ANONYMIZED", "ANON_1", True), plain)) == []


POLICY = Configuration(phi_tags={
    "0010,0030": TagPolicy("Birth", "REMOVE"), "0008,1030": TagPolicy("Desc", "EMPTY"), "0008,0022": TagPolicy("Acq", "JITTER"),
    "0010,0040": TagPolicy("Sex", "KEEP"), "0008,0080": TagPolicy("Inst"), "0008,0090": TagPolicy("Ref", "REPLACE", "Nobody"), "0040,a160": TagPolicy("Text", "REPLACE"),
})
ATTRS = {"0010,0030": "19700101", "0008,1030": "Chest", "0008,0022": "20230515", "0010,0040": "F", "0008,0080": "Clinic", "0008,0090": "Dr X", "0011,1010": "p", "0099,0010": "own"}
ITEMS = [("i1", "0040,a730[0]", "0040,a160", "UT", "told to Dr X"), ("i1", "0040,a730[1]", "0040,a160", "UT", "and again"), ("i1", "0040,a730[1]", "0008,0104", "LO", "kept")]


def test_every_action_and_closed_loop(spark):
    whole = cohort(spark, attributes=ATTRS, items=ITEMS)
    findings = audit.audit(whole, POLICY)
    assert [f for f in fields(findings) if "Deep" in f] == ["Text (Deep)", "Text (Deep)"]
    done = remediate.remediate(whole, findings, POLICY)
    a = done.instances.first().attributes
    assert "0010,0030" not in a and "0011,1010" not in a and a["0099,0010"] == "own"
    assert (a["0008,1030"], a["0010,0040"], a["0008,0080"], a["0008,0090"]) == ("", "F", "ANONYMIZED", "Nobody")
    assert sorted(r.value for r in done.seq_items.collect()) == ["ANONYMIZED", "ANONYMIZED", "kept"]
    patient, study = done.patients.first(), done.studies.first()
    assert patient.patient_name == "ANONYMIZED" and patient.patient_id.startswith("ANON_") and study.patient_id == patient.patient_id and study.date_shifted
    moved = datetime.datetime.strptime(a["0008,0022"], "%Y%m%d").date() - datetime.date(2023, 5, 15)
    assert study.study_date - datetime.date(2023, 1, 1) == moved and moved.days < 0
    assert audit.audit(done, POLICY).count() == 0


def test_shifted_studies_suppress_date_findings(spark):
    assert "Acq" not in fields(audit.audit(cohort(spark, shifted=True, attributes=ATTRS), POLICY))


def test_repeated_findings_apply_once(spark):
    whole = cohort(spark, attributes=ATTRS)
    once = audit.audit(whole, POLICY)
    twice = remediate.remediate(whole, once.unionByName(once), POLICY)
    assert twice.instances.first() == remediate.remediate(whole, once, POLICY).instances.first()
    assert remediate.log_rows(once.unionByName(once)).count() == once.count()


def test_unreadable_date_stays(spark):
    done = remediate.remediate(c := cohort(spark, attributes={"0008,0022": "spring"}), audit.audit(c, POLICY), POLICY)
    assert done.instances.first().attributes["0008,0022"] == "spring"


def test_profile_and_overrides():
    basic = profile("basic")
    assert len(basic) == 28 and sum(t.action == "EMPTY" for t in basic.values()) == 2
    config = Configuration.from_dict({"privacy_profile": "basic", "phi_tags": {"0010,0010": {"name": "N", "action": "keep"}, "0008,0090": {"action": "EMPTY"}}, "date_jitter": -7})
    assert config.phi_tags["0010,0010"].action == "KEEP" and config.phi_tags["0008,0090"].action == "EMPTY" and len(config.phi_tags) == 28 and config.date_jitter == (-7, -7)
    with pytest.raises(ValueError):
        profile("comprehensive")


@pytest.mark.parametrize("rule", [{}, {"serial_number": "a", "redaction_zones": "x"}, {"serial_number": "a", "redaction_zones": [[1, 2, 3]]}, {"serial_number": "a", "redaction_zones": [[5, 2, 0, 1]]}, {"serial_number": "a", "redaction_zones": ["0,1,2,3"]}, {"serial_number": "a", "redaction_zones": [[-1, 2, 0, 1]]}])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        check_rule(rule)


def test_configuration_edits(tmp_path):
    config = Configuration(path=str(tmp_path / "c.yaml"))
    config.add_rule("S1", "M", "X", [[0, 1, 0, 1]])
    config.add_rule("S1", "M", "X", [{"roi": [0, 2, 0, 2]}])
    config.update_rule("S1", {"model_name": "Y"})
    config.set_phi_tag("0008,103E", "remove")
    again = Configuration.load(config.path)
    assert again.rules == config.rules and again.rule("S1")["model_name"] == "Y" and again.phi_tags["0008,103e"].action == "REMOVE"
    with pytest.raises(ValueError):
        config.update_rule("S2", {})
    with pytest.raises(ValueError):
        config.update_rule("S1", {"serial_number": "S3"})
    assert config.delete_rule("S1") and not config.delete_rule("S1")
    with pytest.raises(ValueError):
        Configuration.load(str(tmp_path / "c.json"))


def test_safe_export_skips_dirty_ancestors(spark):
    whole = cohort(spark)
    assert flatten.safe_export(whole, audit.audit(whole, Configuration())).count() == 0
    clean = cohort(spark, "ANONYMIZED", "ANON_C", True)
    assert flatten.safe_export(clean, audit.audit(clean, Configuration())).count() == 1


def test_lock_anonymize_recover(spark, tmp_path):
    key = identity.load_or_make_key(str(tmp_path / "key"))
    assert identity.load_or_make_key(str(tmp_path / "key")) == key
    whole = cohort(spark, attributes=ATTRS)
    locked = identity.lock(whole, key)
    assert identity.lock(locked, key).instances.first() == locked.instances.first()
    done = remediate.remediate(locked, audit.audit(locked, POLICY), POLICY)
    original = identity.recover(done, key).first().original
    assert original == {"0010,0010": "John Doe", "0010,0020": "MRN123", "0010,0030": "19700101", "0010,0040": "F"}
    back = identity.restore(done, key)
    assert back.patients.first().patient_name == "John Doe" and back.studies.first().patient_id == "MRN123" and back.instances.first().attributes["0010,0030"] == "19700101"
    other = identity.load_or_make_key(str(tmp_path / "other"))
    assert identity.recover(done, other).first().original is None
    plan = locked.instances._jdf.queryExecution().toString()
    assert key not in plan


def test_token_layout_and_tampering(spark, tmp_path):
    import base64

    key = identity.load_or_make_key(str(tmp_path / "key"))
    df = identity.encrypt(spark.createDataFrame([("secret text",), ("",), (None,)], "t string"), "t", key, "token", seconds=5)
    token = df.collect()[0].token
    raw = base64.urlsafe_b64decode(token)
    assert raw[0] == 0x80 and int.from_bytes(raw[1:9], "big") == 5 and len(raw) == 1 + 8 + 16 + 16 + 32
    assert [r.token for r in df.collect()[1:]] == [None, None]
    changed = token[:30] + ("A" if token[30] != "A" else "B") + token[31:]
    rows = spark.createDataFrame([(token,), (changed,), ("junk",), (None,)], "t string")
    assert [r.o for r in identity.decrypt(rows, "t", key, "o").collect()] == ["secret text", None, None, None]


def test_subsets(spark):
    report = flatten.cohort_report(cohort(spark, attributes=ATTRS), ["0010,0040"])
    assert flatten.subset_query(report, "Modality == 'CT' and `0010,0040` in ['F', 'M']").count() == 1
    assert flatten.subset_query(report, "Modality != 'CT'").count() == 0
    assert flatten.subset_ids(report, spark.createDataFrame([("st",)], "id string")).count() == 1
    assert flatten.subset_frame(report, spark.createDataFrame([("x", "st")], "SeriesInstanceUID string, StudyInstanceUID string")).count() == 0
    with pytest.raises(ValueError):
        flatten.subset_frame(report, spark.createDataFrame([(1,)], "a int"))
    assert "F" in [r["0010,0040"] for r in report.select(F.col("`0010,0040`")).collect()]
