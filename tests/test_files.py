import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import report, zones
from cohortlake.operators.catalog import Catalog, from_eav, to_eav, upsert
from cohortlake.session import Session
from cohortlake.sources import dicom
from cohortlake.sources.ctp import parse_script
from cohortlake.sources.policy import Configuration
from cohortlake.streaming import ingest, windows

BASE = {"0008,0016": "1.2.840.10008.5.1.4.1.1.2", "0010,0020": "P1", "0010,0010": "Doe^Jane", "0020,000d": "1.2.3", "0020,000e": "1.2.3.4", "0008,0020": "20230101", "0008,0060": "CT", "0008,0070": "Maker", "0008,1090": "Model", "0018,1000": "SN-1", "0028,0010": "10", "0028,0011": "10", "0028,0100": "8", "0028,0002": "1"}


def file(uid, pixels=b"\xff" * 100, items=(), **more):
    return dicom.write(BASE | {"0008,0018": uid} | more, list(items), pixels, 8)


def test_write_and_parse_round_trip():
    items = [{"item_path": "0040,a730[0]", "tag": "0040,a160", "vr": "UT", "value": "Täxt"}, {"item_path": "0040,a730[1].0008,1140[0]", "tag": "0008,0104", "vr": "LO", "value": "deep"}, {"item_path": "0040,a730[1]", "tag": "0010,0010", "vr": "PN", "value": "A^B"}]
    got = dicom.parse(file("1.9", items=items))
    assert got["patient_id"] == "P1" and got["pixels"] == b"\xff" * 100 and got["rows"] == 10 and got["series_number"] == "0"
    assert sorted(map(str, got["items"])) == sorted(map(str, items))
    assert dict(got["attributes"])["0028,0010"] == "10"


def test_implicit_undefined_lengths_and_missing_uid():
    element = lambda g, e, raw: struct.pack("<HHI", g, e, len(raw)) + raw
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x40, 0xA160, b"note") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    data = element(8, 0x18, b"1.5\0") + element(0x10, 0x20, b"P9") + struct.pack("<HHI", 0x40, 0xA730, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + element(0x20, 0x13, b"7 ")
    got = dicom.parse(data)
    assert (got["sop_instance_uid"], got["patient_id"], got["instance_number"], got["modality"]) == ("1.5", "P9", "7", "OT")
    assert got["items"] == [{"item_path": "0040,a730[0]", "tag": "0040,a160", "vr": "UT", "value": "note"}]
    with pytest.raises(ValueError, match="SOPInstanceUID"):
        dicom.parse(element(0x10, 0x20, b"P9"))


def test_rle_frames():
    plane = bytes([5] * 60 + list(range(40)))
    runs = bytes([257 - 60, 5, 39, *range(40)])
    fragment = struct.pack("<16I", 1, 64, *[0] * 14) + runs
    assert dicom.unpack_rle(fragment, 100, 1, 1) == plane
    high, low = bytes([257 - 4, 1]), bytes([3, 1, 2, 3, 4])
    wide = struct.pack("<16I", 2, 64, 66, *[0] * 13) + high + low
    assert np.frombuffer(dicom.unpack_rle(wide, 4, 1, 2), "<u2").tolist() == [257, 258, 259, 260]


def test_planar_pixels_are_interleaved():
    planar = bytes([1] * 4 + [2] * 4 + [3] * 4)
    got = dicom.parse(file("1", planar, **{"0028,0010": "2", "0028,0011": "2", "0028,0002": "3", "0028,0006": "1"}))
    assert got["pixels"] == bytes([1, 2, 3] * 4)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.dcm").write_bytes(file("1.1", **{"0028,0301": "YES"}))
    (tmp_path / "in" / "sub" / "b").write_bytes(file("1.2", **{"0011,1010": "private"}, items=[{"item_path": "0040,a730[0]", "tag": "0010,0010", "vr": "PN", "value": "Doe^Jane"}, {"item_path": "0040,a730[0]", "tag": "0008,0104", "vr": "LO", "value": "kept"}]))
    (tmp_path / "in" / "c.dcm").write_bytes(file("1.3", **{"0008,0060": "MR", "0020,000e": "1.2.3.5", "0018,1000": "SN-2", "0010,0020": "P2", "0020,000d": "1.2.9"}))
    (tmp_path / "in" / "bad.dcm").write_bytes(b"no image")
    (tmp_path / "in" / ".hidden").write_bytes(file("1.4"))
    return tmp_path


def test_end_to_end(spark, folder):
    config = Configuration.from_dict({"privacy_profile": "basic", "machines": [{"serial_number": "SN-1", "redaction_zones": [[0, 5, 0, 5], [8, 10, 8, 10]]}]})
    s = Session(spark, str(folder / "lake"), config)
    bad = s.ingest(str(folder / "in")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.dcm"]
    assert {r.level: r.n for r in s.examine().collect()} == {"patients": 2, "studies": 2, "series": 2, "instances": 3}
    s.ingest(str(folder / "in"))
    assert {r.level: r.n for r in s.examine().collect()}["instances"] == 3
    assert {r.serial_number: r.n_images for r in s.preview_config().collect()} == {"SN-1": 2}
    s.enable_reversible_anonymization(str(folder / "key"))
    s.lock_identities()
    names = lambda: s.audit().filter("item_path is not null").count()
    assert names() == 1 and s.redact().count() == 2 and s.redact().count() == 0
    assert names() == 1 and s.cohort.seq_items.join(s.cohort.instances, "sop_instance_uid", "left_semi").count() == 2
    assert {r.action_type: r.n for r in s.anonymize().collect()}.keys() >= {"REMEDIATION_REPLACE", "REMEDIATION_REMOVE", "REMEDIATION_SHIFT_DATE"}
    assert s.audit().count() == 0
    out = s.export(str(folder / "out"), safe=True, subset="Modality == 'CT'").collect()
    assert len(out) == 2 and all(r.error is None for r in out)
    assert sorted(len(dicom.parse(open(r.path, "rb").read())["items"]) for r in out) == [4, 5]  # two codes of two elements, and what was kept
    assert all(dict(dicom.parse(open(r.path, "rb").read())["attributes"])["0012,0063"] == "cohortlake privacy profile" for r in out)
    for r in out:
        assert "/Subject_ANON_" in r.path and "/Study_20" in r.path
        got = dicom.parse(open(r.path, "rb").read())
        pixels = np.frombuffer(got["pixels"], np.uint8).reshape(10, 10)
        assert (pixels[:5, :5] == 0).all() and (pixels[8:, 8:] == 0).all() and pixels[9, 0] == 255
        assert got["patient_name"] == "ANONYMIZED" and b"Doe" not in open(r.path, "rb").read() and "0011,1010" not in dict(got["attributes"])
        assert dict(got["attributes"])["0008,0008"].startswith("DERIVED")
    pid = s.cohort.studies.filter("study_instance_uid = '1.2.3'").first().patient_id
    assert s.recover_patient_identity(pid, restore=True)["0010,0020"] == "P1"
    assert "P1" in [r.patient_id for r in s.cohort.patients.collect()]
    refused = s.export(str(folder / "checked"), check=True).collect()
    assert all("Type 1 Error" in r.error for r in refused)
    assert s.generate_manifest(str(folder / "m.json"), "json") == 3
    with pytest.raises(ValueError):
        s.generate_manifest(str(folder / "m.xml"), "xml")
    s.generate_report(str(folder / "r.md"))
    text = (folder / "r.md").read_text()
    assert "**Status: PASS**" in text and "REDACTION" in text and "Doe" not in text
    s.compact()
    assert s.frames.count() == 3 and zones.risk_rows(s.cohort.instances).count() == 0


def test_a_second_file_of_an_instance_brings_nothing(spark, folder):
    s = Session(spark, str(folder / "lake"))
    (folder / "in" / "b2.dcm").write_bytes((folder / "in" / "sub" / "b").read_bytes())
    s.ingest(str(folder / "in"))
    sizes = lambda: (s.cohort.instances.count(), s.frames.count(), s.cohort.seq_items.count(), s.cohort.patients.count())
    assert sizes() == (3, 3, 2, 2)
    assert s.cohort.instances.filter("sop_instance_uid = '1.2'").first().file_path.endswith("b2.dcm")
    before = set(s.catalog._listed("frames")["files"])
    (folder / "in" / "again.dcm").write_bytes(file("1.1", pixels=b"\1" * 100, items=[{"item_path": "0040,a730[0]", "tag": "0010,0010", "vr": "PN", "value": "X^Y"}]))
    (folder / "in" / "new.dcm").write_bytes(file("1.7"))
    s.ingest(str(folder / "in"))
    assert sizes() == (4, 4, 2, 2) and before < set(s.catalog._listed("frames")["files"])  # nothing is written anew


def test_export_guards(spark, folder):
    config = Configuration.from_dict({"machines": [{"serial_number": "SN-1", "redaction_zones": [[0, 5, 0, 5]]}]})
    s = Session(spark, str(folder / "lake"), config)
    (folder / "in" / "bare.dcm").write_bytes(file("1.8", pixels=None))
    (folder / "in" / "sr.dcm").write_bytes(file("1.9", pixels=None, **{"0008,0060": "SR", "0020,000e": "1.2.3.6"}))
    s.ingest(str(folder / "in"))
    s.catalog.update("frames", spark.createDataFrame([("1.3",)], "sop_instance_uid string"), lambda df: df.withColumn("pixel_hash", F.when(F.col("sop_instance_uid") == "1.3", "other").otherwise(F.col("pixel_hash"))))
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.path) for r in s.export(str(folder / "out"), compress=True).collect()}
    assert {k: e for k, (e, _) in got.items()} == {"1.1.dcm": None, "1.2.dcm": None, "1.3.dcm": "pixels are not those that were stored", "1.8.dcm": "Pixels missing for Image Modality CT", "1.9.dcm": None}
    pixels = np.frombuffer(dicom.parse(open(got["1.1.dcm"][1], "rb").read())["pixels"], np.uint8).reshape(10, 10)
    assert (pixels[:5, :5] == 0).all() and pixels[9, 9] == 255  # zones are filled in what is written
    assert dicom.RLE.encode() in open(got["1.1.dcm"][1], "rb").read() and s.log.filter("action_type = 'ERROR'").count() == 2
    with pytest.raises(RuntimeError, match="2 of 5"):
        s.export(str(folder / "strict"), fail_on_error=True)


def test_findings_are_saved_and_carried_out(spark, folder):
    s = Session(spark, str(folder / "lake"))
    s.ingest(str(folder / "in"))
    s.save_analysis(s.audit().filter("field_name = 'patient_name'"))
    s.save_analysis(s.audit())
    assert s.load_findings().count() == s.audit().count() + 2 and s.load_findings(latest=True).count() == s.audit().count()
    s.anonymize(s.load_findings(latest=True))
    assert s.audit().count() == 0 and {r.patient_name for r in s.cohort.patients.collect()} == {"ANONYMIZED"}


def test_session_outputs(spark, folder):
    s = Session(spark, str(folder / "lake"))
    s.ingest(str(folder / "in"))
    s.export_dataframe(str(folder / "meta.parquet"), expand_metadata=True)
    meta = spark.read.parquet(str(folder / "meta.parquet"))
    assert meta.count() == 3 and "0028,0301" in meta.columns
    s.export_dataframe(str(folder / "meta.csv"))
    assert spark.read.option("header", True).csv(str(folder / "meta.csv")).count() == 3
    s.export_to_parquet(str(folder / "flat"), ["P2"])
    assert [r.sop_instance_uid for r in spark.read.parquet(str(folder / "flat")).collect()] == ["1.3"]
    assert [r.value for r in s.text_index().orderBy("value").collect()] == ["Doe^Jane", "kept"]
    s.redact_by_machine("SN-2", [0, 2, 0, 2])
    assert s.frames.filter("config_hash is not null").count() == 1
    text = s.create_config(str(folder / "made.yaml"), ['{ Manufacturer.contains("Make") * ManufacturerModelName.contains("Mod") } (0,0,4,2)'], [{"serial_number": "SN-2", "redaction_zones": [[0, 1, 0, 1]]}])
    made = Configuration.load(str(folder / "made.yaml"))
    assert made.rule("SN-1")["redaction_zones"] == [[0, 2, 0, 4]] and made.rule("SN-2")["redaction_zones"] == [[0, 1, 0, 1]] and "WARNING" in text


def test_verification_and_discovery_drivers(spark, folder):
    config = Configuration.from_dict({"machines": [{"serial_number": "SN-1", "redaction_zones": [[0, 50, 0, 50]]}]}, str(folder / "c.yaml"))
    s = Session(spark, str(folder / "lake"), config)
    s.ingest(str(folder / "in"))
    regions = spark.createDataFrame([("SN-1", "1.1", "leaked text", 95.0, 25, 25, 100, 100), ("SN-1", "1.2", "inside", 95.0, 1, 1, 10, 10), ("SN-9", "1.9", "no rule", 95.0, 0, 0, 9, 9)], "serial_number string, sop_instance_uid string, text string, confidence double, x int, y int, w int, h int")
    leaks = s.scan_pixel_content(regions)
    assert [r.text for r in leaks.collect()] == ["leaked text"] and s.scan_pixel_content(regions, "SN-2").count() == 0
    assert s.auto_remediate_config(leaks) == 1 and Configuration.load(config.path).rule("SN-1")["redaction_zones"] == [[0.0, 125.0, 0.0, 125.0]]
    seen = regions.drop("serial_number")
    (zone,) = s.discover_redaction_zones(seen.filter("text = 'leaked text'"), "SN-1").collect()
    assert (zone.r1, zone.r2, zone.c1, zone.c2, zone.occurrence, zone.type) == (25, 125, 25, 125, 0.5, "TEXT")
    assert s.discover_redaction_zones(seen, "SN-9").count() == 0


def test_builder_and_deflated_files(spark):
    import zlib

    from cohortlake.operators import flatten
    from cohortlake.sources.builder import CohortBuilder

    made = CohortBuilder().patient("P", "A^B").study("1", None).series("1.1", "CT", 1, "M", "X", "S").instance("1.1.1", number=1).attribute("0010,0040", "F").item("0040,a730[0]", "0010,0010", "PN", "A^B").instance("1.1.2").patient("Q", "C^D").build(spark)
    assert flatten.flatten(made).count() == 2 and made.seq_items.first().sop_instance_uid == "1.1.1" and made.patients.count() == 2
    with pytest.raises(ValueError):
        CohortBuilder().study("1", None)
    plain = file("1.5")
    meta = plain[: plain.index(struct.pack("<HH", 8, 0x16))].replace(b"1.2.840.10008.1.2.1\0", b"1.2.840.10008.1.2.1.99")
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = packer.compress(plain[plain.index(struct.pack("<HH", 8, 0x16)) :]) + packer.flush()
    meta = meta.replace(struct.pack("<HH2sH", 2, 0x10, b"UI", 20), struct.pack("<HH2sH", 2, 0x10, b"UI", 22))
    assert dicom.parse(meta + body)["pixels"] == b"\xff" * 100


def test_rle_round_trip():
    r = np.random.default_rng(0)
    for shape, wide in (((9, 7, 1), 1), ((16, 16, 3), 1), ((20, 300, 1), 2)):
        pixels = np.repeat(r.integers(0, 5, (shape[0], shape[1], shape[2] * wide)), 1, axis=1).astype(np.uint8)
        pixels[:, : shape[1] // 2] = 7
        packed = dicom.pack_rle(pixels.tobytes(), shape[0] * shape[1], shape[2], wide)
        assert dicom.unpack_rle(packed, shape[0] * shape[1], shape[2], wide) == pixels.tobytes()


def test_report_lists_all_exceptions(spark, folder):
    s = Session(spark, str(folder / "lake"))
    s.ingest(str(folder / "in"))
    made = F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 2 == 0, "ERROR").otherwise("WARNING").alias("action_type"), F.concat(F.lit("uid-"), "id").alias("entity_uid"), F.lit("").alias("details")
    s.catalog.append("log", spark.range(250).select(*made))
    want = [f"{r.ts} {r.action_type} {r.entity_uid or ''}" for r in s.log.filter("action_type in ('ERROR', 'WARNING')").orderBy("ts", "entity_uid").collect()]
    s.generate_report(str(folder / "r.md"))
    text = (folder / "r.md").read_text()
    got = [x[2:] for x in text.split("## 3. Exceptions")[1].split("## 4.")[0].splitlines() if x.startswith("- ")]
    assert len(got) >= 250 and got == want and f"{len(got)} in all" in text
    assert report.compliance_report(s.cohort, s.log) == text


def test_ctp_scripts():
    script = '// comment\n{ Manufacturer.containsIgnoreCase("GE") * ManufacturerModelName.equals("LightSpeed") }\n  (0,0,100,100) (10,20,30,40)\n{ Modality.equals("US") } (1,1,2,2)\n{ Manufacturer.contains("X") }\n'
    (rule,) = parse_script(script)
    assert rule["manufacturer"] == "GE" and rule["model_name"] == "LightSpeed" and rule["redaction_zones"] == [[0, 100, 0, 100], [20, 60, 10, 40]]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lake"))
    assert not c.exists("t")
    assert c.write("t", spark.range(3)) == 1 and c.write("t", c.read("t").filter("id > 0")) == 2
    assert c.read("t").count() == 2 and c.read("t", 1).count() == 3
    assert c.vacuum("t") == [1] and c.versions("t") == [2]
    c.append("log", spark.range(1))
    c.append("log", spark.range(1))
    assert c.read("log").count() == 2
    with pytest.raises(FileNotFoundError):
        c.read("none")


def test_eav_and_upsert(spark):
    df = spark.createDataFrame([("i", {"0011,1001": "x", "0011,1002": "a\\b", "0010,0010": "n"})], "sop_instance_uid string, attributes map<string,string>")
    atoms = to_eav(df)
    assert atoms.count() == 3
    assert from_eav(atoms).first().attributes == {"0011,1001": "x", "0011,1002": "a\\b"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"), spark.createDataFrame([(2, None), (4, "d")], "id int, v string")
    got = upsert(old, new, ["id"], spark.createDataFrame([(3,), (4,)], "id int")).collect()
    assert {(r.id, r.v, r.change) for r in got} == {(1, "a", "kept"), (2, None, "updated"), (4, "d", "inserted")}


def test_scaffold(spark, folder):
    import yaml

    s = Session(spark, str(folder / "lake"))
    s.ingest(str(folder / "in"))
    serial = spark.createDataFrame([(0, "SN-2", "", "")], "rule_pos int, serial_number string, manufacturer string, model_name string")
    named = spark.createDataFrame([(0, "make", "mod")], "rule_pos int, manufacturer string, model_name string")
    text = report.scaffold(s.cohort, s.configuration, serial, named, {(1, 0): [[0, 1, 0, 1]], (2, 0): [[0, 2, 0, 2]]})
    data = yaml.safe_load(text)
    assert {m["serial_number"]: m["redaction_zones"] for m in data["machines"]} == {"SN-1": [[0, 2, 0, 2]], "SN-2": [[0, 1, 0, 1]]}
    assert "WARNING: 1 images" in text and data["phi_tags"]["0010,0040"]["action"] == "KEEP"
    Configuration.from_dict(data)


def test_streams(spark, folder, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:10:00", "ERROR"), ("2024-01-01 00:50:00", "ERROR"), ("2024-01-01 01:10:00", "EXPORT")], "ts string, action_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.action_type, r.n) for r in windows.audit_counts(log).collect()) == [("ERROR", 2), ("EXPORT", 1)]
    s = Session(spark, str(tmp_path / "stream"))
    query = ingest.ingest_stream(s, str(folder / "in"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.level: r.n for r in s.examine().collect()}["instances"] == 3 and s.frames.count() == 3 and s.cohort.seq_items.count() == 2
