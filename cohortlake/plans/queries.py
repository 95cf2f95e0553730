"""Registered queries over the driver's tables, and the same in DuckDB's SQL.

The tables carry the cohort model through ``plans.cohort``; each query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, naming
from ..functions.tags import is_private
from ..operators import audit, catalog, discover, flatten, identity, inventory, remediate, report, validate, zones
from ..sources import dicom
from ..sources.policy import Configuration, TagPolicy
from ..streaming import windows
from . import cohort as model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The cohort as common table expressions.
COHORT_SQL = r"""
machines AS (SELECT s_suppkey, n_name AS manufacturer, r_name AS model_name, s_name AS device_serial_number FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
patients AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS patient_name FROM customer),
studies AS (SELECT CAST(o_orderkey AS VARCHAR) AS study_instance_uid, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderdate AS DATE) AS study_date FROM orders),
series AS (SELECT l_orderkey || '.' || l_suppkey AS series_instance_uid, CAST(l_orderkey AS VARCHAR) AS study_instance_uid, modality, l_suppkey AS series_number, manufacturer, model_name, device_serial_number
    FROM (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS modality FROM lineitem GROUP BY ALL) JOIN machines ON l_suppkey = s_suppkey),
instances AS (SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) AS sop_instance_uid, l_orderkey || '.' || l_suppkey AS series_instance_uid, l_linenumber AS instance_number, lineitem.* FROM lineitem),
attrs AS (SELECT sop_instance_uid, series_instance_uid, unnest([
    {'tag': '0008,0008', 'value': CASE WHEN l_returnflag = 'R' THEN 'DERIVED\SECONDARY' ELSE 'ORIGINAL\PRIMARY' END},
    {'tag': '0008,0022', 'value': strftime(l_shipdate, '%Y%m%d')}, {'tag': '0008,0050', 'value': 'ACC' || l_partkey},
    {'tag': '0008,1030', 'value': CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'DESC ' || l_linenumber END}, {'tag': '0010,0040', 'value': l_returnflag},
    {'tag': '0011,1010', 'value': CAST(l_suppkey AS VARCHAR)}, {'tag': '0018,0060', 'value': CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)},
    {'tag': '0028,0301', 'value': CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'NO' END}, {'tag': '0099,0010', 'value': 'TOKENS'}], recursive := true) FROM instances),
flat AS (SELECT * FROM instances JOIN series USING (series_instance_uid) JOIN studies USING (study_instance_uid) JOIN patients USING (patient_id))
"""
SHIFT_SQL = "CAST(('0x' || substr(sha256({p}), 1, 8)) AS BIGINT) % 365 - 365"

#: The policy of the queries: every action once.
POLICY = Configuration(
    phi_tags={
        "0008,0022": TagPolicy("Acquisition Date", "SHIFT"),
        "0008,0050": TagPolicy("Accession Number", "REMOVE"),
        "0008,1030": TagPolicy("Study Description", "EMPTY"),
        "0010,0040": TagPolicy("Patient's Sex", "REPLACE", "O"),
        "0018,0060": TagPolicy("KVP", "KEEP"),
    }
)
POLICY_SQL = "policy(tag, name, action, replacement) AS (VALUES ('0008,0022', 'Acquisition Date', 'SHIFT', NULL), ('0008,0050', 'Accession Number', 'REMOVE', NULL), ('0008,1030', 'Study Description', 'EMPTY', NULL), ('0010,0040', 'Patient''s Sex', 'REPLACE', 'O'), ('0018,0060', 'KVP', 'KEEP', NULL))"
FINDINGS_SQL = (
    POLICY_SQL
    + """,
owner AS (SELECT series_instance_uid, patient_id FROM series JOIN studies USING (study_instance_uid)),
findings AS (
    SELECT patient_id AS entity_uid, 'Patient' AS entity_type, 'patient_name' AS field_name, patient_name AS value, 'Names are PHI' AS reason, '0010,0010' AS tag, patient_id, 'REPLACE_TAG' AS action_type, 'patient_name' AS target_attr, 'ANONYMIZED' AS new_value FROM patients WHERE patient_name <> '' AND patient_name NOT IN ('Unknown', 'ANONYMIZED')
    UNION ALL SELECT patient_id, 'Patient', 'patient_id', patient_id, 'Medical Record Numbers are PHI', '0010,0020', patient_id, 'REPLACE_TAG', 'patient_id', 'ANON_' || substr(sha256(patient_id), 1, 12) FROM patients WHERE patient_id NOT IN ('', 'UNKNOWN') AND NOT starts_with(patient_id, 'ANON_')
    UNION ALL SELECT study_instance_uid, 'Study', 'study_date', CAST(study_date AS VARCHAR), 'Dates are Safe Harbor restricted', '0008,0020', patient_id, 'SHIFT_DATE', 'study_date', NULL FROM studies WHERE study_date IS NOT NULL
    UNION ALL SELECT sop_instance_uid, 'Instance', 'Private Tag ' || tag, '<PRIVATE>', 'Private Tag Removal Requested', tag, patient_id, 'REMOVE_TAG', tag, NULL FROM attrs JOIN owner USING (series_instance_uid) WHERE tag = '0011,1010'
    UNION ALL SELECT sop_instance_uid, 'Instance', name, value, 'Matched PHI Tag ' || tag || ' (' || name || ')', tag, patient_id, CASE action WHEN 'REMOVE' THEN 'REMOVE_TAG' WHEN 'SHIFT' THEN 'SHIFT_DATE' ELSE 'REPLACE_TAG' END, tag, CASE action WHEN 'EMPTY' THEN '' WHEN 'REPLACE' THEN coalesce(replacement, 'ANONYMIZED') END
        FROM attrs JOIN policy USING (tag) JOIN owner USING (series_instance_uid) WHERE value IS NOT NULL AND (action IN ('REMOVE', 'SHIFT') OR (action = 'EMPTY' AND value <> '') OR (action = 'REPLACE' AND value NOT IN ('', coalesce(replacement, 'ANONYMIZED')))))
"""
)


def query(sql: str | None = None, over: str = ""):
    """Register a query; ``over`` names the expressions its SQL stands on."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = {"": "", "cohort": COHORT_SQL, "findings": COHORT_SQL + "," + FINDINGS_SQL, "machines": COHORT_SQL.split("patients AS")[0].rstrip().rstrip(",")}[over]
            SQL[f.__name__] = (f"WITH {parts}" + ("" if sql.lstrip().startswith(",") or not parts else " ") + sql) if parts else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log."""
    return _table(spark, sf_dir, "events").select("ts", F.upper("event_type").alias("action_type"), F.col("user_id").cast("string").alias("entity_uid"), F.col("props").alias("details"))


# -- flattening, subsets, export ------------------------------------------------------------------


@query(
    """SELECT patient_id AS "PatientID", patient_name AS "PatientName", study_instance_uid AS "StudyInstanceUID", CAST(study_date AS VARCHAR) AS "StudyDate", series_instance_uid AS "SeriesInstanceUID", modality AS "Modality", sop_instance_uid AS "SOPInstanceUID", manufacturer AS "Manufacturer", model_name AS "Model", device_serial_number AS "DeviceSerial" FROM flat""",
    "cohort",
)
def cohort_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.cohort_report(model.from_tables(spark, sf_dir))


@query("""SELECT sop_instance_uid AS uid, max(value) FILTER (tag = '0008,0050') AS accession, max(value) FILTER (tag = '0010,0040') AS sex, max(value) FILTER (tag = '0028,0301') AS burned_in FROM attrs GROUP BY 1""", "cohort")
def cohort_metadata_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = flatten.cohort_report(model.from_tables(spark, sf_dir), ["0008,0050", "0010,0040", "0028,0301"])
    return report.select(F.col("SOPInstanceUID").alias("uid"), F.col("`0008,0050`").alias("accession"), F.col("`0010,0040`").alias("sex"), F.col("`0028,0301`").alias("burned_in"))


@query("""SELECT sop_instance_uid AS uid, modality FROM flat WHERE modality = 'A' AND manufacturer IN ('FRANCE', 'JAPAN', 'NATION_3')""", "cohort")
def subset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = flatten.cohort_report(model.from_tables(spark, sf_dir))
    return flatten.subset_query(report, "Modality == 'A' and Manufacturer in ['FRANCE', \"JAPAN\", 'NATION_3']").select(F.col("SOPInstanceUID").alias("uid"), F.col("Modality").alias("modality"))


@query("""SELECT sop_instance_uid AS uid FROM flat WHERE patient_id IN ('3', '1.1', '42') OR study_instance_uid IN ('3', '1.1', '42') OR series_instance_uid IN ('3', '1.1', '42') OR sop_instance_uid IN ('3', '1.1', '42')""", "cohort")
def subset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = flatten.cohort_report(model.from_tables(spark, sf_dir))
    ids = spark.createDataFrame([("3",), ("1.1",), ("42",)], "id string")
    return flatten.subset_ids(report, ids).select(F.col("SOPInstanceUID").alias("uid"))


@query("""SELECT sop_instance_uid AS uid FROM flat WHERE study_instance_uid IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')""", "cohort")
def subset_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = flatten.cohort_report(model.from_tables(spark, sf_dir))
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("StudyInstanceUID"), F.lit("x").alias("PatientID"))
    return flatten.subset_frame(report, urgent).select(F.col("SOPInstanceUID").alias("uid"))


@query(
    """, dirty AS (SELECT CAST(c_custkey AS VARCHAR) AS uid FROM customer WHERE c_acctbal < 0 UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem WHERE l_tax > 0.07)
SELECT sop_instance_uid AS uid FROM flat WHERE patient_id NOT IN (SELECT uid FROM dirty) AND study_instance_uid NOT IN (SELECT uid FROM dirty) AND series_instance_uid NOT IN (SELECT uid FROM dirty) AND sop_instance_uid NOT IN (SELECT uid FROM dirty)""",
    "cohort",
)
def safe_export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, lineitem = (_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    dirty = (
        customer.filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("entity_uid"))
        .unionByName(orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("entity_uid")))
        .unionByName(lineitem.filter("l_tax > 0.07").select(model.sop_uid().alias("entity_uid")))
    )
    return flatten.safe_export(model.from_tables(spark, sf_dir), dirty).select(F.col("sop_instance_uid").alias("uid"))


@query(
    """, d AS (SELECT study_instance_uid, arg_min(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'DESC ' || l_linenumber END, sop_instance_uid) AS description FROM flat GROUP BY 1)
SELECT sop_instance_uid, 'Subject_' || patient_id || '/' || regexp_replace(replace('Study_' || study_date || '_' || description || '_' || right(study_instance_uid, 5), ' ', '_'), '[^-\\w.]', '', 'g') || '/Series_' || series_number || '_' || modality || '_Series_' || right(series_instance_uid, 5) || '/' || sop_instance_uid || '.dcm' AS path FROM flat JOIN d USING (study_instance_uid)""",
    "cohort",
)
def export_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.export_paths(model.from_tables(spark, sf_dir))


@query(r"""SELECT page_id, regexp_replace(replace(trim(url, ' '), ' ', '_'), '[^-\p{L}\p{N}_.]', '', 'g') AS a, CASE WHEN trim(regexp_replace(url, '[^\p{L}\p{N} ._-]', '', 'g'), ' ') = '' THEN 'Unknown' ELSE replace(trim(regexp_replace(url, '[^\p{L}\p{N} ._-]', '', 'g'), ' '), ' ', '_') END AS b, printf('%04d', page_id) || '.dcm' AS c FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", naming.clean_filename(F.col("url")).alias("a"), naming.clean_label(F.col("url")).alias("b"), naming.numbered_file(F.col("page_id"), F.col("url")).alias("c"))


# -- inventory, log, reports ----------------------------------------------------------------------


@query("SELECT 'patients' AS level, count(*) AS n FROM patients UNION ALL SELECT 'studies', count(*) FROM studies UNION ALL SELECT 'series', count(*) FROM series UNION ALL SELECT 'instances', count(*) FROM instances", "cohort")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.counts(model.from_tables(spark, sf_dir))


@query("SELECT manufacturer, model_name, count(*) AS n FROM instances JOIN series USING (series_instance_uid) GROUP BY ALL", "cohort")
def equipment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.equipment_counts(model.from_tables(spark, sf_dir))


@query("SELECT DISTINCT manufacturer, model_name, device_serial_number FROM series", "cohort")
def distinct_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.distinct_equipment(model.from_tables(spark, sf_dir))


@query("SELECT upper(event_type) AS action_type, count(*) AS n FROM events GROUP BY 1")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.log_summary(_log(spark, sf_dir))


@query("SELECT ts, upper(event_type) AS action_type, CAST(user_id AS VARCHAR) AS entity_uid, props AS details FROM events WHERE event_type = 'error'")
def audit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.log_errors(_log(spark, sf_dir))


@query("SELECT count(*) AS n_actions, count(*) FILTER (event_type IN ('error', 'warning')) AS n_exceptions, count(*) FILTER (event_type = 'risk') AS n_risks, CASE WHEN count(*) > 0 AND count(*) FILTER (event_type IN ('error', 'warning')) = 0 THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status FROM events")
def compliance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.compliance(_log(spark, sf_dir))


@query("SELECT count(*) AS n_items, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes FROM pages")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.manifest_totals(_table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("size")))


@query("SELECT sop_instance_uid, '/in/' || sop_instance_uid || '.dcm' AS file_path FROM instances WHERE l_linestatus = 'F'", "cohort")
def unsafe_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.unsafe_attributes(model.from_tables(spark, sf_dir))


@query("SELECT sop_instance_uid FROM instances WHERE l_linestatus = 'F' AND l_returnflag <> 'R'", "cohort")
def untreated_burned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.untreated_burned_in(model.from_tables(spark, sf_dir))


@query("SELECT device_serial_number, count(*) FILTER (l_linestatus = 'F') AS n FROM instances JOIN series USING (series_instance_uid) GROUP BY 1", "cohort")
def burned_in_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.burned_in_by_machine(model.from_tables(spark, sf_dir))


# -- audit and remediation ------------------------------------------------------------------------


@query("SELECT *, CAST(NULL AS VARCHAR) AS item_path FROM findings", "findings")
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(model.from_tables(spark, sf_dir), POLICY)


@query("SELECT patient_id, entity_type, entity_uid, field_name AS field, value, reason, action_type AS action, new_value AS proposed_value FROM findings WHERE entity_type <> 'Instance'", "findings")
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.audit(model.from_tables(spark, sf_dir), Configuration(remove_private_tags=False))
    return flatten.findings_rows(found)


@query("SELECT tag, count(*) AS n, substr(arg_min(value, entity_uid || '|' || field_name), 1, 30) AS example, substr(max(reason), 1, 28) AS reason FROM findings GROUP BY tag", "findings")
def safety_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.safety_feedback(audit.audit(model.from_tables(spark, sf_dir), POLICY))


@query("SELECT l_orderkey, l_linenumber, printf('%04x,%04x', CAST(l_suppkey AS INT), CAST(l_partkey AS INT)) AS tag, l_suppkey % 2 = 1 AS private FROM lineitem")
def private_attribute_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.format_string("%04x,%04x", "l_suppkey", "l_partkey")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tag.alias("tag")).withColumn("private", is_private(F.col("tag")))


@query("SELECT c_custkey, 'ANON_' || substr(sha256(c_name), 1, 12) AS pseudonym FROM customer")
def pseudonymize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", audit.pseudonym(F.col("c_name")).alias("pseudonym"))


@query(f"SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST({SHIFT_SQL.format(p='CAST(o_custkey AS VARCHAR)')} AS INT) AS shifted FROM orders")
def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dates.shift_days(F.col("o_custkey").cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.shift_date(F.col("o_orderdate").cast("date"), days).alias("shifted"))


_DAYS = f"CAST({SHIFT_SQL.format(p='CAST(o_custkey AS VARCHAR)')} AS INT)"


@query(
    f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {_DAYS} AS n, o_orderkey % 13 AS k FROM orders),
t AS (SELECT o_orderkey, k, strftime(d, '%Y%m%d') AS c, strftime(d, '%Y-%m-%d') AS i, strftime(d + n, '%Y%m%d') AS c2, strftime(d + n, '%Y-%m-%d') AS i2, strftime(d, '%Y%m') AS m, strftime(date_trunc('month', d)::DATE + n, '%Y%m') AS m2,
    ['', '', '104822', '.104822', '.104822.677', 'T10:48:22', '', '104822.677+0100', '1048', '10-0500', '', '-', ''][k + 1] AS rest FROM d)
SELECT o_orderkey, CASE WHEN k = 6 THEN 'NotADate' WHEN k IN (1, 5) THEN i || rest WHEN k = 10 THEN m WHEN k = 12 THEN c || '-' || c ELSE c || rest END AS raw,
    CASE WHEN k = 6 THEN NULL WHEN k IN (1, 5) THEN i2 || rest WHEN k = 10 THEN m2 WHEN k = 12 THEN c2 || '-' || c2 ELSE c2 || rest END AS shifted FROM t"""
)
def date_shift_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 13
    compact, iso = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd")
    behind = lambda start, *rest: [F.concat(start, F.lit(x)) for x in rest]
    forms = [compact, iso, *behind(compact, "104822", ".104822", ".104822.677"), *behind(iso, "T10:48:22"), F.lit("NotADate"), *behind(compact, "104822.677+0100", "1048", "10-0500"), F.date_format(day, "yyyyMM"), *behind(compact, "-"), F.concat(compact, F.lit("-"), compact)]
    raw = F.element_at(F.array(*forms), (k + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", dates.shift_text(F.col("raw"), dates.shift_days(F.col("o_custkey").cast("string"))).alias("shifted"))


@query("SELECT count(*) AS n_pairs, 0::BIGINT AS n_changed FROM (SELECT o_custkey FROM orders QUALIFY lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL)")
def date_shift_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals within a patient stay as they were."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    moved = dates.shift_date(day, dates.shift_days(F.col("o_custkey").cast("string")))
    gaps = _table(spark, sf_dir, "orders").select(F.datediff(day, F.lag(day).over(w)).alias("before"), F.datediff(moved, F.lag(moved).over(w)).alias("after"))
    return gaps.filter("before is not null").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("before") != F.col("after")).alias("n_changed"))


@query("SELECT tag, action_type, count(*) AS n FROM (SELECT DISTINCT entity_uid, tag, action_type FROM findings) GROUP BY ALL", "findings")
def findings_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.audit(model.from_tables(spark, sf_dir), POLICY)
    return remediate.first_of_each(found.unionByName(found)).groupBy("tag", "action_type").agg(F.count("*").alias("n"))


@query(
    f""", o AS (SELECT sop_instance_uid, strftime(CAST(l_shipdate AS DATE) + CAST({SHIFT_SQL.format(p='patient_id')} AS INT), '%Y%m%d') AS acquired FROM flat)
SELECT sop_instance_uid, acquired, CAST(NULL AS VARCHAR) AS accession, '' AS description, 'O' AS sex, CAST(NULL AS VARCHAR) AS private, 'TOKENS' AS own, CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) AS kvp FROM instances JOIN o USING (sop_instance_uid)""",
    "cohort",
)
def remediate_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift, remove, empty, replace and private removal on every attribute map."""
    whole = model.from_tables(spark, sf_dir)
    done = remediate.apply_policy(whole, POLICY)
    tags = {"acquired": "0008,0022", "accession": "0008,0050", "description": "0008,1030", "sex": "0010,0040", "private": "0011,1010", "own": "0099,0010", "kvp": "0018,0060"}
    return done.instances.select("sop_instance_uid", *(F.col("attributes")[t].alias(c) for c, t in tags.items()))


@query(
    f"""SELECT study_instance_uid, 'ANON_' || substr(sha256(patient_id), 1, 12) AS patient_id, 'ANONYMIZED' AS patient_name, study_date + CAST({SHIFT_SQL.format(p='patient_id')} AS INT) AS study_date FROM studies JOIN patients USING (patient_id)""",
    "cohort",
)
def remediate_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = model.from_tables(spark, sf_dir)
    config = Configuration(remove_private_tags=False)
    done = remediate.remediate(whole, audit.audit(whole, config), config)
    return done.studies.join(done.patients, "patient_id").select("study_instance_uid", "patient_id", "patient_name", "study_date")


@query("SELECT 0::BIGINT AS n")
def audit_after_remediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing but shifted acquisition dates of shifted studies is left to find, and those are exempt."""
    whole = model.placed_tables(spark, sf_dir)
    done = remediate.remediate_own(whole, POLICY)
    return audit.audit(done, POLICY).agg(F.count("*").alias("n"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE action_type WHEN 'REPLACE_TAG' THEN 'REMEDIATION_REPLACE' WHEN 'REMOVE_TAG' THEN 'REMEDIATION_REMOVE' ELSE 'REMEDIATION_SHIFT_DATE' END AS action FROM findings) GROUP BY 1", "findings")
def remediation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediate.log_rows(audit.audit(model.from_tables(spark, sf_dir), POLICY))
    return rows.groupBy(F.col("action_type").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT sop_instance_uid, CASE WHEN l_returnflag = 'R' THEN 'DERIVED\\SECONDARY' ELSE 'DERIVED\\PRIMARY' END AS image_type, 'NO' AS burned_in, '2.25.' || CAST(('0x' || substr(sha256('redacted:' || sop_instance_uid), 1, 15)) AS BIGINT) AS new_uid FROM instances", "cohort")
def redaction_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = remediate.stamp_redacted(F.col("attributes"))
    rows = model.from_tables(spark, sf_dir).instances.select("sop_instance_uid", stamped.alias("a"))
    return rows.select("sop_instance_uid", F.col("a")["0008,0008"].alias("image_type"), F.col("a")["0028,0301"].alias("burned_in"), remediate.new_uid(F.col("sop_instance_uid")).alias("new_uid"))


DEEP_POLICY = Configuration(phi_tags={"0010,0010": TagPolicy("Patient Name", "REPLACE", "X"), "0040,a043": TagPolicy("Concept", "REMOVE"), "0008,0104": TagPolicy("Meaning", "EMPTY")}, remove_private_tags=False)
_ITEMS_SQL = """, items AS (SELECT sop_instance_uid, patient_id, unnest([{'path': '0040,a730[0]', 'tag': '0010,0010', 'vr': 'PN', 'value': 'Doe^' || l_suppkey, 'name': 'Patient Name'}, {'path': '0040,a730[1].0008,1140[0]', 'tag': '0008,0104', 'vr': 'LO', 'value': l_returnflag, 'name': 'Meaning'}, {'path': '0040,a730[1]', 'tag': '0040,a043', 'vr': 'CS', 'value': l_returnflag, 'name': 'Concept'}], recursive := true) FROM flat WHERE l_linenumber % 4 = 0)
"""


@query(_ITEMS_SQL + "SELECT sop_instance_uid AS entity_uid, name || ' (Deep)' AS field_name, value, tag, patient_id, CASE tag WHEN '0040,a043' THEN 'REMOVE_TAG' ELSE 'REPLACE_TAG' END AS action_type, CASE tag WHEN '0010,0010' THEN 'X' WHEN '0008,0104' THEN '' END AS new_value, path AS item_path FROM items", "cohort")
def deep_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in nested items, with their paths."""
    found = audit.audit(model.with_items(spark, sf_dir), DEEP_POLICY)
    return found.filter("item_path is not null").select("entity_uid", "field_name", "value", "tag", "patient_id", "action_type", "new_value", "item_path")


_NEW_UID_SQL = "'2.25.' || CAST(('0x' || substr(sha256('redacted:' || {uid}), 1, 15)) AS BIGINT)"


def _redacted(spark: SparkSession, sf_dir: str) -> model.Cohort:
    """The cohort with nested items after the images of the machines with rules were redacted."""
    whole = model.with_items(spark, sf_dir)
    rules = RULES.zone_frame(spark).filter("serial_number <> '*'")
    changed = zones.plan(whole, rules).select(remediate.new_uid(F.col("sop_instance_uid")).alias("sop_instance_uid"), F.col("sop_instance_uid").alias("original_uid"))
    return zones.mark_changed(whole, changed)


@query(
    _ITEMS_SQL
    + f""", u AS (SELECT sop_instance_uid AS old, CASE WHEN device_serial_number IN ('Supplier#000000001', 'Supplier#000000002') THEN {_NEW_UID_SQL.format(uid="sop_instance_uid")} ELSE sop_instance_uid END AS uid FROM flat)
SELECT uid AS entity_uid, value, path AS item_path FROM items JOIN u ON sop_instance_uid = old""",
    "cohort",
)
def deep_audit_after_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted instances have new uids, and their nested items are found under those."""
    found = audit.audit(_redacted(spark, sf_dir), DEEP_POLICY)
    return found.filter("item_path is not null").select("entity_uid", "value", "item_path")


@query(_ITEMS_SQL + "SELECT sop_instance_uid, path AS item_path, tag, CASE tag WHEN '0010,0010' THEN 'X' ELSE '' END AS value FROM items WHERE tag <> '0040,a043'", "cohort")
def remediate_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy carried out on nested items in place."""
    return remediate.apply_policy(model.with_items(spark, sf_dir), DEEP_POLICY).seq_items.select("sop_instance_uid", "item_path", "tag", "value")


@query(_ITEMS_SQL + "SELECT sop_instance_uid, path AS item_path, tag, CASE tag WHEN '0010,0010' THEN 'X' ELSE '' END AS value FROM items WHERE tag <> '0040,a043'", "cohort")
def remediate_deep_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the findings of the audit."""
    whole = model.with_items(spark, sf_dir)
    return remediate.remediate(whole, audit.audit(whole, DEEP_POLICY), DEEP_POLICY).seq_items.select("sop_instance_uid", "item_path", "tag", "value")


@query(_ITEMS_SQL + "SELECT sop_instance_uid, tag, value FROM items WHERE vr IN ('PN', 'LO')", "cohort")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dicom.text_index(model.with_items(spark, sf_dir).seq_items).select("sop_instance_uid", "tag", "value")


@query("SELECT sop_instance_uid, CASE WHEN l_linenumber % 2 = 0 THEN 'before\\engine' ELSE 'engine' END AS method, '113100' AS code FROM instances", "cohort")
def deid_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method is appended once, whatever was there; stamping twice changes nothing."""
    had = F.when(F.col("instance_number") % 2 == 0, F.map_concat("attributes", F.create_map(F.lit(remediate.DEID_METHOD), F.lit("before")))).otherwise(F.col("attributes"))
    rows = model.from_tables(spark, sf_dir).instances.withColumn("attributes", had)
    for _ in range(2):
        rows = rows.withColumn("attributes", remediate.stamp_deidentified(F.col("attributes"), "engine"))
    return rows.select("sop_instance_uid", F.col("attributes")[remediate.DEID_METHOD].alias("method"), F.col("attributes")[remediate.DEID_METHOD_CODES].alias("code"))


_LACKING = ("0008,0016", "0008,0018", "0008,0020", "0008,0030", "0008,0060", "0020,000e", "0018,0050", "0020,0032", "0020,0037", "0028,0030")
_LACKING_SQL = " + ".join(f"CASE WHEN CAST(l_partkey AS BIGINT) % {k + 2} = 0 THEN 1 {'' if tag == '0018,0050' else f'WHEN CAST(l_partkey AS BIGINT) % {k + 2} = 1 AND l_linenumber % 2 = 0 THEN 1 '}ELSE 0 END" for k, tag in enumerate(_LACKING))


@query(f"SELECT sop_instance_uid, {_LACKING_SQL} AS n_errors, CAST(l_partkey AS BIGINT) % 2 = 0 OR (CAST(l_partkey AS BIGINT) % 2 = 1 AND l_linenumber % 2 = 0) AS lacks_class FROM instances WHERE {_LACKING_SQL} > 0", "cohort")
def iod_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that are there, absent or empty by the part's number; an empty type-2 one is no error."""
    lineitem = _table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey").cast("long")
    entries = [F.when(n % (k + 2) == 0, None).when((n % (k + 2) == 1) & (F.col("l_linenumber") % 2 == 0), F.struct(F.lit(t).alias("key"), F.lit("").alias("value"))).otherwise(F.struct(F.lit(t).alias("key"), F.lit("x").alias("value"))) for k, t in enumerate(_LACKING)]
    extra = F.map_from_entries(F.array_compact(F.array(*entries)))
    rows = lineitem.select(model.sop_uid().alias("sop_instance_uid"), F.lit("1.2.840.10008.5.1.4.1.1.2").alias("sop_class_uid"), F.map_concat(model.line_attributes(), extra).alias("attributes"))
    lacks_class = F.exists("errors", lambda e: e.contains("0008,0016") & e.startswith("[Type 1 Error]"))
    return validate.invalid(rows).select("sop_instance_uid", F.size("errors").alias("n_errors"), lacks_class.alias("lacks_class"))


# -- machine rules and zones ----------------------------------------------------------------------

RULES = Configuration(
    rules=[
        {"serial_number": "Supplier#000000001", "manufacturer": "", "model_name": "", "redaction_zones": [[0, 3, 0, 3], {"roi": [5, 8, 5, 20]}]},
        {"serial_number": "Supplier#000000002", "manufacturer": "", "model_name": "ASIA", "redaction_zones": [[1, 2, 1, 2]]},
        {"serial_number": "*", "manufacturer": "", "model_name": "", "redaction_zones": [[0, 1, 0, 8]]},
    ]
)


@query("""SELECT device_serial_number, CASE WHEN device_serial_number = 'Supplier#000000001' THEN 3 WHEN device_serial_number = 'Supplier#000000002' THEN 2 ELSE 1 END::BIGINT AS n_zones, count(*) AS n_instances FROM instances JOIN series USING (series_instance_uid) GROUP BY 1""", "cohort")
def machine_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and wildcard rules: zones and instances per machine."""
    tasks = zones.plan(model.from_tables(spark, sf_dir), RULES.zone_frame(spark))
    return tasks.groupBy("device_serial_number", F.size("zones").cast("long").alias("n_zones")).agg(F.count("*").alias("n_instances"))


@query("""SELECT r.s AS serial_number, count(i.series_instance_uid) AS n_images FROM (VALUES ('Supplier#000000001'), ('Supplier#000000002'), ('*')) r(s) LEFT JOIN (SELECT series_instance_uid, device_serial_number FROM instances JOIN series USING (series_instance_uid)) i ON r.s = i.device_serial_number GROUP BY 1""", "cohort")
def preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.preview(model.from_tables(spark, sf_dir), RULES.zone_frame(spark))


@query(
    """, s(rule_pos, serial_number, manufacturer, model_name) AS (VALUES (0, 'Supplier#000000003', '', 'x'), (1, 'y', '', 'ASIA'), (2, 'z', 'FRANCE', 'EUROPE')), n(rule_pos, manufacturer, model_name) AS (VALUES (0, 'united', 'america'), (1, 'n', 'asia'), (2, '', 'europe')),
m AS (SELECT DISTINCT ON (device_serial_number) manufacturer, model_name, device_serial_number FROM machines),
c AS (SELECT m.*, 1 AS priority, s.rule_pos FROM m JOIN s ON m.device_serial_number = s.serial_number
    UNION ALL SELECT m.*, 2, n.rule_pos FROM m JOIN n ON n.manufacturer <> '' AND n.model_name <> '' AND contains(lower(m.manufacturer), n.manufacturer) AND contains(lower(m.model_name), n.model_name)
    UNION ALL SELECT m.*, 3, s.rule_pos FROM m JOIN s ON m.model_name = s.model_name AND (s.manufacturer = '' OR s.manufacturer = m.manufacturer))
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY device_serial_number ORDER BY priority, rule_pos) = 1""",
    "machines",
)
def scaffold_kb_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = spark.createDataFrame([(0, "Supplier#000000003", "", "x"), (1, "y", "", "ASIA"), (2, "z", "FRANCE", "EUROPE")], "rule_pos int, serial_number string, manufacturer string, model_name string")
    named = spark.createDataFrame([(0, "united", "america"), (1, "n", "asia"), (2, "", "europe")], "rule_pos int, manufacturer string, model_name string")
    return zones.knowledge_matches(model.equipment(spark, sf_dir), serial, named)


@query("SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (((i - 1) // 8) >= 1 AND ((i - 1) // 8) < 3 AND ((i - 1) % 8) >= 2 AND ((i - 1) % 8) < 5) OR (((i - 1) // 8) >= 6 AND ((i - 1) % 8) < 4) THEN 0 ELSE x END) AS redacted FROM embeddings")
def roi_redact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zones on an 8x8 image: both are applied, fractions cut off, ends clamped."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", zones.fill_vector(F.col("embedding"), 8, 8, [(1.9, 3, 2.5, 5), (6, 99, 0, 4)]).alias("redacted"))


@query("SELECT sha256(text) AS pixel_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def pixel_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("pixel_hash"))
    return hashed.groupBy("pixel_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR regions made from lineitems: box by arithmetic, text from flags."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return lineitem.select(
        F.concat(F.lit("Supplier#00000000"), (F.col("l_suppkey") % 4).cast("string")).alias("serial_number"),
        model.sop_uid().alias("sop_instance_uid"),
        F.concat_ws(" ", F.lit("Text"), "l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_linenumber") * 2 - 2).cast("int").alias("x"),
        (F.col("l_partkey") % 9).cast("int").alias("y"),
        (F.col("l_quantity") / 5).cast("int").alias("w"),
        (F.col("l_orderkey") % 4).cast("int").alias("h"),
    )


_REGIONS_SQL = """WITH r AS (SELECT 'Supplier#00000000' || (l_suppkey % 4) AS serial_number, l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || CAST(round(l_extendedprice * 100) AS BIGINT) AS sop_instance_uid, 'Text ' || l_returnflag || ' ' || l_linestatus AS text, l_linenumber * 2 - 2 AS x, l_partkey % 9 AS y, CAST(trunc(l_quantity / 5) AS INT) AS w, l_orderkey % 4 AS h FROM lineitem),
z(s, zp, r1, r2, c1, c2) AS (VALUES ('Supplier#000000001', 0, 0, 3, 0, 3), ('Supplier#000000001', 1, 5, 8, 5, 20), ('Supplier#000000002', 0, 1, 2, 1, 2)),
p AS (SELECT r.*, zp, r1, r2, c1, c2, CASE WHEN w * h > 0 AND r1 IS NOT NULL AND least(x + w, c2) > greatest(x, c1) AND least(y + h, r2) > greatest(y, r1) THEN (least(x + w, c2) - greatest(x, c1)) * (least(y + h, r2) - greatest(y, r1)) / CAST(w * h AS DOUBLE) ELSE 0.0 END AS cov FROM r LEFT JOIN z ON serial_number = s),
b AS (SELECT *, coalesce(cov, 0.0) AS coverage FROM p QUALIFY row_number() OVER (PARTITION BY sop_instance_uid ORDER BY cov DESC, zp) = 1),
k AS (SELECT *, CASE WHEN coverage > 0 THEN 'PARTIAL_LEAK' ELSE 'NEW_LEAK' END AS leak_type FROM b WHERE coverage < 0.8)
"""


@query(_REGIONS_SQL + "SELECT sop_instance_uid, leak_type, coverage, CASE WHEN coverage > 0 THEN 'Partial Leak' ELSE 'New Leak (Uncovered)' END || printf(' (Cov: %.2f)', round_even(coverage * 100, 0) / 100) AS reason FROM k")
def coverage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RULES.zone_frame(spark).filter("serial_number <> '*'")
    return zones.verify(_regions(spark, sf_dir), rules).select("sop_instance_uid", "leak_type", "coverage", "reason")


@query(
    _REGIONS_SQL
    + "SELECT serial_number, CASE leak_type WHEN 'PARTIAL_LEAK' THEN 'EXPAND_ZONE' ELSE 'ADD_ZONE' END AS action, CASE leak_type WHEN 'PARTIAL_LEAK' THEN least(y, r1) ELSE y END::INT AS r1, CASE leak_type WHEN 'PARTIAL_LEAK' THEN greatest(y + h, r2) ELSE y + h END::INT AS r2, CASE leak_type WHEN 'PARTIAL_LEAK' THEN least(x, c1) ELSE x END::INT AS c1, CASE leak_type WHEN 'PARTIAL_LEAK' THEN greatest(x + w, c2) ELSE x + w END::INT AS c2 FROM k"
)
def zone_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RULES.zone_frame(spark).filter("serial_number <> '*'")
    return zones.suggestions(zones.verify(_regions(spark, sf_dir), rules)).select("serial_number", "action", "new_zone.*")


@query("SELECT DISTINCT device_serial_number, CASE device_serial_number WHEN 'Supplier#000000001' THEN 0 ELSE 1 END AS rule_pos, r1 FROM machines JOIN (VALUES ('Supplier#000000001', 0.0::DOUBLE), ('Supplier#000000002', 1.0::DOUBLE)) v(s, r1) ON device_serial_number = s", "machines")
def first_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first exact rule per machine, with its first zone; wildcards don't count."""
    rules = RULES.zone_frame(spark)
    later = rules.filter("serial_number <> '*'").withColumns({"rule_pos": F.col("rule_pos") + 5, "r1": F.lit(99.0)})
    found = zones.first_rule(model.equipment(spark, sf_dir), rules.filter("zone_pos = 0").unionByName(later))
    return found.select("device_serial_number", "rule_pos", "r1")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w * h > 0 THEN CASE WHEN least(x + w, 10) > x AND least(y + h, 6) > greatest(y, 1) THEN (least(x + w, 10) - x) * (least(y + h, 6) - greatest(y, 1)) ELSE 0 END / CAST(w * h AS DOUBLE) >= 0.5 ELSE false END AS covered FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 2 - 2 AS x, l_partkey % 9 AS y, CAST(trunc(l_quantity / 5) AS INT) AS w, l_orderkey % 4 AS h FROM lineitem)")
def covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which a zone covers at least half."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2 - 2).alias("x"), (F.col("l_partkey") % 9).alias("y"), (F.col("l_quantity") / 5).cast("int").alias("w"), (F.col("l_orderkey") % 4).alias("h"))
    zone = {"x": F.lit(0), "y": F.lit(1), "w": F.lit(10), "h": F.lit(5)}
    return rows.select("l_orderkey", "l_linenumber", zones.is_covered({k: F.col(k) for k in "xywh"}, zone).alias("covered"))


@query("SELECT sop_instance_uid FROM instances JOIN series USING (series_instance_uid) WHERE modality = 'SC' OR (modality = 'R' AND l_linenumber % 2 = 0)", "cohort")
def image_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without pixels; the modality R stands for CT here, the others for documents."""
    flat = flatten.flatten(model.from_tables(spark, sf_dir))
    kind = F.when(F.col("modality") == "R", "CT").otherwise(F.concat(F.lit("DOC"), "modality"))
    pixels = F.when(F.col("instance_number") % 2 == 1, F.lit(b"\x00"))
    return flat.filter(validate.lacks_pixels(kind, pixels)).select("sop_instance_uid")


# -- discovery ------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from parts on a wide canvas; a part's brand stands for the machine."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("serial_number"),
        F.col("p_partkey").alias("candidate"),
        F.col("p_name").alias("text"),
        F.lit(90.0).alias("confidence"),
        (F.col("p_partkey") % 20).cast("int").alias("source_index"),
        (F.col("p_partkey") * 37 % 4001).cast("int").alias("x"),
        (F.col("p_partkey") * 101 % 3001).cast("int").alias("y"),
        (F.col("p_size") + 10).cast("int").alias("w"),
        (F.col("p_size") % 13 + 6).cast("int").alias("h"),
    ).withColumn("classification", discover.classify_text(F.col("text")))


_BOXES_SQL = """p AS (SELECT p_brand AS serial_number, p_partkey AS candidate, p_name AS text, p_partkey % 20 AS source_index, p_partkey * 37 % 4001 AS x, p_partkey * 101 % 3001 AS y, p_size + 10 AS w, p_size % 13 + 6 AS h FROM part),
e AS (SELECT a.serial_number, a.candidate AS u, b.candidate AS v FROM p a JOIN p b ON a.serial_number = b.serial_number AND a.x + a.w + 20 >= b.x AND b.x + b.w + 20 >= a.x AND a.y + a.h + 10 >= b.y AND b.y + b.h + 10 >= a.y),
l(u, v) AS (SELECT u, v FROM e UNION SELECT l.u, e.v FROM l JOIN e ON l.v = e.u),
c AS (SELECT u AS candidate, min(v) AS cluster FROM l GROUP BY 1)
"""


@query("WITH RECURSIVE " + _BOXES_SQL + "SELECT candidate, cluster FROM c")
def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.clusters(_candidates(spark, sf_dir)).select("candidate", "cluster")


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that return at twenty places of a machine, a little apart; some texts are names."""
    key = F.col("p_partkey")
    text = F.when(key % 11 == 0, F.concat(F.lit("DOE^"), key.cast("string"))).when(key % 3 == 0, F.concat(F.lit("Ward "), key.cast("string"))).otherwise(F.concat(F.lit("kvp "), key.cast("string")))
    boxes = _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("serial_number"), key.alias("candidate"), text.alias("text"), (80 + key % 16).cast("double").alias("confidence"), (key % 20).cast("int").alias("source_index"),
        (key % 5 * 700 + key % 3).cast("int").alias("x"), (key % 4 * 500 + key % 2).cast("int").alias("y"), (key % 7 * 3 + 2).cast("int").alias("w"), (key % 13 + 2).cast("int").alias("h"),
    )
    return boxes.withColumn("classification", discover.classify_text(F.col("text")))


_RECURRING_SQL = """p AS (SELECT p_brand AS serial_number, p_partkey AS candidate, CASE WHEN p_partkey % 11 = 0 THEN 'DOE^' WHEN p_partkey % 3 = 0 THEN 'Ward ' ELSE 'kvp ' END || p_partkey AS text, CAST(80 + p_partkey % 16 AS DOUBLE) AS confidence, p_partkey % 20 AS source_index,
    p_partkey % 5 * 700 + p_partkey % 3 AS x, p_partkey % 4 * 500 + p_partkey % 2 AS y, p_partkey % 7 * 3 + 2 AS w, p_partkey % 13 + 2 AS h FROM part),
c AS (SELECT candidate, min(candidate) OVER (PARTITION BY serial_number, candidate % 5, candidate % 4) AS cluster FROM p)
"""


@query(
    "WITH "
    + _RECURRING_SQL
    + """SELECT serial_number, cluster, min(y)::INT AS r1, max(y + h)::INT AS r2, min(x)::INT AS c1, max(x + w)::INT AS c2, count(DISTINCT source_index) / 20 AS occurrence, CASE WHEN count(DISTINCT source_index) > 18 THEN 'STATIC_ALWAYS' WHEN count(DISTINCT source_index) > 10 THEN 'STATIC_FREQUENT' ELSE 'TRANSIENT' END AS status,
    CASE WHEN bool_or(text LIKE 'DOE^%') THEN 'LIKELY_NAME' WHEN bool_or(text LIKE 'Ward %') THEN 'PROPER_NOUN' ELSE 'TEXT' END AS type, array_to_string(list_sort(list_distinct(list(text)))[1:3], '|') AS examples, avg(confidence) AS confidence
FROM p JOIN c USING (candidate) GROUP BY 1, 2 HAVING count(DISTINCT source_index) >= 1 AND max(x + w) - min(x) > 5 AND max(y + h) - min(y) > 5"""
)
def discovered_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.zones(discover.clusters(_recurring(spark, sf_dir)), 20, 0.05)
    return discover.stability(found).select("serial_number", "cluster", "r1", "r2", "c1", "c2", "occurrence", "status", "type", F.array_join("examples", "|").alias("examples"), "confidence")


@query("WITH " + _RECURRING_SQL + "SELECT serial_number, cluster, min(x)::INT AS x, min(y)::INT AS y, (max(x + w) - min(x))::INT AS w, (max(y + h) - min(y))::INT AS h, string_agg(candidate, ',' ORDER BY candidate) AS members FROM p JOIN c USING (candidate) GROUP BY 1, 2")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.merged_boxes(discover.clusters(_recurring(spark, sf_dir)))
    return found.select("serial_number", "cluster", "x", "y", "w", "h", F.array_join("candidates", ",").alias("members"))


@query("WITH " + _RECURRING_SQL + "SELECT candidate, text FROM p WHERE confidence >= 90 AND text LIKE 'DOE^%'")
def candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By confidence, then by a condition."""
    sure = discover.filtered(_recurring(spark, sf_dir), 90.0)
    return discover.filtered(sure, F.col("classification") == "NAME_PATTERN").select("candidate", "text")


@query("""WITH p AS (SELECT p_partkey * 37 % 4001 AS x, p_partkey * 101 % 3001 AS y, p_size + 10 AS w, p_size % 13 + 6 AS h FROM part), m AS (SELECT max(x) AS mx, max(y) AS my FROM p),
d AS (SELECT least(CAST(floor((y + h // 2) / CAST(my AS DOUBLE) * 10) AS INT), 9) AS r, least(CAST(floor((x + w // 2) / CAST(mx AS DOUBLE) * 10) AS INT), 9) AS c FROM p, m)
SELECT CAST(g // 10 AS INT) AS r, CAST(g % 10 AS INT) AS c, (SELECT count(*) FROM d WHERE d.r = g // 10 AND d.c = g % 10) AS n FROM range(100) t(g)""")
def density_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.density(_candidates(spark, sf_dir))


@query(r"""SELECT doc_id, CASE WHEN contains(text, '^') AND regexp_matches(text, '\p{L}') THEN 'NAME_PATTERN' WHEN regexp_matches(text, '(?:^|\s)[^\p{L}\p{M}\p{N}_\s]*\p{Lu}[^\p{L}\p{M}\p{N}_\s]*[\p{L}\p{M}\p{N}_]') THEN 'PROPER_NOUN_CANDIDATE' ELSE 'TEXT' END AS kind FROM documents""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", discover.classify_text(F.col("text")).alias("kind"))


# -- storage --------------------------------------------------------------------------------------


@query("SELECT sop_instance_uid, CAST(split_part(tag, ',', 1) AS VARCHAR) AS group_id, split_part(tag, ',', 2) AS element_id, 0 AS atom_index, value FROM attrs WHERE tag IN ('0011,1010', '0099,0010')", "cohort")
def eav_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.to_eav(model.from_tables(spark, sf_dir).instances)


@query("SELECT l_orderkey, l_suppkey, string_agg(l_returnflag || l_linenumber, '\\' ORDER BY l_linenumber, l_returnflag) AS value FROM lineitem GROUP BY 1, 2")
def eav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several parts go out as atoms and come back in order."""
    from pyspark.sql import Window

    atoms = _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sop_instance_uid"), F.lit("0011").alias("group_id"), F.lit("1010").alias("element_id"),
        (F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_returnflag")) - 1).alias("atom_index"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("value"),
    )
    back = catalog.from_eav(atoms)
    key = F.split("sop_instance_uid", r"\|")
    return back.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("long").alias("l_suppkey"), F.col("attributes")["0011,1010"].alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"0099,0010\":\"own\"}' AS attributes_json FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute maps from their JSON form and back."""
    maps = _table(spark, sf_dir, "events").select("event_id", catalog.attributes_from_json(F.col("props")).alias("attributes"))
    more = F.map_concat("attributes", F.create_map(F.lit("0099,0010"), F.lit("own")))
    return maps.select("event_id", F.col("attributes")["k"].alias("k"), catalog.attributes_to_json(more).alias("attributes_json"))


@query("SELECT sop_instance_uid, group_id, element_id, value FROM (SELECT sop_instance_uid, split_part(tag, ',', 1) AS group_id, split_part(tag, ',', 2) AS element_id, CASE WHEN tag = '0011,1010' AND CAST(value AS INT) % 2 = 0 THEN 'new' ELSE value END AS value FROM attrs WHERE tag IN ('0011,1010', '0099,0010'))", "cohort")
def eav_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element that comes anew takes the place of all its old atoms."""
    old = catalog.to_eav(model.from_tables(spark, sf_dir).instances)
    twice = old.unionByName(old.filter("group_id = '0011' and cast(value as int) % 2 = 0").withColumn("atom_index", F.lit(1)))
    new = old.filter("group_id = '0011' and cast(value as int) % 2 = 0").withColumn("value", F.lit("new"))
    return catalog.replace_eav(twice, new).select("sop_instance_uid", "group_id", "element_id", "value")


@query("SELECT sop_instance_uid, CASE WHEN l_linenumber = 1 THEN 'changed' ELSE l_returnflag END AS sex, CASE WHEN l_linenumber = 1 THEN 1 ELSE 9 END AS n FROM instances", "cohort")
def attributes_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = model.from_tables(spark, sf_dir).instances
    changed = instances.filter("instance_number = 1").select("sop_instance_uid", F.create_map(F.lit("0010,0040"), F.lit("changed")).alias("attributes"))
    return catalog.update_attributes(instances, changed).select("sop_instance_uid", F.col("attributes")["0010,0040"].alias("sex"), F.size("attributes").alias("n"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames."""
    text = F.col("text").cast("binary")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sop_instance_uid"), text.alias("pixels"), F.sha2(text, 256).alias("pixel_hash"), F.substring("source", 1, 3).alias("part"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS pixel_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def frames_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose pixels aren't stored yet, each once."""
    frames = _frames(spark, sf_dir)
    return catalog.new_frames(frames, frames.filter("sop_instance_uid % 2 = 0")).select(F.col("sop_instance_uid").alias("doc_id"), "pixel_hash")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def frames_intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    harmed = frames.withColumn("pixels", F.when(F.col("sop_instance_uid") % 5 == 0, F.concat("pixels", F.lit(b"\x00"))).otherwise(F.col("pixels")))
    return catalog.intact(harmed).select(F.col("sop_instance_uid").alias("doc_id"))


@query("SELECT sop_instance_uid, '/in/' || sop_instance_uid || '.dcm' AS file_path FROM instances WHERE l_linestatus = 'F' AND l_linenumber % 2 = 0", "cohort")
def exactly_burned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.transform_values("attributes", lambda k, v: F.when((k == "0028,0301") & (F.col("instance_number") % 2 == 0), F.upper(v)).otherwise(v))
    return inventory.exactly_burned_in(model.from_tables(spark, sf_dir).map(instances=lambda df: df.withColumn("attributes", spelled)))


@query("SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, min(CASE WHEN event_type = 'error' THEN 'E' || lpad(CAST(event_id AS VARCHAR), 12, '0') END) AS first_error FROM events")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return inventory.export_summary(_table(spark, sf_dir, "events").select(F.lit("p").alias("path"), failed.alias("error")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, upper(event_type) AS action_type, count(*) AS n FROM events GROUP BY ALL")
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming counts over a whole log."""
    return windows.audit_counts(_log(spark, sf_dir))


@query("SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) AS patient_id FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def missing_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).cast("string").alias("patient_id"))
    return identity.missing_patients(model.from_tables(spark, sf_dir), ids)


@query(
    """, f AS (SELECT patient_id, patient_name, arg_min(l_returnflag, sop_instance_uid) AS sex, arg_min('ACC' || l_partkey, sop_instance_uid) AS accession FROM flat GROUP BY ALL)
SELECT 'ANON_' || substr(sha256(patient_id), 1, 12) AS patient_id, patient_id AS original_id, patient_name AS original_name, sex, accession FROM f""",
    "cohort",
)
def locked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed, anonymised and recovered: what each patient's token says."""
    key = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
    locked = identity.lock(model.placed_tables(spark, sf_dir, by_patient=True, tags=identity.DEFAULT_TAGS), key)
    found = identity.recover(remediate.apply_policy(locked, POLICY), key)
    tags = {"original_id": "0010,0020", "original_name": "0010,0010", "sex": "0010,0040", "accession": "0008,0050"}
    return found.select("patient_id", *(F.col("original")[t].alias(c) for c, t in tags.items()))


@query("SELECT patient_id, study_instance_uid, series_instance_uid, sop_instance_uid, modality, '/in/' || sop_instance_uid || '.dcm' AS file_path FROM flat", "cohort")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.manifest_rows(model.from_tables(spark, sf_dir))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'kept' END AS change FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 UNION ALL SELECT -c_custkey - 1, 'new', 'inserted' FROM customer")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows updated, one fifth of the rest gone, others inserted."""
    orders = _table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("status"))
    new = new.unionByName(_table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("id"), F.lit("new").alias("status")))
    gone = orders.filter("o_orderkey % 5 = 0 and o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    return catalog.upsert(old, new, ["id"], gone)


@query("SELECT doc_id, sha256(text) AS pixel_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def compaction_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sop_instance_uid"), F.sha2(F.col("text").cast("binary"), 256).alias("pixel_hash"))
    live = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sop_instance_uid"))
    return catalog.live_frames(frames, live).withColumnRenamed("sop_instance_uid", "doc_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
