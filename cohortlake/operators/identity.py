"""Reversible identities: one token per patient, carried by each of its instances.

A token has Fernet's layout: version, time, IV and AES-CBC ciphertext, HMAC-SHA256. Both are built
from Spark's own functions. The key travels in a one-row table, never as a literal, so no plan
shows it. The IV is derived from key and content: locking twice gives the same token.
"""

from __future__ import annotations

import base64
import os
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cohort import Cohort

TOKEN, TOKEN_SYNTAX = "0400,0510", "0400,0520"
# Fixed value: the syntax of the encrypted content.
SYNTAX = "1.2.840.10008.1.2"
DEFAULT_TAGS = ("0010,0010", "0010,0020", "0010,0030", "0010,0040", "0008,0050")


def load_or_make_key(path: str) -> str:
    """The key in a file of the driver's, made if there is none."""
    file = Path(path)
    if not file.exists():
        file.write_text(base64.urlsafe_b64encode(os.urandom(32)).decode())
        file.chmod(0o600)
    return file.read_text().strip()


def _key_row(spark: SparkSession, key: str) -> DataFrame:
    raw = base64.urlsafe_b64decode(key)
    if len(raw) != 32:
        raise ValueError("a key is 32 bytes in URL-safe base64")
    pad = lambda x: bytearray(b ^ x for b in raw[:16].ljust(64, b"\0"))
    return spark.createDataFrame([(pad(0x36), pad(0x5C), bytearray(raw[16:]))], "_ipad binary, _opad binary, _aes binary")


def _hmac(data: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(F.col("_ipad"), data), 256))
    return F.unhex(F.sha2(F.concat(F.col("_opad"), inner), 256))


def encrypt(df: DataFrame, column: str, key: str, out: str, seconds: int = 0) -> DataFrame:
    """``df`` with the token of a string column; null and empty stay null."""
    keyed = df.crossJoin(F.broadcast(_key_row(df.sparkSession, key)))
    data = F.col(column).cast("binary")
    iv = F.substring(_hmac(data), 1, 16)
    sealed = F.aes_encrypt(data, F.col("_aes"), F.lit("CBC"), F.lit("PKCS"), iv)
    body = F.concat(F.unhex(F.lit("80" + f"{seconds:016x}")), sealed)
    token = F.translate(F.base64(F.concat(F.col("_body"), _hmac(F.col("_body")))), "+/\r\n", "-_")
    made = keyed.withColumn("_body", F.when(F.col(column) != "", body))
    return made.withColumn(out, token).drop("_ipad", "_opad", "_aes", "_body")


def decrypt(df: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """The text of a token; null if it was changed, or made with another key."""
    keyed = df.crossJoin(F.broadcast(_key_row(df.sparkSession, key)))
    raw = F.unbase64(F.translate(F.col(column), "-_", "+/"))
    split = keyed.withColumn("_raw", F.when(F.col(column).rlike("^[A-Za-z0-9_=-]{100,}$"), raw))
    body = F.substring(F.col("_raw"), F.lit(1), F.length("_raw") - 32)
    genuine = _hmac(body) == F.substring(F.col("_raw"), -32, 32)
    sealed = F.substring(body, F.lit(10), F.length(body))
    plain = F.try_aes_decrypt(F.when(genuine, sealed), F.col("_aes"), F.lit("CBC"), F.lit("PKCS"))
    return split.withColumn(out, plain.cast("string")).drop("_ipad", "_opad", "_aes", "_raw")


def _owned(cohort: Cohort) -> DataFrame:
    """Instances with their patient's id."""
    if cohort.placed:
        return cohort.instances.withColumn("patient_id", F.col("of_patient"))
    return cohort.instances.join(cohort.series.select("series_instance_uid", "study_instance_uid"), "series_instance_uid").join(cohort.studies.select("study_instance_uid", "patient_id"), "study_instance_uid")


def tokens(cohort: Cohort, key: str, patient_ids: DataFrame | None = None, tags: tuple[str, ...] = DEFAULT_TAGS) -> DataFrame:
    """(patient_id, token): each patient's attributes, of the first instance by uid, encrypted once."""
    patients = cohort.patients.join(patient_ids.select("patient_id").distinct(), "patient_id", "left_semi") if patient_ids is not None else cohort.patients
    wanted = F.map_filter("attributes", lambda k, v: k.isin(*tags) & ~k.isin("0010,0010", "0010,0020"))
    first = _owned(cohort).groupBy("patient_id").agg(F.min_by(wanted, "sop_instance_uid").alias("rest"))
    content = F.to_json(F.map_concat(F.create_map(F.lit("0010,0010"), F.coalesce("patient_name", F.lit("")), F.lit("0010,0020"), F.col("patient_id")), "rest"))
    return encrypt(patients.join(first, "patient_id").withColumn("_content", content), "_content", key, "token").select("patient_id", "token")


def lock(cohort: Cohort, key: str, patient_ids: DataFrame | None = None, tags: tuple[str, ...] = DEFAULT_TAGS) -> Cohort:
    """Every instance of the patients carries the patient's token, whichever it had before."""
    made = tokens(cohort, key, patient_ids, tags)
    if cohort.placed:
        met = cohort.instances.join(made.withColumnRenamed("patient_id", "of_patient"), "of_patient", "left")
    else:
        by_series = cohort.series.select("series_instance_uid", "study_instance_uid").join(cohort.studies.select("study_instance_uid", "patient_id"), "study_instance_uid").join(made, "patient_id").select("series_instance_uid", "token")
        met = cohort.instances.join(by_series, "series_instance_uid", "left")
    kept = F.map_filter("attributes", lambda k, v: ~k.isin(TOKEN, TOKEN_SYNTAX))
    sealed = F.map_concat(kept, F.create_map(F.lit(TOKEN), F.col("token"), F.lit(TOKEN_SYNTAX), F.lit(SYNTAX)))
    instances = met.withColumn("attributes", F.when(F.col("token").isNotNull(), sealed).otherwise(F.col("attributes")))
    return replace(cohort, instances=instances.select(cohort.instances.columns))


def missing_patients(cohort: Cohort, ids: DataFrame) -> DataFrame:
    """Ids that were to be locked but are no patients."""
    return ids.distinct().join(cohort.patients.select("patient_id"), "patient_id", "left_anti")


def recover(cohort: Cohort, key: str) -> DataFrame:
    """(patient_id, original): the attributes in each patient's token; null if it can't be read."""
    one = _owned(cohort).select("patient_id", "sop_instance_uid", F.col("attributes")[TOKEN].alias("token"))
    # min_by passes over null uids; a filter before it would work every token out twice
    one = one.groupBy("patient_id").agg(F.min_by("token", F.when(F.col("token").isNotNull(), F.col("sop_instance_uid"))).alias("token")).filter("token is not null")
    return decrypt(one, "token", key, "_json").select("patient_id", F.from_json("_json", "map<string,string>").alias("original"))


def restore(cohort: Cohort, key: str, patient_id: str | None = None) -> Cohort:
    """Names, ids and attributes as they were when they were locked."""
    found = recover(cohort, key).filter("original is not null")
    if patient_id is not None:
        found = found.filter(F.col("patient_id") == patient_id)
    found = found.select(F.col("patient_id").alias("_pid"), "original")
    new_id, match = F.coalesce(F.col("original")["0010,0020"], "patient_id"), F.col("patient_id") == F.col("_pid")
    patients = cohort.patients.join(found, match, "left").select(new_id.alias("patient_id"), F.coalesce(F.col("original")["0010,0010"], "patient_name").alias("patient_name"))
    home = cohort.series.select("series_instance_uid", "study_instance_uid").join(cohort.studies.select("study_instance_uid", "patient_id"), "study_instance_uid").join(found, match).select("series_instance_uid", "original")
    back = F.map_concat(F.map_filter("attributes", lambda k, v: ~F.map_contains_key("original", k)), "original")
    instances = cohort.instances.join(home, "series_instance_uid", "left").withColumn("attributes", F.when(F.col("original").isNotNull(), back).otherwise(F.col("attributes"))).select(cohort.instances.columns)
    if cohort.placed:
        instances = instances.join(found, F.col("of_patient") == F.col("_pid"), "left").withColumn("of_patient", F.coalesce(F.col("original")["0010,0020"], "of_patient")).select(cohort.instances.columns)
    studies = cohort.studies.join(found, match, "left").withColumn("patient_id", new_id).select(cohort.studies.columns)
    return replace(cohort, patients=patients, studies=studies, instances=instances)
