"""A session: a catalog folder, a configuration, and the operators under one roof.

Frames are lazy; tables are written when a step says so, and each write is a new version.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import naming
from .operators import audit, catalog, discover, flatten, identity, inventory, remediate, report, validate, zones
from .operators.catalog import Catalog
from .plans.cohort import Cohort, empty
from .sources import ctp, dicom
from .sources.policy import Configuration

LOG = "ts timestamp, action_type string, entity_uid string, details string"


class Session:
    def __init__(self, spark: SparkSession, folder: str, configuration: Configuration | None = None, codecs: dict[str, dicom.Codec] | None = None):
        """``codecs`` decode further transfer syntaxes, by their uid."""
        self.spark = spark
        self.catalog = Catalog(spark, folder)
        self.configuration = configuration or Configuration.default()
        self.codecs = codecs
        self.key: str | None = None

    # -- tables ---------------------------------------------------------------------------------

    @property
    def cohort(self) -> Cohort:
        blank = empty(self.spark)
        return Cohort(**{f.name: self.catalog.read(f.name) if self.catalog.exists(f.name) else getattr(blank, f.name) for f in fields(Cohort)})

    @property
    def frames(self) -> DataFrame:
        return self.catalog.read("frames")

    @property
    def log(self) -> DataFrame:
        return self.catalog.read("log") if self.catalog.exists("log") else self.spark.createDataFrame([], LOG)

    def save(self, cohort: Cohort) -> None:
        """Write every table anew; all are computed from the versions that were in force."""
        for f in fields(Cohort):
            if (table := getattr(cohort, f.name)) is not None:
                self.catalog.write(f.name, table)

    def record(self, rows: DataFrame) -> None:
        """Append (action_type, entity_uid, details) to the log."""
        self.catalog.append("log", rows.select(F.current_timestamp().alias("ts"), "action_type", F.col("entity_uid").cast("string").alias("entity_uid"), "details"))

    def load_config(self, path: str) -> None:
        self.configuration = Configuration.load(path)

    # -- ingest and inventory -------------------------------------------------------------------

    def ingest(self, path: str) -> DataFrame:
        """Read new files below ``path``; returns those that could not be read."""
        return self.add_records(dicom.read(self.spark, path, self.cohort.instances, self.codecs))

    def add_records(self, parsed: DataFrame, tag: str | None = None) -> DataFrame:
        """Append what parsed files (path, record) bring; returns those that could not be read.

        An instance that is known already, and a second file of one, brings nothing: no row, item or
        frame. Nothing that is stored is written anew. Rows under a ``tag`` are added once.
        """
        old = self.cohort
        stage = self.catalog.write("records", parsed)
        records = self.catalog.read("records", stage)
        new, frames = dicom.to_cohort(records, old.instances)
        keys = {"patients": "patient_id", "studies": "study_instance_uid", "series": "series_instance_uid"}
        come = {name: getattr(new, name).join(getattr(old, name).select(key), key, "left_anti") for name, key in keys.items()}
        come |= {"seq_items": new.seq_items, "frames": frames, "instances": new.instances}
        for name, rows in come.items():  # instances last: the others are worked out from those that were there
            self.catalog.append(name, rows, tag)
        found = dicom.errors(records)
        failed = self.catalog.read("failures", self.catalog.write("failures", found))
        self.catalog.drop("records")
        return failed

    def examine(self) -> DataFrame:
        return inventory.counts(self.cohort)

    def equipment(self) -> DataFrame:
        return inventory.equipment_counts(self.cohort)

    def get_cohort_report(self, expand_metadata: bool = False) -> DataFrame:
        return flatten.cohort_report(self.cohort, flatten.attribute_keys(self.cohort.instances) if expand_metadata else None)

    def export_dataframe(self, path: str = "export_metadata.csv", expand_metadata: bool = False) -> DataFrame:
        rows = self.get_cohort_report(expand_metadata)
        (rows.write.mode("overwrite").parquet if path.endswith(".parquet") else rows.write.mode("overwrite").option("header", True).csv)(path)
        return rows

    def export_to_parquet(self, path: str, patient_ids: list[str] | None = None) -> None:
        flatten.flatten(self.cohort, patient_ids).write.mode("overwrite").parquet(path)

    # -- privacy --------------------------------------------------------------------------------

    def audit(self, config: Configuration | str | None = None) -> DataFrame:
        config = Configuration.load(config) if isinstance(config, str) else config or self.configuration
        return audit.audit(self.cohort, config)

    scan_for_phi = audit

    def save_analysis(self, findings: DataFrame) -> None:
        self.catalog.append("findings", findings.withColumn("ts", F.current_timestamp()))

    def load_findings(self, latest: bool = False) -> DataFrame:
        """Saved findings, fit for ``anonymize``: all of them, or those of the last save."""
        saved = self.catalog.read("findings")
        if latest:
            saved = saved.join(F.broadcast(saved.agg(F.max("ts").alias("ts"))), "ts", "left_semi")
        return saved.select(*audit.COLUMNS, "ts")

    def anonymize(self, findings: DataFrame | None = None, stamp: str | None = "cohortlake privacy profile") -> DataFrame:
        """Carry out the proposals of ``findings``, or the whole policy; returns how many there were of each action.

        ``stamp`` names the method on each instance. Dates that no shift can move are logged as warnings.
        """
        before, given = self.cohort, findings is not None and not findings.isEmpty()
        stage = self.catalog.write("remediation_log", remediate.log_rows(findings if given else self.audit()))
        after = remediate.remediate(before, findings, self.configuration) if given else remediate.apply_policy(before, self.configuration)
        if stamp:
            after = after.map(instances=lambda df: df.withColumn("attributes", remediate.stamp_deidentified(F.col("attributes"), stamp)))
        self.save(after)
        rows = self.catalog.read("remediation_log", stage)
        self.record(rows)
        return rows.groupBy("action_type").agg(F.count("*").alias("n"))

    def enable_reversible_anonymization(self, key_path: str) -> None:
        self.key = identity.load_or_make_key(key_path)

    def lock_identities(self, patient_ids: list[str] | DataFrame | None = None, tags_to_lock: tuple[str, ...] = identity.DEFAULT_TAGS) -> None:
        """Seal the attributes of the patients named by a list or by the patient ids of a table, or of all.

        Ids that are no patients are logged as warnings.
        """
        ids = self.spark.createDataFrame([(p,) for p in patient_ids], "patient_id string") if isinstance(patient_ids, list | tuple) else patient_ids
        if ids is not None:
            missing = identity.missing_patients(self.cohort, ids.select("patient_id"))
            self.record(missing.select(F.lit("WARNING").alias("action_type"), F.col("patient_id").alias("entity_uid"), F.lit("no such patient to lock").alias("details")))
        self.catalog.write("instances", identity.lock(self.cohort, self._key(), ids, tuple(tags_to_lock)).instances)

    def recover_patient_identity(self, patient_id: str, restore: bool = False) -> dict | None:
        row = identity.recover(self.cohort, self._key()).filter(F.col("patient_id") == patient_id).first()
        if row is not None and row.original is not None and restore:
            self.save(identity.restore(self.cohort, self._key(), patient_id))
        return row.original if row is not None else None

    def _key(self) -> str:
        if self.key is None:
            raise RuntimeError("reversible anonymization is not enabled")
        return self.key

    # -- pixels ---------------------------------------------------------------------------------

    def preview_config(self) -> DataFrame:
        return zones.preview(self.cohort, self.configuration.zone_frame(self.spark))

    def redact(self, configuration: Configuration | None = None) -> DataFrame:
        """Fill all zones; returns (sop_instance_uid, original_uid) of the instances that changed.

        Only files of tables that hold a changed row are written anew, and the frames, the instances
        and their nested items get the new uid together.
        """
        config = configuration or self.configuration
        if not self.catalog.exists("frames"):
            return self.spark.createDataFrame([], "sop_instance_uid string, original_uid string")
        plan = zones.plan(self.cohort, config.zone_frame(self.spark)).withColumnRenamed("config_hash", "new_hash")
        due = plan.join(self.frames.select("sop_instance_uid", "config_hash"), "sop_instance_uid").filter(~F.col("new_hash").eqNullSafe(F.col("config_hash")))
        tasks = self.catalog.read("redaction_tasks", self.catalog.write("redaction_tasks", due.select("sop_instance_uid", "zones", F.col("new_hash").alias("config_hash"))))
        uid = F.col("sop_instance_uid")

        def fill(frames: DataFrame) -> DataFrame:
            return zones.redact(frames, tasks).withColumn("sop_instance_uid", F.when(F.col("redacted"), remediate.new_uid(uid)).otherwise(uid))

        self.catalog.update("frames", tasks.select("sop_instance_uid"), fill)
        changed = tasks.select(remediate.new_uid(uid).alias("sop_instance_uid"), uid.alias("original_uid")).join(self.frames.select("sop_instance_uid"), "sop_instance_uid", "left_semi")
        changed = self.catalog.read("redactions", self.catalog.write("redactions", changed))
        blank, old = empty(self.spark), changed.select(F.col("original_uid").alias("sop_instance_uid"))
        for name in ("instances", "seq_items"):
            self.catalog.update(name, old, lambda df, name=name: getattr(zones.mark_changed(replace(blank, **{name: df}), changed), name))
        self.record(changed.select(F.lit("REDACTION").alias("action_type"), F.col("sop_instance_uid").alias("entity_uid"), F.lit("zones filled").alias("details")))
        self.record(zones.risk_rows(self.catalog.read("instances")))
        return changed

    def redact_by_machine(self, serial_number: str, roi: list[float]) -> DataFrame:
        """Fill one zone on one machine's images, whatever the configuration says."""
        return self.redact(replace(self.configuration, rules=[{"serial_number": serial_number, "redaction_zones": [roi]}], path=None))

    def scan_pixel_content(self, regions: DataFrame, serial_number: str | None = None) -> DataFrame:
        """Leaks among OCR regions of machines that have zones."""
        rules = self.configuration.zone_frame(self.spark)
        seen = regions.join(rules.select("serial_number").distinct(), "serial_number", "left_semi")
        return zones.verify(seen.filter(F.col("serial_number") == serial_number) if serial_number else seen, rules)

    def auto_remediate_config(self, leaks: DataFrame) -> int:
        """Grow and add zones where text leaked; suggestions are per distinct box of a machine."""
        as_list = lambda z: None if z is None else [z.r1, z.r2, z.c1, z.c2]
        rows = zones.suggestions(leaks).distinct().orderBy("serial_number", "action", "new_zone").collect()
        done = zones.apply_suggestions(self.configuration.rules, [r.asDict() | {"original_zone": as_list(r.original_zone), "new_zone": as_list(r.new_zone)} for r in rows])
        self.configuration.save()
        return done

    def discover_redaction_zones(self, regions: DataFrame, serial_number: str, sample_size: int = discover.SAMPLE, min_confidence: float = 80.0) -> DataFrame:
        """Zones of text that returns on a machine's sampled images; ``regions`` come from an OCR engine."""
        own = self.cohort.instances.join(self.cohort.series.filter(F.col("device_serial_number") == serial_number).select("series_instance_uid"), "series_instance_uid")
        sample = discover.sample_instances(own.select("sop_instance_uid"), sample_size)
        n = sample.count()
        if not n:
            return self.spark.createDataFrame([], "serial_number string, cluster long, r1 int, r2 int, c1 int, c2 int, occurrence double, type string, examples array<string>, confidence double")
        seen = discover.confident(regions, min_confidence).join(sample, "sop_instance_uid", "left_semi")
        rows = seen.select(F.lit(serial_number).alias("serial_number"), F.col("sop_instance_uid").alias("source_index"), "text", "confidence", "x", "y", "w", "h", F.xxhash64("sop_instance_uid", "text", "x", "y", "w", "h").alias("candidate"), discover.classify_text(F.col("text")).alias("classification"))
        return discover.zones(discover.clusters(rows.dropDuplicates(["candidate"])), n)

    # -- export ---------------------------------------------------------------------------------

    def export(self, folder: str, safe: bool = False, subset: str | list[str] | DataFrame | None = None, patient_ids: list[str] | None = None, check: bool = False, redact: bool = True, compress: bool = False, fail_on_error: bool = False) -> DataFrame:
        """Write files; returns (path, error) rows. Level tables override the attribute maps.

        ``safe`` leaves out instances with a finding on them or an ancestor, ``check`` those that
        lack required attributes, which come back as errors. So do images without pixels, and pixels
        that are not those that were stored. ``redact`` fills zones that are due in what is written;
        ``compress`` stores pixels as RLE. ``fail_on_error`` raises once all files are tried.
        """
        cohort = self.cohort
        rows = flatten.safe_export(cohort, self.audit(), patient_ids) if safe else flatten.flatten(cohort, patient_ids)
        if subset is not None:
            full = flatten.cohort_report(cohort, flatten.attribute_keys(cohort.instances) if isinstance(subset, str) else None)
            chosen = flatten.subset_query(full, subset) if isinstance(subset, str) else flatten.subset_frame(full, subset) if isinstance(subset, DataFrame) else flatten.subset_ids(full, self.spark.createDataFrame([(x,) for x in subset], "id string"))
            rows = rows.join(chosen.select(F.col("SOPInstanceUID").alias("sop_instance_uid")), "sop_instance_uid", "left_semi")
        level = {"0010,0010": "patient_name", "0010,0020": "patient_id", "0008,0020": "study_date", "0020,000d": "study_instance_uid", "0020,000e": "series_instance_uid", "0008,0060": "modality", "0008,0018": "sop_instance_uid", "0008,0016": "sop_class_uid"}
        value = lambda c: F.date_format(c, "yyyyMMdd") if c == "study_date" else F.col(c)
        own = F.map_filter(F.create_map(*(x for k, c in level.items() for x in (F.lit(k), value(c)))), lambda k, v: v.isNotNull())
        merged = F.map_concat(F.map_filter("attributes", lambda k, v: ~k.isin(*level)), own)
        rows = rows.withColumn("attributes", merged).join(flatten.export_paths(cohort, folder), "sop_instance_uid")
        nested = cohort.seq_items.groupBy("sop_instance_uid").agg(F.collect_list(F.struct("item_path", "tag", "vr", "value")).alias("items"))
        frames = self.frames if self.catalog.exists("frames") else self.spark.createDataFrame([], dicom.FRAMES)
        frames = frames.withColumn("intact", catalog.is_intact())
        if redact and self.configuration.rules:
            frames = zones.redact(frames, zones.plan(cohort, self.configuration.zone_frame(self.spark)))
        rows = rows.join(nested, "sop_instance_uid", "left").join(frames.select("sop_instance_uid", "pixels", "bits", "rows", "cols", "samples", "frames", "intact"), "sop_instance_uid", "left")
        lacks = validate.missing_attributes(F.col("sop_class_uid"), F.col("attributes")) if check else F.array().cast("array<string>")
        refusal = F.when(~F.col("intact"), "pixels are not those that were stored").when(validate.lacks_pixels(F.col("modality"), F.col("pixels")), F.concat(F.lit("Pixels missing for Image Modality "), "modality")).when(F.size(lacks) > 0, F.array_join(lacks, "; "))
        rows = rows.withColumn("error", refusal)
        results = dicom.export(rows.filter("error is null"), compress).unionByName(rows.filter("error is not null").select("path", "error"))
        done = self.catalog.read("exports", self.catalog.write("exports", results))
        summary = inventory.export_summary(done).first()
        failed = done.filter("error is not null and not startswith(error, '[Type ')")  # a refused check is an answer, not a failure
        self.record(failed.select(F.lit("ERROR").alias("action_type"), F.lit(None).cast("string").alias("entity_uid"), F.lit("not exported").alias("details")))
        if fail_on_error and summary.n_failed:
            raise RuntimeError(f"{summary.n_failed} of {summary.n} files were not exported; first error: {summary.first_error}")
        return done

    def create_config(self, path: str, scripts: list[str] = (), rules: list[dict] = ()) -> str:
        """Write a configuration for the machines seen: known zones, warnings, tag defaults. Returns its text.

        What is known comes from rules by serial number (``rules``) and from pixel-anonymizer scripts
        by manufacturer and model (``scripts``, texts).
        """
        known = [r for text in scripts for r in ctp.parse_script(text)]
        serial = self.spark.createDataFrame([(i, r.get("serial_number", ""), r.get("manufacturer", ""), r.get("model_name", "")) for i, r in enumerate(rules)], "rule_pos int, serial_number string, manufacturer string, model_name string")
        named = self.spark.createDataFrame([(i, r["manufacturer"], r["model_name"]) for i, r in enumerate(known)], "rule_pos int, manufacturer string, model_name string")
        zones_of = {(k, i): r.get("redaction_zones", []) for k, some in ((1, rules), (2, known), (3, rules)) for i, r in enumerate(some)}
        text = report.scaffold(self.cohort, self.configuration, serial, named, zones_of)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return text

    def text_index(self) -> DataFrame:
        """Nested elements that hold text."""
        return dicom.text_index(self.cohort.seq_items)

    def generate_manifest(self, path: str, kind: str = "html") -> int:
        return report.write_manifest(self.cohort, path, kind)

    def generate_report(self, path: str) -> None:
        report.write_compliance_report(self.cohort, self.log, path)

    def compact(self) -> int:
        return self.catalog.compact()

    def subject_folders(self) -> DataFrame:
        return self.cohort.patients.select("patient_id", naming.subject_folder(F.col("patient_id")).alias("folder"))

    def close(self) -> None:
        """Nothing is held but the frames themselves."""
