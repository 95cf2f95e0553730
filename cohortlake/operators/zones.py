"""Redaction zones: machine rules, planning, pixel filling, OCR coverage and suggestions.

A zone is (r1, r2, c1, c2) in rows and columns. OCR boxes are (x, y, w, h); they are turned into
zones at the edge, so one convention holds everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import is_burned_in
from ..plans.cohort import Cohort
from .remediate import new_uid, stamp_redacted

WILDCARD = "*"
SAFE_COVERAGE = 0.80
MIN_CONFIDENCE = 80.0
MIN_TEXT = 3


def matched_rules(machines: DataFrame, rules: DataFrame) -> DataFrame:
    """(device_serial_number, rule columns): exact serials, and a wildcard rule with every serial.

    The wildcard's cross side is the configuration's rows alone, the exact side an equi join.
    """
    known = machines.filter("device_serial_number <> ''").select("device_serial_number").distinct()
    exact = known.join(F.broadcast(rules), known.device_serial_number == rules.serial_number)
    every = known.join(F.broadcast(rules.filter(F.col("serial_number") == WILDCARD)))
    return exact.unionByName(every)


def first_rule(machines: DataFrame, rules: DataFrame) -> DataFrame:
    """The exact rule that comes first, one row per machine that has one."""
    rank = F.row_number().over(Window.partitionBy("serial_number").orderBy("rule_pos"))
    first = rules.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    known = machines.select("device_serial_number").distinct()
    return known.join(F.broadcast(first), known.device_serial_number == first.serial_number)


def plan(cohort: Cohort, zones: DataFrame) -> DataFrame:
    """(sop_instance_uid, device_serial_number, zones, config_hash): one task per instance.

    All zones of an instance are gathered first, so its pixels are filled in one pass.
    """
    per_machine = matched_rules(cohort.series, zones).groupBy("device_serial_number").agg(
        F.array_sort(F.collect_set(F.struct("r1", "r2", "c1", "c2"))).alias("zones")
    )
    hashed = per_machine.withColumn("config_hash", F.md5(F.to_json(F.struct("device_serial_number", "zones")).cast("binary")))
    series = cohort.series.select("series_instance_uid", "device_serial_number").join(hashed, "device_serial_number")
    return cohort.instances.select("sop_instance_uid", "series_instance_uid").join(series, "series_instance_uid").select("sop_instance_uid", "device_serial_number", "zones", "config_hash")


def preview(cohort: Cohort, rules: DataFrame) -> DataFrame:
    """(serial_number, n_images) of each rule; nothing is changed. Wildcards count nothing here."""
    per_series = cohort.instances.groupBy("series_instance_uid").agg(F.count("*").alias("n"))
    images = cohort.series.join(per_series, "series_instance_uid").groupBy("device_serial_number").agg(F.sum("n").alias("n_images"))
    return rules.select("serial_number").distinct().join(images, F.col("serial_number") == F.col("device_serial_number"), "left").select("serial_number", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def fill_vector(values: Column, rows: int, cols: int, zones: list[tuple[float, float, float, float]]) -> Column:
    """A row-major array with all zones set to zero, as an expression."""
    hit = F.lit(False)
    boxes = []
    for r1, r2, c1, c2 in zones:
        r1, r2, c1, c2 = (int(x) for x in (r1, r2, c1, c2))
        if r1 < rows and c1 < cols:
            boxes.append((r1, min(r2, rows), c1, min(c2, cols)))

    def at(x: Column, i: Column) -> Column:
        row, col = (i / cols).cast("int"), i % cols
        inside = hit
        for r1, r2, c1, c2 in boxes:
            inside = inside | ((row >= r1) & (row < r2) & (col >= c1) & (col < c2))
        return F.when(inside, F.lit(0).cast("float")).otherwise(x)

    return F.transform(values, at) if boxes else values


def fill_array(pixels: np.ndarray, zones: list[tuple[float, float, float, float]]) -> tuple[np.ndarray, bool]:
    """A copy with all zones zero, and whether any lay inside. The last axis may be colour."""
    colour = pixels.ndim >= 3 and pixels.shape[-1] in (3, 4)
    rows, cols = pixels.shape[-3:-1] if colour else pixels.shape[-2:]
    out, any_in = pixels.copy(), False
    for zone in zones:
        r1, r2, c1, c2 = (int(x) for x in zone)
        if 0 <= r1 < rows and 0 <= c1 < cols:
            window = (Ellipsis, slice(r1, min(r2, rows)), slice(c1, min(c2, cols)))
            out[(*window, slice(None)) if colour else window] = 0
            any_in = True
    return out, any_in


def frame_shape(row: dict) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a stored frame block: [frames,] rows, cols [, samples]."""
    shape: tuple[int, ...] = (row["rows"], row["cols"])
    if row["samples"] > 1:
        shape = (*shape, row["samples"])
    if row["frames"] > 1:
        shape = (row["frames"], *shape)
    return shape, np.dtype(f"{'<' if row['bits'] > 8 else '|'}{'i' if row['pixel_repr'] else 'u'}{row['bits'] // 8}")


def _fill_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for frames, zones in batches:
        pixels, hit = [], []
        for row, boxes in zip(frames.to_pylist(), zones.to_pylist(), strict=True):
            shape, kind = frame_shape(row)
            size = int(np.prod(shape))
            array = np.frombuffer(row["pixels"], kind, size).reshape(shape)
            out, any_in = fill_array(array, [(z["r1"], z["r2"], z["c1"], z["c2"]) for z in boxes])
            pixels.append(out.tobytes())
            hit.append(any_in)
        yield pa.StructArray.from_arrays([pa.array(pixels, pa.binary()), pa.array(hit)], ["pixels", "applied"])


FRAME = ("rows", "cols", "samples", "frames", "bits", "pixel_repr", "pixels")


def redact(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """``frames`` with all zones of each instance filled, in one pass over its pixels.

    Frames without a task, or already filled under the same configuration, never reach Python.
    """
    planned = frames.join(tasks.select("sop_instance_uid", "zones", F.col("config_hash").alias("_new_hash")), "sop_instance_uid", "left")
    due = F.col("zones").isNotNull() & ~F.col("_new_hash").eqNullSafe(F.col("config_hash"))
    rest = planned.filter(~due).select(*frames.columns, F.lit(False).alias("redacted"))
    fill = F.arrow_udf(_fill_batches, "struct<pixels: binary, applied: boolean>").asNondeterministic()
    done = planned.filter(due).withColumn("_out", fill(F.struct(*FRAME), F.col("zones")))
    changed = done.withColumns({"pixels": F.col("_out.pixels"), "pixel_hash": F.sha2(F.col("_out.pixels"), 256), "config_hash": F.col("_new_hash"), "redacted": F.col("_out.applied")})
    return changed.select(*frames.columns, "redacted").unionByName(rest)


def mark_redacted(instances: DataFrame, frames: DataFrame) -> DataFrame:
    """Instances whose pixels changed get the stamps, a new uid and their old one beside it."""
    hit = frames.filter("redacted").select(F.col("sop_instance_uid").alias("_hit")).distinct()
    met = instances.join(hit, F.col("sop_instance_uid") == F.col("_hit"), "left")
    changed = F.col("_hit").isNotNull()
    return met.withColumns({
        "attributes": F.when(changed, stamp_redacted(F.col("attributes"))).otherwise(F.col("attributes")),
        "original_uid": F.when(changed, F.col("sop_instance_uid")),
        "sop_instance_uid": F.when(changed, new_uid(F.col("sop_instance_uid"))).otherwise(F.col("sop_instance_uid")),
        "file_path": F.when(~changed, F.col("file_path")),
    }).drop("_hit")


def rekeyed(table: DataFrame, changed: DataFrame) -> DataFrame:
    """A table whose rows carry an instance's uid, with the new uids of ``changed`` (original_uid, sop_instance_uid)."""
    new = changed.select(F.col("original_uid").alias("_old"), F.col("sop_instance_uid").alias("_new"))
    met = table.join(new, F.col("sop_instance_uid") == F.col("_old"), "left")
    return met.withColumn("sop_instance_uid", F.coalesce("_new", "sop_instance_uid")).select(table.columns)


def mark_changed(cohort: Cohort, changed: DataFrame) -> Cohort:
    """The cohort after its pixels changed: stamps and new uids on the instances, and the uids of all that hangs on them."""
    hit = changed.select(F.col("original_uid").alias("sop_instance_uid"), F.lit(True).alias("redacted"))
    instances = mark_redacted(cohort.instances, hit).select(cohort.instances.columns)
    return replace(cohort, instances=instances, seq_items=rekeyed(cohort.seq_items, changed) if cohort.seq_items is not None else None)


def risk_rows(instances: DataFrame) -> DataFrame:
    """Audit-log rows for burned-in flags that were left untreated."""
    return instances.filter(is_burned_in(F.col("attributes"))).select(F.lit("RISK").alias("action_type"), F.col("sop_instance_uid").alias("entity_uid"), F.lit("burned-in annotation not treated").alias("details"))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (x, y, w, h) share."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0)


def coverage(regions: DataFrame, zones: DataFrame) -> DataFrame:
    """Regions (serial_number, text, x, y, w, h, ...) with the share of their area in the best zone.

    Adds coverage and best_zone (r1, r2, c1, c2), the first zone among the best. Zones come from the
    configuration and are gathered per machine; a region then needs no join with each of them.
    """
    per_machine = zones.groupBy("serial_number").agg(F.array_sort(F.collect_list(F.struct("rule_pos", "zone_pos", "r1", "r2", "c1", "c2"))).alias("_zones"))
    box = {k: F.col(k) for k in ("x", "y", "w", "h")}
    area = F.col("w") * F.col("h")
    scored = F.transform(
        "_zones",
        lambda z: F.struct(
            F.when(area > 0, overlap(box, {"x": z.c1, "y": z.r1, "w": z.c2 - z.c1, "h": z.r2 - z.r1}) / area).otherwise(0.0).alias("coverage"),
            (-z.rule_pos).alias("a"), (-z.zone_pos).alias("b"), F.struct(z.r1.alias("r1"), z.r2.alias("r2"), z.c1.alias("c1"), z.c2.alias("c2")).alias("zone"),
        ),
    )
    best = regions.join(F.broadcast(per_machine), "serial_number", "left").withColumn("_best", F.array_max(scored))
    met = F.col("_best.coverage") > 0
    return best.withColumn("coverage", F.coalesce("_best.coverage", F.lit(0.0))).withColumn("best_zone", F.when(met, F.col("_best.zone"))).drop("_zones", "_best")


def verify(regions: DataFrame, zones: DataFrame) -> DataFrame:
    """Leaks: text that its best zone covers less than four fifths; very short text is noise."""
    text = F.trim(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    leaks = coverage(regions, zones).withColumn("text", text).filter((F.length("text") >= MIN_TEXT) & (F.col("coverage") < SAFE_COVERAGE))
    partial = F.col("coverage") > 0
    words = F.when(partial, "Partial Leak").otherwise("New Leak (Uncovered)")
    return leaks.withColumn("leak_type", F.when(partial, "PARTIAL_LEAK").otherwise("NEW_LEAK")).withColumn("reason", F.format_string("%s (Cov: %.2f)", words, F.rint(F.col("coverage") * 100) / 100))


def is_covered(text_box: dict[str, Column], zone: dict[str, Column], threshold: float = 0.5) -> Column:
    area = text_box["w"] * text_box["h"]
    return F.when(area > 0, overlap(text_box, zone) / area >= threshold).otherwise(False)


def suggestions(leaks: DataFrame) -> DataFrame:
    """(serial_number, action, original_zone, new_zone): grow the best zone, or add the text's box."""
    whole = lambda c: c.cast("int")
    own = {"r1": F.col("y"), "r2": F.col("y") + F.col("h"), "c1": F.col("x"), "c2": F.col("x") + F.col("w")}
    old = {k: F.col(f"best_zone.{k}") for k in own}
    grown = F.struct(*(whole((F.least if k[1] == "1" else F.greatest)(own[k], old[k])).alias(k) for k in own))
    added = F.struct(*(whole(c).alias(k) for k, c in own.items()))
    partial = F.col("leak_type") == "PARTIAL_LEAK"
    return leaks.filter("serial_number is not null").select(
        "serial_number",
        F.when(partial, "EXPAND_ZONE").otherwise("ADD_ZONE").alias("action"),
        F.when(partial, F.col("best_zone")).alias("original_zone"),
        F.when(partial, grown).otherwise(added).alias("new_zone"),
    )


def apply_suggestions(rules: list[dict], rows: list[dict]) -> int:
    """Edit configuration rules in order; later suggestions see earlier edits. Returns how many applied."""
    done = 0
    for row in rows:
        rule = next((r for r in rules if r["serial_number"] == row["serial_number"]), None)
        if rule is None:
            continue
        zones = rule.setdefault("redaction_zones", [])
        if row["action"] == "ADD_ZONE" and row["new_zone"] not in zones:
            zones.append(row["new_zone"])
            done += 1
        elif row["action"] == "EXPAND_ZONE" and row["original_zone"] in zones:
            zones[zones.index(row["original_zone"])] = row["new_zone"]
            done += 1
    return done


def knowledge_matches(machines: DataFrame, serial_rules: DataFrame, named_rules: DataFrame) -> DataFrame:
    """The best known rule per machine: its serial, else manufacturer and model contained, else the model.

    Rule tables are packaged or configured resources: ``rule_pos`` orders them, and they are what is
    broadcast for the containment test. (manufacturer, model_name, device_serial_number, priority, rule_pos)
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    m = machines.filter("device_serial_number <> ''").dropDuplicates(["device_serial_number"])
    s, n = serial_rules.alias("s"), named_rules.alias("n")
    keep = [F.col(f"m.{c}") for c in ("manufacturer", "model_name", "device_serial_number")]
    m = m.alias("m")
    by_serial = m.join(F.broadcast(s), F.col("m.device_serial_number") == F.col("s.serial_number")).select(*keep, F.lit(1).alias("priority"), "s.rule_pos")
    named = (F.col("n.manufacturer") != "") & (F.col("n.model_name") != "") & F.contains(low(F.col("m.manufacturer")), low(F.col("n.manufacturer"))) & F.contains(low(F.col("m.model_name")), low(F.col("n.model_name")))
    by_name = m.join(F.broadcast(n), named).select(*keep, F.lit(2).alias("priority"), "n.rule_pos")
    maker = F.col("s.manufacturer").isNull() | (F.col("s.manufacturer") == "") | (F.col("s.manufacturer") == F.col("m.manufacturer"))
    by_model = m.join(F.broadcast(s), (F.col("m.model_name") == F.col("s.model_name")) & maker).select(*keep, F.lit(3).alias("priority"), "s.rule_pos")
    rank = F.row_number().over(Window.partitionBy("device_serial_number").orderBy("priority", "rule_pos"))
    return by_serial.unionByName(by_name).unionByName(by_model).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
