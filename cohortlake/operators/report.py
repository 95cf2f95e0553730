"""Renderers: manifest, compliance report and configuration scaffold.

What they show is aggregated on the executors; rows of the manifest and exceptions of the report
are streamed to their files.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cohort import Cohort
from ..sources.policy import Configuration, TagPolicy
from . import inventory, zones
from .flatten import flatten

MANIFEST = ("patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid", "modality", "file_path")


def manifest_rows(cohort: Cohort) -> DataFrame:
    return flatten(cohort).select(*MANIFEST).orderBy("patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid")


def write_manifest(cohort: Cohort, path: str, kind: str = "html", project: str = "cohort") -> int:
    """A JSON or HTML manifest on the driver's disk; rows arrive partition by partition."""
    if kind not in ("html", "json"):
        raise ValueError(f"a manifest is html or json, not {kind}")
    rows, n = manifest_rows(cohort), 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html>\n<html><head><title>{html.escape(project)}</title></head><body><table>\n<tr>{''.join(f'<th>{c}</th>' for c in MANIFEST)}</tr>\n" if kind == "html" else f'{{"project": {json.dumps(project)}, "items": [\n')
        for row in rows.toLocalIterator(prefetchPartitions=True):
            values = ["" if v is None else str(v) for v in row]
            if kind == "html":
                f.write(f"<tr>{''.join(f'<td>{html.escape(v)}</td>' for v in values)}</tr>\n")
            else:
                f.write((",\n" if n else "") + json.dumps(dict(zip(MANIFEST, values, strict=True))))
            n += 1
        f.write(f"</table><p>{n} items</p></body></html>\n" if kind == "html" else f'\n], "total": {n}}}\n')
    return n


def compliance_lines(cohort: Cohort, log: DataFrame, title: str = "Compliance report") -> Iterator[str]:
    """Lines of Markdown: status, inventory, actions and all exceptions, without values of patients.

    Exceptions arrive partition by partition.
    """
    status = inventory.compliance(log).first()
    counts = {r.level: r.n for r in inventory.counts(cohort).collect()}
    actions = inventory.log_summary(log).orderBy(F.desc("n"), "action_type").collect()
    yield from [f"# {title}", "", f"**Status: {status.status}**", "", "## 1. Inventory", "", *(f"- {k}: {v}" for k, v in counts.items()), "", "## 2. Actions", "", "| Action | Count |", "|---|---|"]
    yield from (f"| {r.action_type} | {r.n} |" for r in actions)
    yield from ["", "## 3. Exceptions", "", f"{status.n_exceptions} in all, {status.n_risks} further risks."]
    for r in inventory.log_errors(log).toLocalIterator(prefetchPartitions=True):
        yield f"- {r.ts} {r.action_type} {r.entity_uid or ''}"
    yield from ["", "## 4. Method", "", "Rules, shifts and pseudonyms are deterministic; see the configuration for the policy in force."]


def compliance_report(cohort: Cohort, log: DataFrame, title: str = "Compliance report") -> str:
    """The report as one string, which has to fit into the driver; ``write_compliance_report`` streams it."""
    return "".join(f"{line}\n" for line in compliance_lines(cohort, log, title))


def write_compliance_report(cohort: Cohort, log: DataFrame, path: str, title: str = "Compliance report") -> None:
    """The report as a file on the driver's disk."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in compliance_lines(cohort, log, title))


#: Tags that a scaffold always lists, and what it does with them.
SCAFFOLD_TAGS = {"0008,0020": TagPolicy("Study Date", "JITTER"), "0010,0040": TagPolicy("Patient Sex", "KEEP"), "0010,1010": TagPolicy("Patient Age", "KEEP")}


def scaffold(cohort: Cohort, config: Configuration, serial_rules: DataFrame, named_rules: DataFrame, known_zones: dict[tuple[int, int], list]) -> str:
    """YAML for the machines that have no rule yet: zones of the best known rule, warnings, tag defaults.

    ``known_zones`` maps (priority, rule_pos) to zones. One row per machine reaches the driver.
    """
    import yaml

    machines = inventory.distinct_equipment(cohort).filter("device_serial_number <> ''")
    done = [r["serial_number"] for r in config.rules]
    missing = machines.filter(~F.col("device_serial_number").isin(done)) if done else machines
    best = {r.device_serial_number: (r.priority, r.rule_pos) for r in zones.knowledge_matches(missing, serial_rules, named_rules).collect()}
    flagged = {r.device_serial_number: r.n for r in inventory.burned_in_by_machine(cohort).collect()}
    tags = dict(config.phi_tags)
    for tag, policy in SCAFFOLD_TAGS.items():
        tags.setdefault(tag, policy)
    lines = ["# Machines without a rule are listed with what is known about them; check the zones.", "phi_tags:"]
    lines += [f'  "{t}": {{name: {json.dumps(p.name)}, action: {p.action}}}' for t, p in sorted(tags.items())]
    lines += ["date_jitter: {min_days: %d, max_days: %d}" % config.date_jitter, f"remove_private_tags: {str(config.remove_private_tags).lower()}", "machines:"]
    for rule in config.rules:
        lines += ["  - " + yaml.safe_dump(rule, default_flow_style=True, width=10_000).strip()]
    for r in missing.orderBy("device_serial_number").collect():
        if flagged.get(r.device_serial_number):
            lines.append(f"  # WARNING: {flagged[r.device_serial_number]} images say that they have burned-in annotations")
        zones_ = known_zones.get(best.get(r.device_serial_number, (0, 0)), [])
        row = {"serial_number": r.device_serial_number, "manufacturer": r.manufacturer or "", "model_name": r.model_name or "", "redaction_zones": zones_}
        lines.append("  - " + yaml.safe_dump(row, default_flow_style=True, sort_keys=False, width=10_000).strip())
    return "\n".join(lines) + "\n"
