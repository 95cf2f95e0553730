"""Privacy policies, machine rules and profiles from files or dicts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Tag, name and action of the basic de-identification profile.
BASIC_PROFILE = """
0010,0010 REMOVE Patient's Name
0010,0020 REMOVE Patient ID
0010,0030 REMOVE Patient's Birth Date
0010,0032 REMOVE Patient's Birth Time
0010,0040 REMOVE Patient's Sex
0010,1000 REMOVE Other Patient IDs
0010,1001 REMOVE Other Patient Names
0010,1040 REMOVE Patient's Address
0010,2160 REMOVE Ethnic Group
0010,4000 REMOVE Patient Comments
0008,0020 REMOVE Study Date
0008,0021 REMOVE Series Date
0008,0022 REMOVE Acquisition Date
0008,0023 REMOVE Content Date
0008,0030 REMOVE Study Time
0008,0031 REMOVE Series Time
0008,0032 REMOVE Acquisition Time
0008,0033 REMOVE Content Time
0008,0050 REMOVE Accession Number
0008,0090 REMOVE Referring Physician's Name
0008,1030 EMPTY Study Description
0008,103e EMPTY Series Description
0020,0010 REMOVE Study ID
0008,0080 REMOVE Institution Name
0008,0081 REMOVE Institution Address
0008,1040 REMOVE Institutional Department Name
0008,1050 REMOVE Performing Physician's Name
0008,1070 REMOVE Operators' Name
"""
# The tags of a policy where none is given.
DEFAULT_TAGS = {
    "0010,0010": "Patient Name",
    "0010,0020": "Patient ID",
    "0010,0030": "Patient Birth Date",
    "0008,0080": "Institution Name",
    "0008,0090": "Referring Physician Name",
    "0008,0050": "Accession Number",
}
ACTIONS = ("REMOVE", "EMPTY", "SHIFT", "JITTER", "KEEP", "REPLACE")


@dataclass(frozen=True)
class TagPolicy:
    name: str
    action: str = "REPLACE"
    replacement: str | None = None


def tag_policy(value: str | dict) -> TagPolicy:
    """A bare name means REPLACE; unknown actions count as REPLACE."""
    if isinstance(value, str):
        return TagPolicy(value)
    action = str(value.get("action", "REPLACE")).upper()
    return TagPolicy(value.get("name", "Unknown Tag"), action if action in ACTIONS else "REPLACE", value.get("replacement", value.get("value")))


def profile(name: str) -> dict[str, TagPolicy]:
    """A built-in profile, or the ``phi_tags`` of a file by that path."""
    if name == "basic":
        rows = (line.split(" ", 2) for line in BASIC_PROFILE.strip().splitlines())
        return {tag: TagPolicy(text, action) for tag, action, text in rows}
    if Path(name).suffix in (".yaml", ".yml") and Path(name).exists():
        return {k.lower(): tag_policy(v) for k, v in (_yaml(name).get("phi_tags") or {}).items()}
    raise ValueError(f"unknown privacy profile: {name}")


def _yaml(path: str) -> dict:
    import yaml

    if Path(path).suffix not in (".yaml", ".yml"):
        raise ValueError(f"configurations are .yaml or .yml files: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"Invalid YAML in {path}: {e}") from e


def check_rule(rule: dict, index: int = 0) -> None:
    """Raise ValueError unless the rule has a serial and well-formed zones [r1, r2, c1, c2]."""
    if not rule.get("serial_number"):
        raise ValueError(f"rule {index}: 'serial_number' is missing")
    zones = rule.get("redaction_zones", [])
    if not isinstance(zones, list):
        raise ValueError(f"rule {index}: 'redaction_zones' is not a list")
    for zone in zones:
        roi = zone.get("roi") if isinstance(zone, dict) else zone
        if not isinstance(roi, list | tuple) or len(roi) != 4:
            raise ValueError(f"rule {index}: a zone needs four values: {zone}")
        if any(not isinstance(x, int | float) or isinstance(x, bool) or x < 0 for x in roi):
            raise ValueError(f"rule {index}: zone values are numbers from 0 on: {zone}")
        if roi[0] > roi[1] or roi[2] > roi[3]:
            raise ValueError(f"rule {index}: a zone starts after its end: {zone}")


@dataclass
class Configuration:
    """Machine rules, tag policy and options; edits return or raise, and save if there is a path."""

    rules: list[dict] = field(default_factory=list)
    phi_tags: dict[str, TagPolicy] = field(default_factory=dict)
    date_jitter: tuple[int, int] = (-365, -1)
    remove_private_tags: bool = True
    path: str | None = None

    @classmethod
    def load(cls, path: str) -> Configuration:
        """A unified file: privacy_profile, phi_tags over it, machines, date_jitter, remove_private_tags."""
        return cls.from_dict(_yaml(path), path)

    @classmethod
    def from_dict(cls, data: dict, path: str | None = None) -> Configuration:
        tags = profile(data["privacy_profile"]) if data.get("privacy_profile") else {}
        tags |= {k.lower(): tag_policy(v) for k, v in (data.get("phi_tags") or {}).items()}
        rules = data.get("machines") or data.get("machine_rules") or []
        for i, rule in enumerate(rules):
            check_rule(rule, i)
        jitter = data.get("date_jitter", {"min_days": -365, "max_days": -1})
        span = (jitter, jitter) if isinstance(jitter, int) else (jitter.get("min_days", -365), jitter.get("max_days", -1))
        return cls(list(rules), tags, span, data.get("remove_private_tags", True), path)

    @classmethod
    def default(cls) -> Configuration:
        return cls(phi_tags={k: TagPolicy(v) for k, v in DEFAULT_TAGS.items()})

    def rule(self, serial: str) -> dict | None:
        return next((r for r in self.rules if r.get("serial_number") == serial), None)

    def add_rule(self, serial_number: str, manufacturer: str = "", model: str = "", zones: list | None = None) -> None:
        """A rule for a machine; replaces one with the same serial."""
        rule = {"serial_number": serial_number, "manufacturer": manufacturer, "model_name": model, "redaction_zones": zones or []}
        check_rule(rule, len(self.rules))
        self.rules = [r for r in self.rules if r.get("serial_number") != serial_number] + [rule]
        self.save()

    def update_rule(self, serial_number: str, updates: dict) -> None:
        rule = self.rule(serial_number)
        if rule is None:
            raise ValueError(f"no rule for {serial_number}")
        if updates.get("serial_number", serial_number) != serial_number:
            raise ValueError("a rule's serial number can't change")
        check_rule(rule | updates)
        rule.update(updates)
        self.save()

    def delete_rule(self, serial_number: str) -> bool:
        kept = [r for r in self.rules if r.get("serial_number") != serial_number]
        found, self.rules = len(kept) < len(self.rules), kept
        self.save()
        return found

    def set_phi_tag(self, tag: str, action: str, replacement: str | None = None) -> None:
        self.phi_tags[tag.lower()] = TagPolicy("Custom Tag", action.upper(), replacement)
        self.save()

    def to_dict(self) -> dict:
        tags = {k: {"name": t.name, "action": t.action} | ({"replacement": t.replacement} if t.replacement is not None else {}) for k, t in self.phi_tags.items()}
        return {"version": "2.0", "phi_tags": tags, "date_jitter": dict(zip(("min_days", "max_days"), self.date_jitter, strict=True)), "remove_private_tags": self.remove_private_tags, "machines": self.rules}

    def save(self) -> None:
        if self.path:
            import yaml

            with open(self.path, "w", encoding="utf-8") as f:
                yaml.safe_dump(self.to_dict(), f, sort_keys=False)

    def policy_frame(self, spark: SparkSession) -> DataFrame:
        """(tag, name, action, replacement): a few rows that the driver holds anyway."""
        return spark.createDataFrame([(k, t.name, t.action, t.replacement) for k, t in self.phi_tags.items()], "tag string, name string, action string, replacement string")

    def zone_frame(self, spark: SparkSession) -> DataFrame:
        """(serial_number, rule_pos, zone_pos, r1, r2, c1, c2) of all rules."""
        return spark.createDataFrame([(r["serial_number"], i, j, *map(float, zone["roi"] if isinstance(zone, dict) else zone)) for i, r in enumerate(self.rules) for j, zone in enumerate(r.get("redaction_zones", []))], "serial_number string, rule_pos int, zone_pos int, r1 double, r2 double, c1 double, c2 double")


def load_json_tags(path: str) -> dict[str, TagPolicy]:
    """Tag policies from a JSON file with a ``phi_tags`` object, or the object itself."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k.lower(): tag_policy(v) for k, v in data.get("phi_tags", data).items()}
