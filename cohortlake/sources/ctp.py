"""Pixel-anonymizer scripts: blocks of a condition in braces and regions (x, y, w, h)."""

from __future__ import annotations

import re

_BLOCK = re.compile(r"\{(?P<condition>[^{}]*)\}(?P<zones>(?:\s*\([^()]*\))*)")
_ZONE = re.compile(r"\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)")
_NAMED = r'{}\.(?:contains|containsIgnoreCase|equals|equalsIgnoreCase|startsWith|startsWithIgnoreCase)\("([^"]*)"\)'


def parse_script(text: str) -> list[dict]:
    """Rules with zones [r1, r2, c1, c2]; blocks without zones, or without maker and model, drop out."""
    text = re.sub(r"(?m)^\s*(//|#).*$", "", text)
    rules = []
    for block in _BLOCK.finditer(text):
        zones = [[y, y + h, x, x + w] for x, y, w, h in (map(int, z) for z in _ZONE.findall(block["zones"]))]
        maker = re.search(_NAMED.format("Manufacturer"), block["condition"])
        model = re.search(_NAMED.format("ManufacturerModelName"), block["condition"])
        if zones and (maker or model):
            rules.append({"manufacturer": maker[1] if maker else "Unknown", "model_name": model[1] if model else "Unknown", "redaction_zones": zones, "condition": " ".join(block["condition"].split())})
    return rules
