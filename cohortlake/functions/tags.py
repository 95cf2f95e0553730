"""Attribute tags as columns: "gggg,eeee" in lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Value representations that hold free text, names or dates.
TEXT_VRS = ("PN", "LO", "SH", "ST", "LT", "UT", "DA", "DT", "TM")
# Private tags that carry the engine's own identity tokens.
OWN_PRIVATE_TAGS = ("0099,0010", "0099,1001")

BURNED_IN = "0028,0301"
IMAGE_TYPE = "0008,0008"


def canonical(tag: str | Column) -> Column:
    return F.lower(F.trim(F.col(tag) if isinstance(tag, str) else tag))


def is_private(tag: Column) -> Column:
    """Odd group number, own tags excepted; malformed tags are not private."""
    odd = F.substring(tag, 4, 1).isin(*"13579bdfBDF")
    return odd & tag.rlike("^[0-9a-fA-F]{4},") & ~F.lower(tag).isin(*OWN_PRIVATE_TAGS)


def without_tags(attributes: Column, drop) -> Column:
    return F.map_filter(attributes, lambda k, v: ~drop(k, v))


def is_burned_in(attributes: Column) -> Column:
    """The flag contains YES in any case; an absent flag does not."""
    return F.coalesce(F.upper(attributes[BURNED_IN]).contains("YES"), F.lit(False))


def is_derived(attributes: Column) -> Column:
    """Some value of ImageType contains DERIVED."""
    return F.coalesce(F.upper(attributes[IMAGE_TYPE]).contains("DERIVED"), F.lit(False))
