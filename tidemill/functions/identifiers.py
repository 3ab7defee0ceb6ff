"""UUID texts and column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def free_prefix(columns: list[str]) -> str:
    """A prefix for helper columns that no given column starts with."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


_H = "[0-9a-fA-F]"
_DASHED = f"{_H}{{8}}-{_H}{{4}}-{_H}{{4}}-{_H}{{4}}-{_H}{{12}}"
#: The spellings the event contract accepts: dashed, bare, in braces, and as a URN (its prefix in lower case).
UUID_SPELLINGS = rf"^(?:(?:urn:uuid:)?{_DASHED}|{_H}{{32}}|\{{{_DASHED}\}})\z"


def uuid_hex(text: Column) -> Column:
    """The 32 lower-case digits of a UUID in any accepted spelling, else null."""
    digits = F.regexp_replace(F.translate(F.lower(text), "{}-", ""), "^urn:uuid:", "")
    return F.when(text.rlike(UUID_SPELLINGS), digits)


def uuid_bytes(text: Column) -> Column:
    """Sixteen bytes for any accepted spelling, else null: what travels through a shuffle."""
    return F.unhex(uuid_hex(text))


def dashed(digits: Column) -> Column:
    """32 digits to the dashed form."""
    return F.concat_ws(
        "-", *(F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )


def uuid_text(raw: Column) -> Column:
    """Sixteen bytes back to lower-case dashed text; null stays null."""
    return F.when(raw.isNotNull(), dashed(F.lower(F.hex(raw))))


def canonical_uuid(text: Column) -> Column:
    """Lower-case dashed form of any accepted spelling, else null."""
    digits = uuid_hex(text)
    return F.when(digits.isNotNull(), dashed(digits))


def hash_bucket(text: Column, buckets: int) -> Column:
    """A bucket from 0 by the first eight bytes of the text's SHA-256 as an unsigned number; null stays null."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % buckets).cast("int")
