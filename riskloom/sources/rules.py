"""Building blocks of the line parsers: ordered rules as CASE expressions, first matches, safe casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.net import IPV4_TOKEN


def first_of(rules: list[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def has_any(text: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def mapped(key: Column, table: dict, default) -> Column:
    """Lookup in a small fixed table, with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default if isinstance(default, Column) else F.lit(default))


def group(text: Column, pattern: str, n: int) -> Column:
    """Group n of the first match, null where it is empty or there is none."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4_TOKEN), F.lit(1))


def valid_port(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n.between(1, 65535), n)


def protocol(text: Column, names: tuple[str, ...]) -> Column:
    upper = F.upper(text)
    return first_of([(F.contains(upper, F.lit(p)), p) for p in names], F.lit(None).cast("string"))


def iso_time(text: Column, otherwise: Column) -> Column:
    """An ISO 8601 time (UTC unless it says otherwise, whatever the session's zone), or the other time."""
    own = text.rlike(r"(?i)(Z|UTC|GMT|[+-]\d\d?:?\d\d|\d[+-]\d\d)$") & ~text.rlike(r"^\d{4}-\d\d-\d\d$")
    return F.coalesce(F.when(own, text.try_cast("timestamp")).otherwise(utc(text.try_cast("timestamp_ntz"))), otherwise)


def utc(naive: Column) -> Column:
    """A time without a zone as one of UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")


def in_utc(text: Column, pattern: str) -> Column:
    """A time of UTC written in a pattern; null if it isn't."""
    zone = F.concat(text, F.lit(" +0000"))
    return F.try_to_timestamp(zone, F.lit(pattern + " xx"))
