"""Addresses, entities and time of day as column expressions.

IPv4 is done with integers on the JVM; IPv6 needs Python's ipaddress and is done in Arrow batches,
only where a text looks like IPv6.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IPV4_TOKEN = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
#: Fixed ranges that count as internal.
INTERNAL_RANGES = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "169.254.0.0/16",
    "127.0.0.0/8", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4",
)


@F.pandas_udf(T.StringType())
def _canonical_v6(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return str(ipaddress.IPv6Address(t)) if t is not None else None
        except ValueError:
            return None

    return texts.map(one)


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def looks_ipv6(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a number, or null."""
    part = F.split(ip, r"\.")
    return F.when(is_ipv4(ip), sum(part[i].cast("long") * (256 ** (3 - i)) for i in range(4)))


def is_valid_ip(text: Column, v6: bool = True) -> Column:
    if not v6:
        return is_ipv4(text)
    return is_ipv4(text) | F.when(looks_ipv6(text), _canonical_v6(text).isNotNull()).otherwise(False)


def normalize_ip(text: Column) -> Column:
    return F.when(is_ipv4(text), text).when(looks_ipv6(text), _canonical_v6(text))


def in_range(number: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr, strict=False)
    low = int(net.network_address)
    return (number >= low) & (number < low + net.num_addresses)


def is_internal_ip(ip: Column) -> Column:
    n = ipv4_number(ip)
    found = F.lit(False)
    for cidr in INTERNAL_RANGES:
        found = found | in_range(n, cidr)
    return F.coalesce(found, F.lit(False))


def is_public_ip(ip: Column) -> Column:
    return is_ipv4(ip) & ~is_internal_ip(ip)


def ip_in_subnet(ip: Column, cidr: str) -> Column:
    """False for what is no address, or if the subnet is none."""
    try:
        ipaddress.IPv4Network(cidr, strict=False)
    except ValueError:
        return F.lit(False)
    return F.coalesce(in_range(ipv4_number(ip), cidr), F.lit(False))


def extract_ips(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(IPV4_TOKEN), F.lit(1)), lambda t: t.rlike(IPV4))


def entity_type(entity: Column) -> Column:
    """ip, domain, user, process or host, by the shape of the text."""
    return (
        F.when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (F.contains(entity, F.lit(":")) & looks_ipv6(entity)), "ip")
        .when(F.contains(entity, F.lit(".")) & ~F.contains(entity, F.lit("@")), "domain")
        .when(F.contains(entity, F.lit("@")), "user")
        .when(F.contains(entity, F.lit("\\")), "process")
        .otherwise("host")
    )


def utc_hour(ts: Column) -> Column:
    """Hour of day of epoch milliseconds."""
    return F.pmod(F.floor(ts / 3_600_000), F.lit(24)).cast("int")


def in_business_hours(ts: Column) -> Column:
    return utc_hour(ts).between(8, 17)


def at_night(ts: Column) -> Column:
    """From 20 to 6 o'clock."""
    return (utc_hour(ts) >= 20) | (utc_hour(ts) < 6)


def score_tier(score: Column) -> Column:
    return F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.4, "medium").otherwise("low")


def score_colour(score: Column) -> Column:
    """The scale of colours."""
    return F.when(score > 0.7, "red").when(score > 0.4, "amber").otherwise("green")


def severity_tier(score: Column) -> Column:
    """The scale of chains' severity."""
    return F.when(score > 0.9, "critical").when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def priority_label(priority: Column) -> Column:
    out = F.lit("UNKNOWN")
    for p, name in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), 1):
        out = F.when(priority == p, name).otherwise(out)
    return out
