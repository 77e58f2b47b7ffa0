"""DNS query logs (BIND, Unbound, Windows debug, anything else) to unified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import event_uuid, unified
from .rules import addresses, first_of, group, has_any, in_utc, iso_time, mapped

DOMAIN = r"(?i)\b((?:[a-z0-9][-a-z0-9]*\.)+[a-z]{2,})\b"
#: Reply codes by number.
RCODES = ("NOERROR", "FORMERR", "SERVFAIL", "NXDOMAIN", "NOTIMP", "REFUSED", "YXDOMAIN", "YXRRSET", "NXRRSET", "NOTAUTH", "NOTZONE")


def word(i: int | Column) -> Column:
    """A field of the line by its place, from 0; null if there is none."""
    return F.get("words", F.lit(i) if isinstance(i, int) else i)


def origin(text: Column) -> tuple[Column, Column]:
    """Address and port of a client written with a hash sign between them."""
    text = F.rtrim(text, F.lit(":"))
    return F.substring_index(text, "#", 1), F.when(F.contains(text, F.lit("#")), F.substring_index(text, "#", -1))


def after_keyword(v: Column) -> Column:
    """What follows the colon after the word query, or view if there is none."""
    tail = F.coalesce(*[F.when(F.contains(v, F.lit(k)), F.substr(v, F.instr(v, k))) for k in ("query", "view")])
    return F.when(F.contains(tail, F.lit(":")), F.ltrim(F.substr(tail, F.instr(tail, ":") + 1)))


def parse(lines: DataFrame, ingest_time: Column | None = None, sensor_id: str = "unknown") -> DataFrame:
    """lines (value) to unified records; blank lines and comments are skipped. The line's own time is used if it has one.

    Fields are read by their place between blanks and by keywords. BIND with query logging: day, time, `queries:`, `info:`, `client`, an
    object's address if any, client, name in parentheses, `query:`, name, `IN`, type. BIND in short: `client`, client, then the name after
    `query:`. Unbound: epoch time in brackets, process, level, reply code, two fields, client, type, name. Windows: fields between tabs.
    """
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    v = F.col("value")
    df = lines.select(F.trim("value", F.lit(" \t\r\n")).alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    field = F.split(v, "\t")
    df = df.withColumn("words", F.split(v, r"\s+")).withColumn("tail", F.split(after_keyword(v), r"\s+", 2))
    at = F.when(word(5).startswith("@"), 6).otherwise(5)  # where BIND names the client
    bind = (word(2) == "queries:") & (word(3) == "info:") & (word(4) == "client") & (word(at + 2) == "query:") & (word(at + 4) == "IN") & word(at + 5).isNotNull()
    client = F.array_position("words", "client").cast("int")
    short = (client > 0) & (F.size("tail") == 2) & (F.instr(v, "client") < F.instr(v, F.element_at("tail", 1)))
    unbound = word(0).startswith("[") & word(1).startswith("unbound[") & word(2).endswith(":") & F.contains(word(6), F.lit(".")) & word(8).isNotNull()
    # a name's own text may hold a keyword: the longer formats are looked for first
    form = first_of([(bind, "bind"), (unbound, "unbound"), (F.size(field) >= 8, "windows"), (short, "short")], "other")
    df = df.withColumn("form", form)
    df = df.select("value", "form", "words", "tail", at.alias("place"), client.alias("client"))
    (host, host_port), (near, near_port) = origin(word(F.col("place"))), origin(word(F.col("client")))
    at = lambda **by: first_of([(F.col("form") == f, c) for f, c in by.items()], F.lit(None).cast("string"))
    upper = F.upper(v)
    code = field[4]
    known = mapped(code.try_cast("int"), dict(enumerate(RCODES)), code)
    said = word(3)
    rcode = at(
        unbound=F.when(F.lower(said).isin("nxdomain", "servfail", "noerror", "refused"), F.upper(said)),
        windows=F.when(code.rlike(r"^\d+$"), known).otherwise(code),
        other=first_of([(has_any(upper, "NXDOMAIN"), "NXDOMAIN"), (has_any(upper, "SERVFAIL"), "SERVFAIL")], F.lit(None).cast("string")),
    )
    dated = at(bind=F.concat_ws(" ", word(0), word(1)))
    time = F.coalesce(
        in_utc(dated, "dd-MMM-yyyy HH:mm:ss.SSS"),
        F.timestamp_seconds(at(unbound=F.trim(word(0), F.lit("[]"))).try_cast("long")),
        F.when(F.col("form") == "windows", iso_time(field[0], now)),
        now,
    )
    return unified(
        df,
        event_id=event_uuid(v),
        timestamp=time,
        ingest_time=now,
        source_type=F.lit("dns"),
        sensor_id=F.lit(sensor_id),
        src_ip=at(bind=host, short=near, unbound=word(6), windows=field[1], other=F.get(addresses(v), F.lit(0))),
        src_port=at(bind=host_port, short=near_port).try_cast("int"),
        proto=F.lit("DNS"),
        event_type=F.lit("dns_query"),
        severity=F.lit(3),
        domain=at(bind=word(F.col("place") + 3), short=F.element_at("tail", 1), unbound=word(8), windows=field[2], other=group(v, DOMAIN, 1)),
        dns_rcode=rcode,
        dns_rdata=at(bind=word(F.col("place") + 5), unbound=word(7), windows=field[3]),
        raw_message=v,
        tags=F.when(rcode == "NXDOMAIN", F.array(F.lit("nxdomain"))).otherwise(F.array().cast("array<string>")),
    )
