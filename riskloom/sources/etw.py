"""Windows event XML to unified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import event_uuid, unified
from .rules import addresses, iso_time, mapped, protocol

EVENT = r"(?s)<Event[ >].*?</Event>"
SHAPE = (
    "System struct<EventID: struct<_VALUE: string>, TimeCreated: struct<_SystemTime: string>, Computer: string, Level: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)
#: Fixed table of event ids.
EVENT_IDS = {
    "auth_failure": (4625, 4771, 4776),
    "auth_success": (4624, 4634, 4648, 4672, 4720, 4722, 4725, 4728, 4732, 4740, 4768, 4769, 4778, 4779, 4964),
    "process_create": (4688, 4689, 4697, 7045, 1, 4, 5, 8, 10, 17),
    "network_connect": (5156, 5157, 5158, 3, 18),
    "dns_query": (8003, 8018, 22),
    "file_create": (5137, 5142, 5145, 2, 6, 7, 9, 11),
    "file_delete": (5140,),
    "registry_modify": (5136, 12, 13, 14),
}
#: Severities of the levels.
LEVELS = {1: 10, 2: 8, 3: 5, 4: 3, 5: 1}
#: Protocols that are looked for.
PROTOCOLS = ("TCP", "UDP", "ICMP", "HTTP", "DNS", "TLS", "SMB", "RDP")
#: Fixed data field names, the first present one counts.
FIELDS = {
    "src_ip": ("IpAddress", "SourceAddress", "ClientAddress", "SourceIp"),
    "dst_ip": ("DestinationAddress", "DestAddress", "DestinationIp"),
    "src_port": ("SourcePort", "SrcPort"),
    "dst_port": ("DestinationPort", "DestPort"),
    "user": ("TargetUserName", "SubjectUserName"),
    "process_name": ("Image", "NewProcessName"),
    "process_id": ("ProcessId", "NewProcessId"),
    "domain": ("QueryName",),
}


def events_of(texts: DataFrame) -> DataFrame:
    """A row (value) for each <Event> in texts (value), of which there may be any number in one."""
    return texts.select(F.explode(F.regexp_extract_all("value", F.lit(EVENT), F.lit(0))).alias("value"))


def parse(lines: DataFrame, ingest_time: Column | None = None, sensor_id: str = "unknown") -> DataFrame:
    """lines or whole texts (value) to unified records; what has no well-formed event with a System part gives none."""
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    v, kind = F.col("value"), {i: k for k, ids in EVENT_IDS.items() for i in ids}
    bare = F.regexp_replace(v, r'\sxmlns="[^"]*"', "")
    df = events_of(lines).withColumn("e", F.from_xml(bare, SHAPE)).filter("e.System is not null")
    data = F.coalesce("e.EventData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>"))
    full = F.filter(data, lambda d: d["_Name"].isNotNull() & (F.coalesce(d["_VALUE"], F.lit("")) != ""))
    loose = F.filter(data, lambda d: d["_Name"].isNull() & d["_VALUE"].isNotNull())
    df = df.select(
        "value",
        F.col("e.System").alias("system"),
        full.alias("data"),
        F.array_join(F.transform(loose, lambda d: d["_VALUE"]), " ").alias("loose"),
        F.coalesce(F.col("e.System.EventID._VALUE").try_cast("int"), F.lit(0)).alias("number"),
    )

    def field(name):
        return F.coalesce(*[F.get(F.filter("data", lambda d: d["_Name"] == k), F.lit(0))["_VALUE"] for k in map(F.lit, FIELDS[name])])

    ips = addresses(F.col("loose"))
    said = F.get(F.filter("data", lambda d: d["_Name"] == "Protocol"), F.lit(0))["_VALUE"]
    every = F.concat_ws(" ", "loose", F.transform("data", lambda d: d["_VALUE"]))
    return unified(
        df,
        event_id=event_uuid(v),
        timestamp=iso_time(F.col("system.TimeCreated._SystemTime"), now),
        ingest_time=now,
        source_type=F.lit("etw"),
        sensor_id=F.coalesce("system.Computer", F.lit(sensor_id)),
        src_ip=F.coalesce(field("src_ip"), F.get(ips, F.lit(0))),
        dst_ip=F.coalesce(field("dst_ip"), F.when(field("src_ip").isNull(), F.get(ips, F.lit(1)))),
        src_port=field("src_port").try_cast("int"),
        dst_port=field("dst_port").try_cast("int"),
        proto=F.coalesce(said, protocol(every, PROTOCOLS)),
        event_type=mapped(F.col("number"), kind, "network_connect"),
        severity=mapped(F.coalesce(F.col("system.Level").try_cast("int"), F.lit(-1)), LEVELS, 3),
        user=field("user"),
        process_name=F.coalesce(field("process_name"), F.when(F.col("number") <= 22, "Sysmon")),
        process_id=field("process_id").try_cast("int"),
        domain=field("domain"),
        raw_message=v,
        tags=F.array(F.concat(F.lit("eventid:"), F.col("number").cast("string"))),
    )
