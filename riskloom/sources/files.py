"""Reading log files and normalised tables, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_SCHEMA, with_ts_ms
from .registry import get_parser


def read_lines(spark: SparkSession, path: str, pattern: str = "*.{log,txt}") -> DataFrame:
    """(value) of every line that is not blank, below path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    if pattern == "*":  # any name but those of tables
        df = df.filter(~F.lower(F.col("_metadata.file_name")).rlike(r"\.(parquet|json)$"))
    return df.select("value").filter(F.trim("value") != "")


def read_events(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(value) of every <Event> element below path, over however many lines, as one line each."""
    end = "</Event>"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", end).text(path)
    one = F.regexp_replace("value", r"\s*[\r\n]+\s*", " ")
    return df.select(F.concat(F.regexp_extract(one, r"(<Event[\s>].*)$", 1), F.lit(end)).alias("value")).filter(F.col("value") != end)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Normalised records below path, with ts_ms."""
    return with_ts_ms(spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path))


def has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("binaryFile").load(path)
    return not df.select("path").isEmpty()


def load(spark: SparkSession, path: str, kind: str = "syslog") -> DataFrame:
    """Parquet below path if there is any, else the first of *.log, *.txt, * that has lines, parsed."""
    if has_files(spark, path, "*.parquet"):
        return read_logs(spark, path)
    for pattern in ("*.log", "*.txt", "*"):
        if has_files(spark, path, pattern):
            lines = read_lines(spark, path, pattern)
            if kind == "etw" and not lines.filter(F.contains("value", F.lit("<Event"))).isEmpty():
                lines = read_events(spark, path, pattern)
            return with_ts_ms(get_parser(kind)(lines))
    return with_ts_ms(spark.createDataFrame([], LOG_SCHEMA))


def from_text(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """Pasted lines, parsed."""
    lines = spark.createDataFrame([(line,) for line in text.splitlines()], "value string")
    return with_ts_ms(get_parser(kind)(lines))


def normalize(spark: SparkSession, path: str, out: str, kind: str, pattern: str = "*.{log,txt,xml}") -> None:
    """Parse files below path into Parquet, a folder for each day. Event XML may go over several lines."""
    lines = read_lines(spark, path, pattern)
    if kind == "etw" and not lines.filter(F.contains("value", F.lit("<Event"))).isEmpty():
        lines = read_events(spark, path, pattern)
    logs = get_parser(kind)(lines)
    logs.withColumn("date", F.to_date("timestamp")).write.mode("overwrite").option("compression", "zstd").partitionBy("source_type", "date").parquet(out)


def write_report(spark: SparkSession, path: str, results: DataFrame, latency: DataFrame, config: dict) -> None:
    """An evaluation as one JSON row: results, latency and config (strings)."""
    one = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    pairs = [F.lit(str(x)) for kv in config.items() for x in kv]
    write_json(one(results, "results").join(one(latency, "latency")).withColumn("config", F.create_map(*pairs)), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
