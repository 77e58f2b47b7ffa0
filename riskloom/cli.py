"""Commands for spark-submit: parse, extract, detect, mine-chains, risk, report, evaluate.

    spark-submit riskloom/cli.py detect --input-dir logs --source-type syslog --output-dir out
    python -m riskloom.cli risk --input-dir logs --entity 10.1.0.5

Input is normalised Parquet or raw log files. Results are written as JSON lines by the executors; what is shown is limited.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import evaluation, features, risk
from riskloom.plans import pipeline
from riskloom.ship import ship
from riskloom.sources import files
from riskloom.sources.registry import available_parsers

WINDOWS = {"m": ("minutes", 60), "h": ("hours", 3600), "d": ("days", 86400)}


def window(text: str) -> tuple[str, float]:
    """A duration such as 1h or 30m as (for Spark, seconds)."""
    unit = WINDOWS.get(text[-1:])
    if unit is None or not text[:-1].isdigit() or not int(text[:-1]):
        raise argparse.ArgumentTypeError(f"not a duration: {text}")
    return f"{text[:-1]} {unit[0]}", float(int(text[:-1]) * unit[1])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="riskloom", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, told: str, output: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=told)
        c.add_argument("--input-dir", "-i", required=True, help="normalised Parquet or log files")
        c.add_argument("--source-type", "-s", default="syslog", choices=available_parsers())
        if output:
            c.add_argument("--output-dir", "-o", required=True)
        return c

    p = command("parse", "normalise log files into Parquet", output=True)
    p.add_argument("--pattern", default="*.{log,txt,xml}")
    p = command("extract", "features of every entity and window", output=True)
    p.add_argument("--window", "-w", type=window, default=window("1h"))
    command("detect", "anomaly scores and alerts", output=True)
    command("mine-chains", "attack chains", output=True)
    p = command("risk", "the riskiest entities, or one")
    p.add_argument("--entity", "-e")
    p.add_argument("--limit", "-n", type=int, default=20)
    p = command("report", "the daily report", output=True)
    p.add_argument("--date", "-d", default="")
    p = command("evaluate", "inject attacks and measure what is found", output=True)
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--start-ms", type=int, default=1_718_400_000_000)
    return out


def say(df: DataFrame, n: int = 20) -> None:
    for row in df.limit(n).collect():
        print("  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.asDict().items()))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"riskloom {a.command}").getOrCreate()
    ship(spark)
    if a.command == "parse":
        files.normalize(spark, a.input_dir, a.output_dir, a.source_type, a.pattern)
        return
    logs = files.load(spark, a.input_dir, a.source_type)
    if a.command == "extract":
        files.write_json(features.windowed_features(logs, *a.window), f"{a.output_dir}/features")
        return
    if a.command == "evaluate":
        logs, truth = evaluation.inject(logs, a.start_ms)
    now = logs.agg(F.coalesce(F.max("ts_ms"), F.lit(0))).first()[0]
    out = pipeline.run(logs, now_ms=now)
    if a.command == "detect":
        files.write_json(out.ip_scores, f"{a.output_dir}/scores")
        files.write_json(risk.alerts(out.ip_scores), f"{a.output_dir}/alerts")
        say(risk.drift(out.ip_scores))
    elif a.command == "mine-chains":
        files.write_json(out.chains, f"{a.output_dir}/chains")
        say(out.chains.groupBy("chain_type").agg(F.count("*").alias("chains")))
    elif a.command == "risk":
        columns = ["entity_id", "entity_type", "score", risk.trend(F.col("score"), F.col("baseline_score")).alias("trend"), "evidence_count", "tags", "associated_chains"]
        found = out.profiles.filter(F.col("entity_id") == a.entity) if a.entity else risk.top(out.profiles, a.limit, "score", "entity_id")
        say(found.select(*columns), a.limit)
    elif a.command == "report":
        date = a.date or str(spark.range(1).select(F.to_date(F.timestamp_millis(F.lit(now)))).first()[0])
        files.write_json(risk.daily_report(out.profiles, out.chains, logs, date), f"{a.output_dir}/report")
        files.write_json(risk.exported(logs, out.chains, out.ip_scores, out.features, None), f"{a.output_dir}/export")
    else:
        found = evaluation.metrics(truth, out.chains, a.threshold)
        latency = evaluation.latency(truth, out.chains, a.threshold)
        files.write_report(spark, f"{a.output_dir}/evaluation", evaluation.per_type(truth, out.chains, a.threshold), latency, {"threshold": a.threshold, "start_ms": a.start_ms})
        files.write_json(risk.exported(logs, out.chains, out.ip_scores, out.features, found), f"{a.output_dir}/export")
        say(found)


if __name__ == "__main__":
    main()
