"""The commands, from log lines to files."""

import json

import pytest

from riskloom import cli

LINES = [f"<{38 + i % 3}>Sep {1 + i % 9} 0{i % 9}:1{i % 6}:00 node{i % 4} relay: link {'denied' if i % 5 else 'established'} from 172.20.0.{1 + i % 6}:{4000 + i} to 172.20.1.{1 + i % 7}:443" for i in range(60)]


def rows(path):
    return [json.loads(line) for p in path.glob("*.json") for line in p.read_text().splitlines()]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("\n".join(LINES))
    run = lambda *a: cli.main([a[0], "-i", str(tmp_path / a[1]), *a[2:]], spark)
    run("parse", "logs", "-o", str(tmp_path / "table"))
    run("extract", "table", "-o", str(tmp_path), "-w", "1d")
    assert sum(r["event_count"] for r in rows(tmp_path / "features")) == 60
    run("detect", "table", "-o", str(tmp_path))
    assert {r["id"] for r in rows(tmp_path / "scores")} == {f"172.20.0.{k}" for k in range(1, 7)} and (tmp_path / "alerts").exists()
    run("risk", "logs", "-e", "172.20.0.1")
    assert "entity_id=172.20.0.1" in capsys.readouterr().out


def test_windows_and_commands():
    assert cli.window("6h") == ("6 hours", 21600.0)
    for bad in ("h", "0d", "5", "1w"):
        with pytest.raises(Exception, match="not a duration"):
            cli.window(bad)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["detect", "-i", "x", "-s", "csv", "-o", "y"])


def test_event_xml_over_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = "<Event>\n <System><EventID>4624</EventID>\n <Level>4</Level></System>\n<EventData><Data Name='IpAddress'>172.20.3.3</Data></EventData>\n</Event>\n"
    (tmp_path / "in" / "a.xml").write_text(event * 2)
    cli.main(["parse", "-i", str(tmp_path / "in"), "-s", "etw", "-o", str(tmp_path / "out")], spark)
    assert [r.src_ip for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["172.20.3.3"] * 2
