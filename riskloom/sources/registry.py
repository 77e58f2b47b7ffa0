"""Parsers by name: functions from lines (value) to unified records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import dns, etw, syslog, waf

Parser = Callable[..., DataFrame]
_parsers: dict[str, Parser] = {"syslog": syslog.parse, "dns": dns.parse, "waf": waf.parse, "etw": etw.parse}


def register(name: str, parser: Parser) -> None:
    if not callable(parser):
        raise TypeError("a parser is a function from a DataFrame of lines to unified records")
    _parsers[name] = parser


def get_parser(name: str) -> Parser:
    try:
        return _parsers[name]
    except KeyError:
        raise ValueError(f"unknown parser {name!r}; there are {', '.join(available_parsers())}") from None


def available_parsers() -> list[str]:
    return sorted(_parsers)
