"""Where queries and their SQL are registered, and SQL for the text functions that many of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def compact(x: str, limit: int = 0) -> str:
    own = strip(rf"regexp_replace({x}, '{WS}+', ' ', 'g')")
    if not limit:
        return own
    return rf"CASE WHEN length({own}) <= {limit} THEN {own} ELSE regexp_replace(left({own}, {limit - 15}), '{WS}+$', '') || ' [TRUNCATED]' END"


def word_list(x: str) -> str:
    return rf"regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9''-]*')"


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
