"""Plain-text tables, the read-only SQL guard, and checks of arguments."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

_READS = ("select", "with", "show", "describe", "desc", "summarize", "from", "explain", "pivot", "unpivot")
_WRITES = ("insert", "update", "delete", "drop", "create", "alter", "copy", "attach", "detach", "install", "load", "call", "export", "import", "vacuum", "checkpoint", "set", "reset", "merge", "truncate", "begin", "commit", "rollback")


def read_only_sql(sql: str) -> str:
    """The statement without a final semicolon; ValueError unless it is one statement that only reads."""
    q = re.sub(r";+\s*$", "", sql.strip()).strip()
    if not q:
        raise ValueError("an empty statement")
    if ";" in q:
        raise ValueError("one statement only")
    words = re.findall(r"\w+", q.lower())
    if not words or words[0] not in _READS:
        raise ValueError("a statement that reads is needed")
    if bad := set(words) & set(_WRITES):
        raise ValueError(f"not allowed here: {', '.join(sorted(bad))}")
    return q


def run_read_only(spark: SparkSession, sql: str, limit: int = 100) -> tuple[list[dict], bool]:
    """At most ``limit`` rows of a guarded statement, and whether there are more."""
    rows = [r.asDict(recursive=True) for r in spark.sql(read_only_sql(sql)).limit(limit + 1).collect()]
    return rows[:limit], len(rows) > limit


def format_table(rows: list[dict]) -> str:
    """Rows as aligned text: the union of their columns, numbers to the right with thousands separators."""
    if not rows:
        return "(no rows)"
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)

    def cell(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v:,.3f}".rstrip("0").rstrip(".")
        return f"{v:,}" if isinstance(v, int) else str(v)

    columns = list(dict.fromkeys(k for r in rows for k in r))
    right = {c for c in columns if any(number(r.get(c)) for r in rows)}
    lines = [columns, *([cell(r.get(c)) for c in columns] for r in rows)]
    width = [max(len(line[i]) for line in lines) for i in range(len(columns))]
    pad = lambda k, i, t: t.rjust(width[i]) if k and columns[i] in right else t.ljust(width[i])
    return "\n".join("  ".join(pad(k, i, t) for i, t in enumerate(line)).rstrip() for k, line in enumerate(lines))


def show(df: DataFrame, limit: int = 50) -> str:
    return format_table([r.asDict() for r in df.limit(limit).collect()])


def iso_date(text) -> dt.date:
    """A date or YYYY-MM-DD; ValueError otherwise."""
    if isinstance(text, dt.date):
        return text
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""):
        raise ValueError(f"not YYYY-MM-DD: {text!r}")
    return dt.date.fromisoformat(text)


def session_minute(text: str) -> int:
    """Minutes since midnight of HH:MM."""
    m = re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)", text or "")
    if not m:
        raise ValueError(f"not HH:MM: {text!r}")
    return int(m[1]) * 60 + int(m[2])


def one_of(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def clamp(n: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if n is None else n, low), high)
