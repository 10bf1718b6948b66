"""Regular-expression functions on the JVM's engine, with the anchoring of a linear-time library.

Patterns are Java's; named groups are written (?<name>...). `full` ends at the
very end of the text, not before a last line feed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def full(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def partial(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def consumed(s: Column, pattern: str) -> Column:
    """What is left behind a match at the start; null without one."""
    head = F.regexp_extract(s, rf"\A({pattern})", 1)
    return F.when(s.rlike(rf"\A(?:{pattern})"), F.substring(s, F.length(head) + 1, F.lit(0x7FFFFFFF)))


def found(s: Column, pattern: str) -> Column:
    """All matches from left to right."""
    return F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))


def count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("bigint")


def replace_first(s: Column, pattern: str, rewrite: str) -> Column:
    """The first match replaced; $n stand for groups."""
    return F.regexp_replace(s, rf"(?s)\A(.*?)(?:{pattern})", "$1" + _shift(rewrite)) if _groups(pattern) else F.regexp_replace(s, rf"(?s)\A(.*?)(?:{pattern})", "$1" + rewrite)


def _groups(pattern: str) -> int:
    return re.compile(pattern.replace("(?<", "(?P<")).groups


def _shift(rewrite: str) -> str:
    return re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", rewrite)


def replace_all(s: Column, pattern: str, rewrite: str) -> Column:
    return F.regexp_replace(s, pattern, rewrite)


def extracted(s: Column, pattern: str, rewrite: list[str | int]) -> Column:
    """A text built from groups (numbers) and strings of the first match; null without one."""
    parts = [F.regexp_extract(s, pattern, r) if isinstance(r, int) else F.lit(r) for r in rewrite]
    return F.when(s.rlike(pattern), F.concat(*parts))


def quoted(s: Column) -> Column:
    """The text as a pattern that matches it alone."""
    return F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")


def typed(s: Column, pattern: str, kinds: list[str]) -> list[Column]:
    """The groups of the first match as int, hex, octal, float or string; null where they do not read."""
    out = []
    for i, kind in enumerate(kinds, 1):
        g = F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))
        base = {"hex": 16, "octal": 8}.get(kind)
        out.append(F.conv(g, base, 10).try_cast("bigint") if base else g.try_cast({"int": "bigint", "float": "double"}.get(kind, "string")))
    return out


def literal_prefix(pattern: str) -> str:
    """The text that every match of a pattern starts with; alternatives at the top have none."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    out, at = "", 0
    while m := re.match(r"\\([^A-Za-z0-9])|([A-Za-z0-9 _#/:-])", pattern[at:]):
        if pattern[at + m.end() : at + m.end() + 1] in ("*", "?", "{"):
            break
        out += m[1] or m[2]
        at += m.end()
        if pattern[at : at + 1] == "+":
            break
    return out


def possible_range(pattern: str) -> tuple[str, str]:
    """The least and a greatest string that a match can be, for pruning by minima and maxima."""
    p = literal_prefix(pattern)
    return p, (p[:-1] + chr(ord(p[-1]) + 1)) if p else "\U0010ffff"


def matching_set(s: Column, patterns: list[str]) -> Column:
    """The numbers of all patterns that match, ascending."""
    return F.array_compact(F.array(*(F.when(s.rlike(p), F.lit(i)) for i, p in enumerate(patterns))))


def filtered_set(s: Column, patterns: list[tuple[str, str]]) -> Column:
    """As `matching_set` for (literal that every match holds, pattern): the engine runs only where the literal occurs."""
    return F.array_compact(F.array(*(F.when(F.contains(s, F.lit(atom)) & s.rlike(p), F.lit(i)) for i, (atom, p) in enumerate(patterns))))


def pruned(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows that match from their start; the literal prefix is a range that reaches the Parquet scan."""
    low, high = possible_range(pattern)
    c = F.col(column)
    return df.where((c >= low) & (c < high) & c.rlike(rf"\A(?:{pattern})"))
