"""Column expressions that read report lines. White space is Unicode's, as in the report grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space at the ends of a text, and the tags of entry lines.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TAGS = ("ASLI", "DUP")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def to_int(c: Column) -> Column:
    """A whole number with an optional sign and single underscores between digits; null otherwise and beyond 64 bits."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))


def tag(line: Column) -> Column:
    """ASLI or DUP for an entry line, or an empty text."""
    s, out = F.ltrim(line, F.lit(BLANK)), None
    for t in TAGS:
        out = F.when(s.startswith(f"[{t}]"), t) if out is None else out.when(s.startswith(f"[{t}]"), t)
    return out.otherwise("")


def keys_and_values(rest: Column) -> tuple[Column, Column]:
    """Keys and values of the tokens behind a tag, the last first; the tail of the first `name=` comes last of all, so a `name` token overrides it."""
    at = F.instr(rest, "name=")
    head = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)
    tokens = F.reverse(F.filter(F.split(head, r"\|"), lambda t: F.instr(t, "=") > 0))
    none = F.array().cast("array<string>")
    keys = F.concat(F.transform(tokens, lambda t: strip(F.substring_index(t, "=", 1))), F.when(at > 0, F.array(F.lit("name"))).otherwise(none))
    values = F.concat(F.transform(tokens, lambda t: strip(F.substring(t, F.instr(t, "=") + 1, F.length(t)))), F.when(at > 0, F.array(strip(F.substring(rest, at + 5, F.length(rest))))).otherwise(none))
    return keys, values


def value(keys: Column, values: Column, key: str) -> Column:
    """The last value of a key, or null."""
    at = F.array_position(keys, key).cast("int")
    return F.when(at > 0, F.element_at(values, at))


def missing(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def id_tokens(c: Column) -> Column:
    """The distinct ids of a text, split at white space."""
    return F.array_distinct(F.filter(F.split(F.translate(c, BLANK, " " * len(BLANK)), " "), lambda x: x != ""))
