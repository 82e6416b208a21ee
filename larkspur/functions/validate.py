"""Input validation as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONTROL, ascii_lower, strip

# Rights, limits and patterns that results depend on.
RIGHTS = {"read": 1 << 0, "write": 1 << 1, "create": 1 << 2, "publish": 1 << 3, "local": 1 << 4, "public": 1 << 5, "admin": -(1 << 63)}
QUERY_CHARS = 4096
LIMIT_DEFAULT, LIMIT_MIN, LIMIT_MAX = 10, 1, 50
NAME = r"^[A-Za-z0-9_.-]{1,64}\z"
PATH = r"^[ -~]{1,512}\z"
ASCII = r"^[ -~]{1,4096}\z"
TOPIC = r"^[A-Za-z0-9._-]{1,128}\z"


def query_error(q: Column) -> Column:
    """empty_query, query_too_long, query_has_control_chars, or null for a valid query."""
    t = strip(F.coalesce(q, F.lit("")))
    return F.when(t == "", "empty_query").when(F.length(t) > QUERY_CHARS, "query_too_long").when(t.rlike(CONTROL), "query_has_control_chars")


def limit_clamp(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(LIMIT_DEFAULT)), F.lit(LIMIT_MIN)), F.lit(LIMIT_MAX))


def name_valid(s: Column) -> Column:
    """Judged without white space at the ends."""
    return strip(s).rlike(NAME)


def path_valid(s: Column) -> Column:
    return strip(s).rlike(PATH)


def ascii_valid(s: Column) -> Column:
    return s.rlike(ASCII)


def topic_valid(s: Column) -> Column:
    return s.rlike(TOPIC)


def base_name(path: Column, fallback: str = "file.bin") -> Column:
    """What follows the last slash; nothing that could lead out of a folder."""
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(name.isin("", ".", ".."), fallback).otherwise(name)


def rights_parse(s: Column) -> Column:
    """A right's name, a decimal or 0x number below 2^64 as 64 bits, or null."""
    t = ascii_lower(strip(s))
    named = F.create_map(*[F.lit(x) for kv in RIGHTS.items() for x in kv])
    hexed = F.regexp_extract(t, r"^0x\+?0*([0-9a-f]{1,16})$", 1)
    number = F.regexp_extract(t, r"^\+?0*([0-9]{1,20})$", 1).try_cast("decimal(20,0)")
    small = number < F.lit("18446744073709551616").cast("decimal(20,0)")
    wrapped = F.when(number > F.lit("9223372036854775807").cast("decimal(20,0)"), (number - F.lit("18446744073709551616").cast("decimal(20,0)"))).otherwise(number).cast("bigint")
    return F.coalesce(named[t], F.when(hexed != "", F.conv(hexed, 16, -10).try_cast("bigint")), F.when(small, wrapped))


def bool_parse(s: Column) -> Column:
    return F.when(strip(s) == "0", False).when(strip(s) == "1", True)


def hex32_parse(s: Column) -> Column:
    t = strip(s)
    return F.when(t.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(t))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a time without a zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without a zone, read as UTC."""
    return F.floor(epoch_ms(ts) / 1000)
