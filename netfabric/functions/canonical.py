"""Text renderings that hashes depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLASH = chr(92)
_UPPER_ESCAPE_CHARS = "[" + chr(0x0B) + chr(0x0E) + chr(0x0F) + chr(0x1A) + "-" + chr(0x1F) + "]"


def _lower_control_escapes(json: Column) -> Column:
    # Spark renders 0x1f as \u001F, the canonical form wants \u001f.  The escape
    # is only an escape after an even run of backslashes.
    out = json
    for digit in "ABCDEF":
        out = F.regexp_replace(
            out,
            rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}",
            "$1" + _SLASH * 2 + "u00$2" + digit.lower(),
        )
    return out


def json_string(value: Column) -> Column:
    """One JSON string literal with non-ASCII kept and lower-case control escapes."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    rendered = F.to_json(F.array(v))
    literal = F.substring(rendered, F.lit(2), F.length(rendered) - 2)
    return F.when(v.rlike(_UPPER_ESCAPE_CHARS), _lower_control_escapes(literal)).otherwise(literal)


def json_string_array(values: Column) -> Column:
    """A compact JSON array of strings."""
    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), json_string)
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def iso_millis(ts: Column) -> Column:
    """UTC ISO-8601 truncated to milliseconds with a trailing Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def csv_set(values: Column) -> Column:
    """Comma-joined sorted set of the non-empty string values."""
    strings = F.transform(values, lambda v: v.cast("string"))
    kept = F.filter(strings, lambda v: v.isNotNull() & (v != ""))
    return F.array_join(F.array_sort(F.array_distinct(kept)), ",")


def ascii_json_string(value: Column) -> Column:
    """One JSON string literal with every non-ASCII character written as ``\\uXXXX``."""
    plain = json_string(value)

    def escape(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        mark = F.lit(_SLASH + "u")
        pair = F.concat(mark, F.substring(units, 1, 4), mark, F.substring(units, 5, 4))
        escaped = F.when(F.length(units) > 4, pair).otherwise(F.concat(mark, units))
        return F.when(ch.rlike(r"[^\x00-\x7e]"), escaped).otherwise(ch)

    wide = F.concat_ws("", F.transform(F.split(plain, ""), escape))
    return F.when(plain.rlike(r"[^\x00-\x7e]"), wide).otherwise(plain)


def spaced_json_object(pairs: list[tuple[str, Column]]) -> Column:
    """``{"a": x, "b": y}`` with the keys sorted; the values are rendered JSON already."""
    parts = [
        F.concat(F.lit(f'"{key}": '), rendered) for key, rendered in sorted(pairs, key=lambda p: p[0])
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
