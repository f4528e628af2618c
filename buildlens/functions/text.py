"""Text columns: cleaning, durations, links, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.numbers import as_number, fixed_text, let


def choose(c: Column, table: dict[str, str], default: str) -> Column:
    """Literal lookup table with a default."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove any whitespace, newlines and tabs included, from both ends."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def normalise_blank(c: Column) -> Column:
    """NULL becomes '' and the ends are stripped."""
    return strip(null_to_blank(c))


def head(c: Column, chars: int) -> Column:
    return F.left(c, F.lit(chars))


def cap_with_marker(c: Column, chars: int) -> Column:
    """Text longer than ``chars`` is cut there and marked as truncated."""
    return F.when(F.length(c) > chars, F.concat(head(c, chars), F.lit(V.TRUNCATED_MARK))).otherwise(c)


def tail_bytes(content: Column, n: int) -> Column:
    """Last ``n`` bytes of a binary column; 0 keeps everything."""
    if n <= 0:
        return content
    start = F.greatest(F.lit(1), F.octet_length(content) - F.lit(n - 1))
    return F.substring(content, start, F.lit(n))


def safe_name(c: Column) -> Column:
    """File-system safe form of a name."""
    return head(F.regexp_replace(c, V.UNSAFE_CHAR, "_"), V.SAFE_NAME_CAP)


def duration_text(c: Column) -> Column:
    """Seconds (number or numeric text) as '18.1s' or '3m 12s'.

    The type test is constant: a text column is read once per row, a number
    column stays in plain generated code.
    """
    is_text = F.typeof(c) == "string"
    return F.when(is_text, let(as_number(c), _duration)).otherwise(_duration(c.try_cast("double")))


def _duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("string")
    return (
        F.when(seconds.isNull() | (seconds <= 0) | (seconds == float("inf")), V.EMPTY_MARK)
        .when(F.isnan(seconds), "nans")
        .when(seconds >= 60, F.concat(minutes, F.lit("m "), fixed_text(seconds % 60, 0), F.lit("s")))
        .otherwise(F.concat(fixed_text(seconds, 1), F.lit("s")))
    )


def ticket_link(stored: Column, key: Column, base: str) -> Column:
    """Stored link, else base + key, else the no-link mark."""
    built = F.when(F.lit(base != "") & (key != ""), F.concat(F.lit(base), key))
    return F.coalesce(blank_to_null(stored), built, F.lit(V.NO_LINK))


def name_link(stored: Column, name: Column, base: str) -> Column:
    """Stored link, else base + safe name, else the no-link mark."""
    built = F.concat(F.lit(base), safe_name(name)) if base else F.lit(None).cast("string")
    return F.coalesce(blank_to_null(stored), built, F.lit(V.NO_LINK))


def has_link(c: Column) -> Column:
    return F.coalesce((c != "") & (c != V.NO_LINK), F.lit(False))


def fill_build(c: Column, build: str | Column) -> Column:
    """Replace the {build} placeholder."""
    build = F.lit(build) if isinstance(build, str) else build
    return F.replace(c, F.lit("{build}"), build)


def fill_build_map(c: Column, build: str | Column) -> Column:
    return F.transform_values(c, lambda _, v: fill_build(v, build))


def fill_build_list(c: Column, build: str | Column) -> Column:
    return F.transform(c, lambda v: fill_build(v, build))


def status_label(c: Column) -> Column:
    return choose(c, V.STATUS_SYMBOL, "?")


def trend_label(c: Column) -> Column:
    return choose(c, V.TREND_CHIP, "neu")
