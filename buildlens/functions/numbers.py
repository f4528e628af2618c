"""Rounding and number formatting that agree with exact decimal arithmetic.

Spark's ``bround`` rounds the shortest decimal text of a double, so 18.15
(stored as 18.149999...) counts as a tie. The results here have to follow the
stored binary value instead, and only a value stored exactly half-way goes to
the even neighbour. ``round_half_even`` gets there with a product that keeps
its rounding error, using ordinary double arithmetic inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2^27 + 1: cuts a double into two halves of 26 bits


def _round_scaled(x: Column, five: Column, two: Column) -> Column:
    """x * five * two rounded to a whole number (still a double).

    10^n goes in as 5^n and 2^n: multiplying by the power of two is exact, and
    the power of five is short enough for an exact rounding error.
    """
    product = x * five
    wide = x * F.lit(_SPLITTER)
    high = wide - (wide - x)
    error = (high * five - product) + (x - high) * five
    scaled = product * two
    nearest = F.rint(scaled)
    tie = F.abs(scaled - nearest) == F.lit(0.5)
    return F.when(tie & (error != 0), scaled + F.signum(error) * 0.5).otherwise(nearest)


_NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def as_number(c: Column) -> Column:
    """Number or numeric text as a double, other text as NULL.

    Text is checked by pattern first: a cast accepts '1d' and is slow to fail.
    The type test is constant, so number columns keep only the cast.
    """
    unreadable = (F.typeof(c) == "string") & ~c.cast("string").rlike(_NUMBER)
    return F.when(unreadable, F.lit(None)).otherwise(c.try_cast("double"))


def micros(c: Column) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone is."""
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Round a double to ``digits`` (0..11) places by its exact stored value."""
    x = x.cast("double")
    if digits == 0:
        return F.rint(x)
    return _round_scaled(x, F.lit(float(5 ** digits)), F.lit(float(2 ** digits))) / F.lit(float(10 ** digits))


def fixed_text(x: Column, digits: int) -> Column:
    """Text with exactly ``digits`` decimals; small negative numbers keep their sign ('-0')."""
    x = x.cast("double")
    size = round_half_even(F.abs(x), digits).try_cast(f"decimal(38,{digits})").cast("string")
    return F.when(x < 0, F.concat(F.lit("-"), size)).otherwise(size)


def _strip_zeros(text: Column) -> Column:
    """Drop trailing zeros behind a decimal point, and the point if nothing is left."""
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def _plain(x: Column, java: Column) -> Column:
    """Digits without an exponent. The cast already writes 1e-3..1e7 that way; decimals do the rest."""
    spelled = _strip_zeros(x.try_cast("decimal(38,20)").cast("string"))
    spelled = F.when(spelled.contains("."), spelled).otherwise(F.concat(spelled, F.lit(".0")))
    return F.when(java.contains("E"), spelled).otherwise(java)


def float_text(x: Column) -> Column:
    """Shortest text of a double: '234.0', '1e-05', '1e+16'."""
    x = x.cast("double")
    size, java = F.abs(x), x.cast("string")
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when((size >= 1e-4) & (size < 1e16), _plain(x, java))
        .when(x == 0, "0.0")
        .when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .otherwise(scientific)
    )


def let(value: Column, use) -> Column:
    """use(value) with the value computed once.

    Spelled out in place, an expression used many times outgrows what the JVM
    compiles; a lambda variable is the way to name it inside a column.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _six_digits(x: Column) -> Column:
    """Six significant digits, trailing zeros dropped, exponent form outside 1e-4..1e6."""
    size = F.abs(x)
    # 10^n with n = 5 - exponent, as 5^n and 2^n.
    fives = "array(" + ", ".join(f"{5 ** n}D" for n in range(10)) + ")"
    twos = "array(" + ", ".join(f"{2 ** n}D" for n in range(10)) + ")"
    n = F.lit(9)
    for exponent in range(-3, 6):
        n = F.when(size >= float(f"1e{exponent}"), 5 - exponent).otherwise(n)
    inputs = F.struct(size.alias("size"), n.alias("n"))

    def rounded(v: Column) -> Column:
        five, two = F.get(F.expr(fives), v["n"]), F.get(F.expr(twos), v["n"])
        return F.struct(_round_scaled(v["size"], five, two).alias("whole"), (five * two).alias("ten"))

    def spelled(v: Column) -> Column:
        r = v["whole"] / v["ten"]
        text = _plain(r, r.cast("string"))
        # 999999.5 and the like round up into a seventh digit, which is exponent form.
        return F.when(r >= 1e6, F.lit("1e+06")).otherwise(_strip_zeros(text))

    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, let(let(inputs, rounded), spelled))
    java = F.format_string("%.5e", x)
    mantissa = _strip_zeros(F.split_part(java, F.lit("e"), F.lit(1)))
    scientific = F.concat(mantissa, F.lit("e"), F.split_part(java, F.lit("e"), F.lit(2)))
    return F.when((size >= 1e-4) & (size < 1e6), plain).otherwise(scientific)


def compact_number(c: Column) -> Column:
    """Whole numbers without decimals, others with six significant digits, the rest as text."""
    x = as_number(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), c.cast("string"))
        .when(x == F.rint(x), x.try_cast("decimal(38,0)").cast("string"))
        .otherwise(_six_digits(x))
    )
