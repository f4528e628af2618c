"""Deltas, trend classes and bar heights of metric series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.numbers import fixed_text, float_text
from buildlens.functions.text import blank_to_null, choose


def delta_pct(current: Column, reference: Column) -> Column:
    """Change in percent of |reference|; 0.0 where the reference is 0."""
    return F.when(reference == 0, F.lit(0.0)).otherwise(
        F.try_divide(current - reference, F.abs(reference)) * 100
    )


def delta_text(pct: Column, reference: Column) -> Column:
    shown = fixed_text(pct, 1)
    return (
        F.when(reference == 0, "→ N/A")
        .when(F.isnan(pct), "▼ nan%")
        .when(F.abs(pct) < 0.05, "→ 0%")
        .when(pct > 0, F.concat(F.lit("▲ +"), shown, F.lit("%")))
        .otherwise(F.concat(F.lit("▼ "), shown, F.lit("%")))
    )


def _three_way(pct: Column, direction: Column, good: str, bad: str, neutral: str) -> Column:
    up = ~F.isnan(pct) & (pct > V.DELTA_THRESHOLD)
    down = ~F.isnan(pct) & (pct < -V.DELTA_THRESHOLD)
    lower = direction == "lower_better"
    return (
        F.when(up, F.when(lower, bad).otherwise(good))
        .when(down, F.when(lower, good).otherwise(bad))
        .otherwise(neutral)
    )


def delta_class(pct: Column, direction: Column) -> Column:
    return _three_way(pct, direction, "pos", "neg", "neu")


def metric_status(pct: Column, direction: Column) -> Column:
    return _three_way(pct, direction, "improved", "regressed", "neutral")


def colour_class(css: Column) -> Column:
    return choose(css, V.CHIP_COLOUR, "")


def sparkline(values: Column, direction: Column) -> Column:
    """Series scaled to bar heights where up is better; a flat series is all tall."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.lit(float(V.BAR_MAX - V.BAR_MIN))

    def height(v: Column) -> Column:
        distance = F.when(direction == "lower_better", high - v).otherwise(v - low)
        scaled = F.rint(F.lit(float(V.BAR_MIN)) + distance / (high - low) * span)
        return F.when(low == high, F.lit(V.BAR_MAX)).otherwise(scaled.cast("int"))

    return F.transform(values, height)


def unit_text(unit: Column, direction: Column) -> Column:
    hint = F.when(direction == "lower_better", "↓ lower better · bars inv.").otherwise("↑ higher better")
    return F.btrim(F.concat(unit, F.lit(" · "), hint), F.lit(V.WHITESPACE))


def trend_class(improved: Column, regressed: Column) -> Column:
    return F.when(improved > regressed, "good").when(regressed > improved, "bad").otherwise("neu")


def trend_title(trend: Column) -> Column:
    return choose(trend, V.TREND_LABEL, V.TREND_LABEL["neu"])


def counts_text(trend: Column, improved: Column, regressed: Column, neutral: Column, total: Column) -> Column:
    count = F.when(trend == "good", improved).when(trend == "bad", regressed).otherwise(neutral)
    word = F.when(trend == "good", " improved").when(trend == "bad", " regressed").otherwise(" stable")
    return F.concat(count.cast("string"), F.lit(" / "), total.cast("string"), word)


def summary_note(given: Column, trend: Column, ref_build: Column) -> Column:
    """Given note, else one by trend class; the neutral one names the reference build."""
    return F.coalesce(
        blank_to_null(given),
        F.when(trend == "good", V.NOTE_GOOD)
        .when(trend == "bad", V.NOTE_BAD)
        .otherwise(F.concat(F.lit(V.NOTE_NEUTRAL_PREFIX), F.coalesce(ref_build, F.lit("")))),
    )


def chip(name: Column, current: Column, unit: Column, css: Column) -> Column:
    """Summary chip of one metric."""
    return F.struct(
        F.left(F.lower(name), F.lit(V.CHIP_LABEL_CHARS)).alias("label"),
        F.concat(float_text(current), F.lit(" "), unit).alias("value"),
        colour_class(css).alias("css_class"),
    )


def chips_or_given(given: Column, derived: Column) -> Column:
    """Chips given with the model win unless there are none."""
    kept = F.transform(given, lambda c: c.withField("css_class", F.coalesce(c["css_class"], F.lit(""))))
    return F.when(F.size(given) > 0, kept).otherwise(derived)
