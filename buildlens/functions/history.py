"""Pass rate and failure class of a history strip (array of build, status, duration, current)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed_values as V


def is_failing(status: Column) -> Column:
    return status.isin(V.FAILING_STATUSES)


def _count(history: Column, test) -> Column:
    return F.size(F.filter(history, test))


def is_current(entry: Column) -> Column:
    return F.coalesce(entry["current"], F.lit(False))


def passed_count(history: Column) -> Column:
    return _count(history, lambda h: h["status"] == "pass")


def prior_count(history: Column) -> Column:
    return _count(history, lambda h: ~is_current(h))


def prior_failures(history: Column) -> Column:
    return _count(history, lambda h: ~is_current(h) & is_failing(h["status"]))


def current_status(history: Column) -> Column:
    """Status of the entry marked current, else of the last entry."""
    marked = F.try_element_at(F.filter(history, is_current), F.lit(1))
    return F.coalesce(marked, F.try_element_at(history, F.lit(-1)))["status"]


def _recurring(failures: Column, priors: Column) -> Column:
    return failures >= F.greatest(F.lit(1), F.floor(priors / 2))


def pass_rate_text(history: Column) -> Column:
    """'6 / 8 passed', counting the current run; blank without entries."""
    text = F.concat(
        passed_count(history).cast("string"), F.lit(" / "), F.size(history).cast("string"), F.lit(" passed")
    )
    return F.when(F.size(history) > 0, text).otherwise("")


def failure_note(history: Column) -> Column:
    """First, recurring or intermittent failure; blank without priors or if not failing now."""
    priors, failures = prior_count(history), prior_failures(history)
    return (
        F.when((priors == 0) | ~F.coalesce(is_failing(current_status(history)), F.lit(False)), "")
        .when(failures == 0, V.NOTE_FIRST)
        .when(_recurring(failures, priors), V.NOTE_RECURRING)
        .otherwise(F.concat(F.lit("intermittent — "), failures.cast("string"), F.lit(" prior failure(s) in window")))
    )


def prompt_rate(history: Column) -> Column:
    return F.when(F.size(history) > 0, pass_rate_text(history)).otherwise("no prior history")


def prompt_note(history: Column) -> Column:
    """The same classes in prompt wording; whether the test fails now is not asked."""
    priors, failures = prior_count(history), prior_failures(history)
    text = failures.cast("string")
    return (
        F.when(priors == 0, "")
        .when(failures == 0, V.PROMPT_NOTE_FIRST)
        .when(
            _recurring(failures, priors),
            F.concat(F.lit("recurring — "), text, F.lit(" of "), priors.cast("string"), F.lit(" prior runs also failed")),
        )
        .otherwise(F.concat(F.lit("intermittent — "), text, F.lit(" prior failure(s) in window")))
    )


def history_tail(history: Column, n: int = V.PROMPT_HISTORY_TAIL) -> Column:
    """Last ``n`` entries as lines '  #build: status'."""
    last = F.slice(history, F.greatest(F.lit(1), F.size(history) - F.lit(n - 1)), F.lit(n))
    return F.array_join(
        F.transform(last, lambda h: F.concat(F.lit("  #"), h["build"], F.lit(": "), h["status"])), "\n"
    )
