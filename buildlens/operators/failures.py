"""Failing runs of a build, their history strips, and the scenario groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions import history as H
from buildlens.functions import text as X
from buildlens.operators.sizing import LIST_SIZE, is_small, join_unique, with_part

RUN_COLUMNS = ["scenario", "config", "name", "status", "duration_s", "failure_msg", "failure_txt",
               "jira", "jira_url", "task_url", "log_url"]


def _extra(df: DataFrame, *names: str) -> list[str]:
    return [c for c in names if c in df.columns]


def failing_runs(runs: DataFrame, build: str, text_cap: int = V.FAILURE_TEXT_CAP) -> DataFrame:
    """Runs of the build that failed, with the failure text capped in the scan."""
    return runs.filter((F.col("build") == build) & H.is_failing(F.col("status"))).select(
        *[X.head(F.col(c), text_cap).alias(c) if c == "failure_txt" else c for c in RUN_COLUMNS],
        *_extra(runs, "ran_at", "id"),
    )


def clean_cases(failing: DataFrame, jira_base: str = "", task_base: str = "", log_base: str = "") -> DataFrame:
    """Failing runs as report cases: stripped texts, duration text, links with fallbacks."""
    jira = X.null_to_blank(F.col("jira"))
    return failing.select(
        "scenario",
        "config",
        "name",
        "status",
        X.duration_text(F.col("duration_s")).alias("duration"),
        X.normalise_blank(F.col("failure_msg")).alias("failure_message"),
        X.normalise_blank(F.col("failure_txt")).alias("failure_text"),
        jira.alias("jira"),
        X.ticket_link(F.col("jira_url"), jira, jira_base).alias("jira_url"),
        X.name_link(F.col("task_url"), F.col("name"), task_base).alias("task_url"),
        X.name_link(F.col("log_url"), F.col("name"), log_base).alias("log_url"),
        *_extra(failing, "duration_s", "ran_at", "id"),
    )


def failing_names(cases: DataFrame) -> DataFrame:
    return cases.select("name").distinct()


def history_runs(runs: DataFrame, build: str) -> DataFrame:
    """Runs of every other build, later ones included."""
    return runs.filter(F.col("build") != build).select(
        "build", "name", "status", "duration_s", *_extra(runs, "ran_at", "id")
    )


def history_semi(runs: DataFrame, names: DataFrame, build: str) -> DataFrame:
    """History rows of the given names."""
    return join_unique(history_runs(runs, build), names, ["name"], "left_semi")


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.col(c).desc() for c in (*_extra(df, "ran_at"), *(_extra(df, "id") or ["build"]))]


NAMES_IN_FILTER = 2_000
CHARS_IN_FILTER = 1_000_000


def names_for_filter(names: DataFrame) -> list[str] | None:
    """The names as literals of a filter, if they are few and short enough; NULL is no name to look for."""
    found = names.filter("name IS NOT NULL").select("name").distinct()
    total = F.sum(F.length("name"))
    few = found.limit(NAMES_IN_FILTER + 1).agg(F.count(F.lit(1)).alias("n"), total.alias("chars"), F.collect_list(F.left("name", F.lit(CHARS_IN_FILTER))).alias("names")).first()
    return sorted(few["names"]) if few["n"] <= NAMES_IN_FILTER and (few["chars"] or 0) <= CHARS_IN_FILTER else None


def last_n_runs(
    runs: DataFrame,
    names: DataFrame,
    build: str,
    limit: int = V.HISTORY_LIMIT,
    few: bool | None = None,
) -> DataFrame:
    """Newest ``limit`` history rows per failing name; ``rn`` 1 is the newest.

    The row limit is pushed below the shuffle (window group limit), so a test
    with any share of all rows sends at most ``limit`` rows per task. A few names
    become literals of the filter, which reaches the files' statistics or the database; more are broadcast if they
    are measured to be small. Many names are joined after the limit, on the partitioning the window already has.
    """
    history = history_runs(runs, build)
    literal = names_for_filter(names) if few is None else None
    if literal is not None:
        history = history.filter(F.col("name").isin(literal))
        names, few = None, True
    elif few is None:
        few = is_small(names)
    if few and names is not None:
        history = history.join(F.broadcast(names), "name", "left_semi")
    newest = W.partitionBy("name").orderBy(*_newest_first(history))
    kept = history.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit)
    return kept if few else kept.join(names, "name", "left_semi")


def history_strips(last_runs: DataFrame) -> DataFrame:
    """One row per name with its (bounded) history, oldest first."""
    entry = F.struct(
        (-F.col("rn")).alias("ord"),
        "build",
        "status",
        X.duration_text(F.col("duration_s")).alias("duration"),
    )
    strip = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda h: F.struct(h["build"].alias("build"), h["status"].alias("status"),
                           h["duration"].alias("duration"), F.lit(False).alias("current")),
    )
    return last_runs.groupBy("name").agg(strip.alias("strip"))


def failure_history(cases: DataFrame, runs: DataFrame, build: str, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """Cases with ``history``: the strip of their name plus the current run as last entry."""
    strips = history_strips(last_n_runs(runs, failing_names(cases), build, limit))
    duration = F.col("duration") if "duration" in cases.columns else X.duration_text(F.col("duration_s"))
    current = F.struct(
        F.lit("current").alias("build"),
        F.col("status"),
        duration.alias("duration"),
        F.lit(True).alias("current"),
    )
    return (
        # One strip a name: whether they are sent to all tasks, and how often a name's cases are split, is decided by their measured size as it runs.
        cases.join(strips, "name", "left")
        .withColumn("history", F.when(F.col("strip").isNull(), F.array(current))
                    .otherwise(F.concat(F.col("strip"), F.array(current))))
        .select(*cases.columns, "history")
    )


def classify(cases: DataFrame) -> DataFrame:
    """Pass rate and failure class out of ``history``."""
    return cases.withColumns({
        "history_rate": H.pass_rate_text(F.col("history")),
        "history_note": H.failure_note(F.col("history")),
    })


def failure_class(runs: DataFrame, build: str, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """Failing cases of a build with history, pass rate and failure class."""
    return classify(failure_history(clean_cases(failing_runs(runs, build)), runs, build, limit))


def linkable(cases: DataFrame) -> DataFrame:
    """Cases whose log can be fetched."""
    return cases.filter(X.has_link(F.col("log_url")))


def inherit_environment(cases: DataFrame, prefix: str = "scenario_") -> DataFrame:
    """Blank config, os and agent of a case come from its scenario's columns."""
    fields = [c for c in ("config", "os", "agent") if prefix + c in cases.columns]
    return cases.withColumns({
        c: F.coalesce(X.blank_to_null(F.col(c)), F.col(prefix + c), F.lit("")) for c in fields
    })


def case_defaults(cases: DataFrame) -> DataFrame:
    """Optional case fields get their defaults; ``has_ai`` tells non-empty analysis text."""
    blank = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("text", "tag", "tag_type")])
    have = set(cases.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    analysis = F.col("ai_analysis") if "ai_analysis" in have else F.lit(None).cast(
        "struct<text:string,tag:string,tag_type:string>")
    return cases.withColumns({
        "is_scenario_error": F.coalesce(given("is_scenario_error", "boolean"), F.lit(False)),
        "error_label": F.coalesce(given("error_label", "string"), F.lit("")),
        "has_ai": F.coalesce(analysis["text"] != "", F.lit(False)),
        "ai_analysis": F.coalesce(analysis, blank),
    })


def _case_struct(cases: DataFrame) -> Column:
    first = ["name", *_extra(cases, "ran_at", "id")]
    rest = [c for c in cases.columns if c not in (*first, "scenario", "config", "part", "source", "source_ord")]
    return F.struct(*first, *rest)


def scenario_groups(cases: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """Cases nested by (scenario, config), ordered by name.

    A group above ``list_size`` cases comes in several rows, numbered by ``part``, each holding
    the next ``list_size`` cases in that order.
    """
    first = ["name", *_extra(cases, "ran_at", "id")]
    keys = [*_extra(cases, "source", "source_ord"), "scenario", "config"]
    return (
        (cases if "part" in cases.columns else with_part(cases, keys, first, list_size))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(_case_struct(cases))).alias("test_cases"))
        .withColumns({"jira": F.lit(""), "jira_url": F.lit(V.NO_LINK)})
    )


def scenario_order(cases: DataFrame) -> DataFrame:
    """Scenario groups with the name that puts them in first-seen order."""
    return cases.groupBy("scenario", "config").agg(
        F.min("name").alias("first_name"), F.count(F.lit(1)).alias("n_cases")
    )


def failed_badge(groups: DataFrame) -> DataFrame:
    """Number of nested cases over all sources."""
    return groups.agg(F.coalesce(F.sum(F.size("test_cases")), F.lit(0)).cast("long").alias("failed"))


def gate(cases: DataFrame) -> DataFrame:
    """2 if there is any failing case, else 0."""
    found = cases.select(F.lit(1).alias("one")).limit(1)
    return found.agg(F.when(F.count(F.lit(1)) > 0, 2).otherwise(0).alias("gate"))
