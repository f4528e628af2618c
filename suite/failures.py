"""Failing runs, history, classification, scenario groups."""

from pyspark.sql import functions as F

from buildlens.functions import history as H
from buildlens.functions import text as X
from buildlens.operators import failures as FA
from buildlens.operators import merge as MG
from buildlens.operators.nesting import case_rows
from suite.tables import BUILD, JIRA_BASE, LOG_BASE, TASK_BASE, table, view, with_views

FAILING = "('fail', 'error', 'timeout')"
# Duration text in exact half-even decimals.
DURATION = """CASE WHEN {c} IS NULL OR {c} <= 0 THEN '—'
    WHEN {c} >= 60 THEN printf('%dm %ss', cast(floor({c} / 60) AS bigint), printf('%.0f', {c} % 60))
    ELSE printf('%.1fs', {c}) END"""

FAILED_NOW = f"now AS (SELECT * FROM runs WHERE build = '{BUILD}' AND status IN {FAILING})"
LAST = f"""{FAILED_NOW},
last AS (SELECT * FROM (
    SELECT build, name, status, duration_s, ran_at, id,
           cast(row_number() OVER (PARTITION BY name ORDER BY ran_at DESC, id DESC) AS integer) AS rn
    FROM runs WHERE build <> '{BUILD}' AND name IN (SELECT name FROM now)) WHERE rn <= 7)"""
COUNTED = f"""{LAST},
prior AS (SELECT name, count(*) AS n, count(*) FILTER (status = 'pass') AS ok,
                 count(*) FILTER (status IN {FAILING}) AS bad FROM last GROUP BY name),
c AS (SELECT now.id, now.name, now.status, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad
      FROM now LEFT JOIN prior ON now.name = prior.name)"""


def _runs(spark, d):
    return view(spark, d, "runs")


def _history(spark, d):
    runs = _runs(spark, d)
    return FA.failure_history(FA.clean_cases(FA.failing_runs(runs, BUILD)), runs, BUILD)


def failing_runs(spark, d):
    return FA.failing_runs(_runs(spark, d), BUILD).drop("ran_at").orderBy("scenario", "name", "config", "id")


def text_head_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", X.head(F.col("text"), 8192).alias("failure_txt"))


def linkable_cases(spark, d):
    return FA.linkable(_runs(spark, d)).select("id", "name", "log_url")


def link_fallback(spark, d):
    cases = FA.clean_cases(_runs(spark, d), JIRA_BASE, TASK_BASE, LOG_BASE)
    return cases.select("id", "jira_url", "task_url", "log_url")


def env_inherit(spark, d):
    cases = _runs(spark, d).select(
        "id", F.when(F.col("jira") == "", F.lit("")).when(F.col("jira") != "", F.col("config")).alias("config"),
        F.col("failure_msg").alias("os"), F.lit(None).cast("string").alias("agent"),
        F.col("scenario").alias("scenario_config"), F.lit("linux").alias("scenario_os"),
        F.col("jira").alias("scenario_agent"))
    return FA.inherit_environment(cases).select("id", "config", "os", "agent")


def case_defaults(spark, d):
    notes = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    analysis = F.when(F.col("quality").isNotNull(), F.struct(
        F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("text"),
        F.col("source").alias("tag"), F.lit("ok").alias("tag_type")))
    cases = notes.select("doc_id", analysis.alias("ai_analysis"),
                         (F.col("toxic") == 1).alias("is_scenario_error"),
                         F.when(F.col("toxic") == 1, F.col("lang")).alias("error_label"))
    return FA.case_defaults(cases).select("doc_id", "is_scenario_error", "error_label", "has_ai",
                                          F.col("ai_analysis.tag").alias("tag"))


def history_semi(spark, d):
    runs = _runs(spark, d)
    names = FA.failing_names(FA.failing_runs(runs, BUILD))
    return FA.history_semi(runs, names, BUILD).select("id", "build", "name", "status", "duration_s")


def last_n_runs(spark, d):
    runs = _runs(spark, d)
    names = FA.failing_names(FA.failing_runs(runs, BUILD))
    return FA.last_n_runs(runs, names, BUILD).select("name", "rn", "build", "status", "id")


def failure_history(spark, d):
    entries = _history(spark, d).select("id", F.posexplode("history").alias("pos", "h"))
    return entries.select("id", "pos", "h.build", "h.status", "h.duration", "h.current")


def history_rate(spark, d):
    h = F.col("history")
    return _history(spark, d).select("id", H.passed_count(h).alias("passed"), F.size(h).alias("total"),
                                     H.pass_rate_text(h).alias("history_rate"))


def failure_class(spark, d):
    return FA.failure_class(_runs(spark, d), BUILD).select(
        "id", "scenario", "config", "name", "status", "history_rate", "history_note")


def failure_class_prompt(spark, d):
    h = F.col("history")
    return _history(spark, d).select("id", H.prompt_rate(h).alias("rate"), H.prompt_note(h).alias("note"))


def history_tail(spark, d):
    return _history(spark, d).select("id", H.history_tail(F.col("history")).alias("tail"))


def _groups(spark, d):
    """Scenario groups of every run that ever failed."""
    failing = _runs(spark, d).filter(H.is_failing(F.col("status")))
    return FA.scenario_groups(FA.clean_cases(failing))


def scenario_groups(spark, d):
    runs = _runs(spark, d)
    groups = FA.scenario_groups(FA.clean_cases(FA.failing_runs(runs, BUILD)))
    return groups.select("scenario", "config", "part", "jira", "jira_url",
                         F.size("test_cases").alias("n_cases"),
                         F.array_join("test_cases.name", "|").alias("names"),
                         F.array_join(F.transform("test_cases", lambda t: t["id"].cast("string")), ",").alias("ids"))


PART = 20


def scenario_parts(spark, d):
    """Every failing run of all builds, nested in lists of PART cases: parts are ranges of the group's order."""
    failing = _runs(spark, d).filter(H.is_failing(F.col("status")))
    groups = FA.scenario_groups(FA.clean_cases(failing), PART)
    return groups.select("scenario", "config", "part", F.size("test_cases").alias("n_cases"), F.array_join("test_cases.name", "|").alias("names"),
                         F.array_join(F.transform("test_cases", lambda t: t["id"].cast("string")), ",").alias("ids"))


def scenario_order(spark, d):
    return FA.scenario_order(FA.failing_runs(_runs(spark, d), BUILD)).orderBy("scenario", "first_name", "config")


def case_rows_query(spark, d):
    return case_rows(_groups(spark, d)).select(
        "id", "scenario", F.col("scenario_config").alias("config"), "name", "status", "duration", "failure_message")


def _sources(spark, d):
    runs = _runs(spark, d)
    odd = F.col("id") % 2 == 1
    return MG.union_sources({"B": FA.clean_cases(runs.filter(odd)), "A": FA.clean_cases(runs.filter(~odd)), "none": None})


def union_sources(spark, d):
    return _sources(spark, d).select("source", "source_ord", "id", "name", "status", "duration")


def failed_badge(spark, d):
    failing = _sources(spark, d).filter(H.is_failing(F.col("status")))
    return FA.failed_badge(FA.scenario_groups(failing))


def source_counts(spark, d):
    perf = view(spark, d, "perf")
    odd = F.col("id") % 2 == 1
    metrics = MG.union_sources({"B": perf.filter(odd), "A": perf.filter(~odd)})
    return MG.source_counts(_sources(spark, d).filter(H.is_failing(F.col("status"))), metrics)


def gate(spark, d):
    return FA.gate(FA.failing_runs(_runs(spark, d), BUILD))


QUERIES = {
    "failing_runs": (failing_runs, with_views("runs") + f"""
        SELECT scenario, config, name, status, duration_s, failure_msg, left(failure_txt, 8192) AS failure_txt,
               jira, jira_url, task_url, log_url, id
        FROM runs WHERE build = '{BUILD}' AND status IN {FAILING} ORDER BY scenario, name, config, id"""),
    "text_head_cap": (text_head_cap, "SELECT doc_id, left(text, 8192) AS failure_txt FROM documents"),
    "linkable_cases": (linkable_cases, with_views("runs") + """
        SELECT id, name, log_url FROM runs WHERE log_url IS NOT NULL AND log_url NOT IN ('', '#')"""),
    "link_fallback": (link_fallback, with_views("runs") + f"""
        SELECT id,
               CASE WHEN jira_url <> '' THEN jira_url WHEN jira <> '' THEN '{JIRA_BASE}' || jira ELSE '#' END AS jira_url,
               CASE WHEN task_url <> '' THEN task_url ELSE '{TASK_BASE}' || regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') END AS task_url,
               CASE WHEN log_url <> '' THEN log_url ELSE '{LOG_BASE}' || regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') END AS log_url
        FROM runs"""),
    "env_inherit": (env_inherit, with_views("runs") + """
        SELECT id, CASE WHEN jira <> '' THEN config ELSE scenario END AS config,
               CASE WHEN failure_msg <> '' THEN failure_msg ELSE 'linux' END AS os, coalesce(jira, '') AS agent FROM runs"""),
    "case_defaults": (case_defaults, """
        SELECT doc_id, coalesce(toxic = 1, false) AS is_scenario_error,
               CASE WHEN toxic = 1 THEN lang ELSE '' END AS error_label,
               coalesce(quality = 1 AND text <> '', false) AS has_ai,
               CASE WHEN quality IS NOT NULL THEN source END AS tag
        FROM documents LEFT JOIN labels USING (doc_id)"""),
    "history_semi": (history_semi, with_views("runs", more=FAILED_NOW) + f"""
        SELECT id, build, name, status, duration_s FROM runs
        WHERE build <> '{BUILD}' AND name IN (SELECT name FROM now)"""),
    "last_n_runs": (last_n_runs, with_views("runs", more=LAST) + "SELECT name, rn, build, status, id FROM last"),
    "failure_history": (failure_history, with_views("runs", more=LAST) + f"""
        , n AS (SELECT name, max(rn) AS n FROM last GROUP BY name)
        SELECT now.id, cast(n.n - last.rn AS integer) AS pos, last.build, last.status,
               {DURATION.format(c='last.duration_s')} AS duration, false AS current
        FROM now JOIN last ON now.name = last.name JOIN n ON n.name = last.name
        UNION ALL
        SELECT now.id, cast(coalesce(n.n, 0) AS integer), 'current', now.status,
               {DURATION.format(c='now.duration_s')}, true
        FROM now LEFT JOIN n ON n.name = now.name"""),
    "history_rate": (history_rate, with_views("runs", more=COUNTED) + """
        SELECT id, cast(ok AS integer) AS passed, cast(n + 1 AS integer) AS total,
               ok || ' / ' || (n + 1) || ' passed' AS history_rate FROM c"""),
    "failure_class": (failure_class, with_views("runs", more=COUNTED) + """
        SELECT id, now.scenario, now.config, c.name, c.status, ok || ' / ' || (n + 1) || ' passed' AS history_rate,
               CASE WHEN n = 0 THEN ''
                    WHEN bad = 0 THEN 'first failure — consistent pass until current build'
                    WHEN bad >= greatest(1, n // 2) THEN 'recurring failure — flaky or persistent issue'
                    ELSE 'intermittent — ' || bad || ' prior failure(s) in window' END AS history_note
        FROM c JOIN now USING (id)"""),
    "failure_class_prompt": (failure_class_prompt, with_views("runs", more=COUNTED) + """
        SELECT id, ok || ' / ' || (n + 1) || ' passed' AS rate,
               CASE WHEN n = 0 THEN ''
                    WHEN bad = 0 THEN 'first failure — was consistently passing before this build'
                    WHEN bad >= greatest(1, n // 2) THEN 'recurring — ' || bad || ' of ' || n || ' prior runs also failed'
                    ELSE 'intermittent — ' || bad || ' prior failure(s) in window' END AS note FROM c"""),
    "history_tail": (history_tail, with_views("runs", more=LAST) + """
        , e AS (SELECT now.id, -last.rn AS o, last.build, last.status FROM now JOIN last ON now.name = last.name
                UNION ALL SELECT id, 0, 'current', status FROM now)
        SELECT id, string_agg('  #' || build || ': ' || status, chr(10) ORDER BY o) AS tail FROM e GROUP BY id"""),
    "scenario_groups": (scenario_groups, with_views("runs", more=FAILED_NOW) + """
        SELECT scenario, config, 0 AS part, '' AS jira, '#' AS jira_url, cast(count(*) AS integer) AS n_cases,
               string_agg(name, '|' ORDER BY name, ran_at, id) AS names,
               string_agg(cast(id AS varchar), ',' ORDER BY name, ran_at, id) AS ids
        FROM now GROUP BY scenario, config"""),
    "scenario_parts": (scenario_parts, with_views("runs", more=f"""
        r AS (SELECT *, cast((row_number() OVER (PARTITION BY scenario, config ORDER BY name, ran_at, id) - 1) // {PART} AS integer) AS part
              FROM runs WHERE status IN {FAILING})""") + """
        SELECT scenario, config, part, cast(count(*) AS integer) AS n_cases, string_agg(name, '|' ORDER BY name, ran_at, id) AS names,
               string_agg(cast(id AS varchar), ',' ORDER BY name, ran_at, id) AS ids
        FROM r GROUP BY scenario, config, part"""),
    "scenario_order": (scenario_order, with_views("runs", more=FAILED_NOW) + """
        SELECT scenario, config, min(name) AS first_name, count(*) AS n_cases FROM now
        GROUP BY scenario, config ORDER BY 1, 3, 2"""),
    "case_rows": (case_rows_query, with_views("runs") + f"""
        SELECT id, scenario, config, name, status, {DURATION.format(c='duration_s')} AS duration,
               trim(coalesce(failure_msg, ''), ' ' || chr(9) || chr(10)) AS failure_message
        FROM runs WHERE status IN {FAILING}"""),
    "union_sources": (union_sources, with_views("runs") + f"""
        SELECT CASE WHEN id % 2 = 1 THEN 'B' ELSE 'A' END AS source, CASE WHEN id % 2 = 1 THEN 0 ELSE 1 END AS source_ord,
               id, name, status, {DURATION.format(c='duration_s')} AS duration FROM runs"""),
    "failed_badge": (failed_badge, with_views("runs") + f"SELECT count(*) AS failed FROM runs WHERE status IN {FAILING}"),
    "source_counts": (source_counts, with_views("runs", "perf") + f"""
        SELECT a.source, n_cases, n_models FROM
          (SELECT CASE WHEN id % 2 = 1 THEN 'B' ELSE 'A' END AS source, count(*) AS n_cases FROM runs
           WHERE status IN {FAILING} GROUP BY 1) a JOIN
          (SELECT CASE WHEN id % 2 = 1 THEN 'B' ELSE 'A' END AS source, count(DISTINCT model) AS n_models FROM perf GROUP BY 1) b
          ON a.source = b.source"""),
    "gate": (gate, with_views("runs", more=FAILED_NOW) + "SELECT CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS gate FROM now"),
}
