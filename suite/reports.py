"""Merged attributes, prompts, scoring and checks."""

from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions import terms as S
from buildlens.operators import analysis as AN
from buildlens.operators import failures as FA
from buildlens.operators import logs as LG
from buildlens.operators import merge as MG
from buildlens.operators import nesting as NE
from buildlens.operators import quality as Q
from buildlens.operators import tickets as TK
from buildlens.operators.sizing import work_path
from buildlens.plans import saved
from buildlens.plans.report import Settings, Source, build_report
from buildlens.sources import logs as LF
from suite.failures import COUNTED, DURATION
from suite.metrics import DELTAS
from suite.tables import BUILD, LOG_BASE, REF_BUILD, table, view, with_views
from suite.text import SPACES

INFO = {"number": BUILD, "branch": "main", "ref_build": REF_BUILD}
CONTEXT = "Nightly runs on eight agents."


def pending_analysis(spark, d):
    """Labelled documents count as analysed unless their text was left blank."""
    notes = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, F.lit(" \n\t"))
    cases = notes.select("doc_id", "source", F.struct(text.alias("text")).alias("ai_analysis"))
    return AN.pending_analysis(cases).select("doc_id", "source")


def _attrs(spark, d):
    """Every event sets an attribute of its build; its source is its user."""
    runs = view(spark, d, "runs")
    return runs.select("build", F.col("scenario").alias("key"), F.col("name").alias("value"), F.col("id").alias("source_ord"))


def attr_merge(spark, d):
    return MG.merge_attributes(_attrs(spark, d))


def badge_merge(spark, d):
    runs = view(spark, d, "runs")
    badges = runs.select("build", F.when(F.col("status") == "fail", "failed").otherwise(F.col("status")).alias("key"),
                         F.floor("duration_s").alias("value"), F.col("id").alias("source_ord"))
    failing = runs.filter(F.col("status").isin(V.FAILING_STATUSES))
    return MG.merge_badges(badges, failing)


def dq_violations(spark, d):
    """All events as cases and as metrics of their builds, conversation heads as builds."""
    e = table(spark, d, "events").withColumn("build", (F.dayofmonth("ts") + 1217).cast("string"))
    i, j = (F.col("user_id") % 5).alias("i"), F.col("event_id").alias("j")
    props = F.when(F.col("value") > 200, F.lit("")).when(F.col("value") > 3, F.col("props"))
    cases = e.select("build", i, j, props.alias("name"), F.when(F.col("value") > 5, F.regexp_replace("event_type", "click|view|signup", "fail")).alias("status"))
    metrics = e.select("build", i, j, F.col("event_type").alias("name"),
                       F.when(F.col("value") < 190, F.col("value")).alias("current"),
                       F.when(F.col("value") < 1, "sideways").when(F.col("value") > 20, "lower_better").otherwise("").alias("direction"))
    groups = e.select("build", "event_id", F.col("event_id").alias("i"), props.alias("scenario"))
    builds = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("build"),
                                                     F.when(F.col("turn") > 0, F.col("text")).otherwise(" \n").alias("number"))
    return (
        Q.build_violations(builds)
        .unionByName(Q.scenario_violations(groups))
        .unionByName(Q.case_violations(cases))
        .unionByName(Q.model_violations(groups.withColumnRenamed("scenario", "model")))
        .unionByName(Q.metric_violations(metrics))
    )


def prompt_text(spark, d):
    """Failing cases with history; their document is the ticket, the message's log and the details."""
    runs, tickets = view(spark, d, "runs"), view(spark, d, "tickets")
    cases = FA.failure_history(FA.clean_cases(FA.failing_runs(runs, BUILD)), runs, BUILD)
    cases = cases.withColumn("direct_key", S.direct_key(F.lit(None).cast("string"), F.col("name")))
    direct = TK.direct_tickets(cases, tickets).select("id", F.array("ticket").alias("jira_context"))
    logs = table(spark, d, "documents").select(F.concat(F.lit("case "), F.col("doc_id").cast("string"), F.lit(" [PIPE-"), F.col("doc_id").cast("string"), F.lit("]")).alias("name"), F.col("text").alias("log"))
    full = cases.join(direct, "id", "left").join(logs, "name", "left").withColumn("failure_text", F.concat("failure_text", F.lit(" "), F.coalesce("log", F.lit(""))))
    return AN.with_prompt(full, INFO, CONTEXT).select("id", "prompt")


def prompt_sections(spark, d):
    """Every conversation turn as a case without history, some without texts."""
    turns = view(spark, d, "turns").select(
        "id", "name", F.lit("timeout").alias("status"), F.lit("3m 12s").alias("duration"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("failure_message")).alias("failure_message"),
        F.when(F.col("id") % 2 == 0, F.lit(" \n")).otherwise(F.col("failure_text")).alias("failure_text"),
        F.array().cast("array<struct<build:string,status:string,duration:string,current:boolean>>").alias("history"))
    return AN.with_prompt(turns, {"number": BUILD}).select("id", "prompt")


LOG_TAIL = 2000


def log_chain(spark, d):
    """From log files to prompts: the logs of a build's failing cases, one file for each link, are listed, fetched by their last bytes,
    attached to their cases and put into the prompts. The documents stand in for the logs; some links have none."""
    runs = view(spark, d, "runs")
    cases = FA.clean_cases(FA.failing_runs(runs, BUILD), log_base=LOG_BASE)
    requests = LG.log_requests(cases)
    number = F.regexp_extract("name", r"case (\d+)", 1).cast("long")
    texts = table(spark, d, "documents").filter("lang = 'en' AND octet_length(text) = length(text)").select("doc_id", "text")
    folder, kept = work_path(spark), work_path(spark)
    # The number of files takes the time, not their size, by which a few tasks would write them all.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests.withColumn("doc_id", number).join(texts, "doc_id").select("key", "text").repartition(tasks, "key").write.partitionBy("key").text(folder)
    records = LF.ingest(spark, requests, LF.list_logs(spark, folder, "*.txt", by_folder="key"), kept, tail_bytes=LOG_TAIL)
    logs = LF.log_text(LF.read_stored(spark, kept)).select("path", F.col("path").alias("file"), "text")
    picked = LG.read_picked(LG.pick_log(LG.attach_fetched(cases, requests, records), logs), logs)
    asked = picked.select("id", "name", "status", F.lit("1s").alias("duration"), F.lit("").alias("failure_message"), F.lit("").alias("failure_text"),
                          F.array().cast("array<struct<build:string,status:string,duration:string,current:boolean>>").alias("history"), "log")
    return AN.with_prompt(asked, {"number": BUILD}).select("id", "log", "prompt")


def report_round_trip(spark, d):
    """A report of three sources, one of which fails, saved, read again and flattened as a document."""
    runs, perf = view(spark, d, "runs"), view(spark, d, "perf")
    odd = F.col("id") % 2 == 1

    def broken():
        raise OSError("no such table")

    sources = {"B": Source(runs.filter(odd), perf, {"branch": "main"}, {"passed": 3}), "none": broken, "A": Source(runs.filter(~odd), None, {"commit": "c{build}"})}
    path = work_path(spark)
    saved.save(build_report(sources, Settings(BUILD, REF_BUILD), {"branch": "old", "ref_build": REF_BUILD}, {"failed": 9, "passed": 1}), path, "collected")
    back = saved.load(spark, path)
    document = saved.document(back)
    gate = back.gate.first()["gate"]
    failed = F.col("build.badges")["failed"]
    heads = document.select("piece", failed.alias("failed"), F.col("build.branch").alias("branch"))
    cases = NE.report_cases(document).select(
        F.lit("case").alias("kind"), F.concat_ws("/", "build", "ref_build", "scenario", "scenario_config").alias("group"), "name",
        F.concat_ws("/", "status", "duration").alias("detail"), F.size("history").cast("double").alias("value"))
    metrics = NE.report_metrics(document).select(
        F.lit("metric").alias("kind"), "model", F.col("metric_name").alias("name"), F.concat_ws("/", "unit", "direction").alias("detail"), F.col("current").alias("value"))
    ends = heads.groupBy("branch", "failed").agg(F.count_distinct("piece").alias("pieces")).select(
        F.lit("build").alias("kind"), "branch", F.lit(str(gate)).alias("name"), F.col("failed").cast("string").alias("detail"), F.col("pieces").cast("double").alias("value"))
    sources_seen = back.sources.select(F.lit("source").alias("kind"), "source", F.col("ok").cast("string").alias("name"), F.coalesce("error", F.lit("")).alias("detail"),
                                       (F.col("n_cases") + F.col("n_models")).cast("double").alias("value"))
    return cases.union(metrics).union(ends).union(sources_seen)


def user_scoring(spark, d):
    """A deterministic stand-in for a user's scoring function, over every conversation turn."""
    def call(system: str, prompt: str) -> str:
        if "403" in prompt:
            raise ValueError("refused")
        if "der " in prompt:
            return "not JSON: " + str(len(prompt))
        return '{"text": "prompt of %d characters", "tag": "LENGTH"}' % len(prompt)

    prompts = prompt_sections(spark, d)
    return AN.score(prompts, call).select("id", "ai_analysis.*")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HEAD = "'## Failing test' || chr(10) || 'Name: ' || {n} || chr(10) || 'Status: ' || upper({s}) || '  Duration: ' || {d}"
FAILURE = """'## Failure' || chr(10) || CASE WHEN {m} <> '' THEN 'Message: ' || {m} || chr(10) ELSE '' END
    || CASE WHEN {t} <> '' THEN chr(10) || 'Details:' || chr(10) || left({t}, 2000) ELSE '' END
    || CASE WHEN {m} = '' AND {t} = '' THEN '(no failure details captured)' ELSE '' END"""
NL2 = " || chr(10) || chr(10) || "

QUERIES = {
    "pending_analysis": (pending_analysis, """
        SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0"""),
    "attr_merge": (attr_merge, with_views("runs") + """
        SELECT build, scenario AS key, arg_max(name, id) AS value FROM runs GROUP BY build, scenario"""),
    "badge_merge": (badge_merge, with_views("runs") + """
        SELECT build, status AS key, cast(floor(arg_max(duration_s, id)) AS bigint) AS value FROM runs
        WHERE status <> 'fail' GROUP BY build, status
        UNION ALL
        SELECT build, 'failed', count(*) FILTER (status IN ('fail', 'error', 'timeout')) FROM runs GROUP BY build"""),
    "dq_violations": (dq_violations, """
        WITH e AS (SELECT *, cast(1217 + day(ts) AS varchar) AS build, coalesce(value > 200 OR value <= 3, true) AS blank,
                          replace(replace(replace(event_type, 'click', 'fail'), 'view', 'fail'), 'signup', 'fail') AS st FROM events),
        p AS (SELECT *, 'failures[' || (user_id % 5) || '].test_cases[' || event_id || ']' AS cloc,
                     'performance[' || (user_id % 5) || '].metrics[' || event_id || ']' AS mloc FROM e)
        SELECT cast(conv_id AS varchar) AS build, 'build' AS location, 'build.number is missing — was a build name provided?' AS message
        FROM conversations WHERE turn = 0
        UNION ALL SELECT build, 'failures[' || event_id || ']', 'missing ''scenario'' field' FROM p WHERE blank
        UNION ALL SELECT build, cloc, 'missing ''name'' field' FROM p WHERE blank
        UNION ALL SELECT build, cloc, 'unknown status ''' || st || ''' — expected one of [''error'', ''fail'', ''skip'', ''timeout'']'
                  FROM p WHERE value > 5 AND st NOT IN ('fail', 'error')
        UNION ALL SELECT build, 'performance[' || event_id || ']', 'missing ''model'' field' FROM p WHERE blank
        UNION ALL SELECT build, mloc, 'missing ''current'' value' FROM p WHERE value >= 190
        UNION ALL SELECT build, mloc, 'invalid direction ''sideways'' — expected one of [''higher_better'', ''lower_better'']' FROM p WHERE value < 1"""),
    "prompt_text": (prompt_text, with_views("runs", "tickets", more=COUNTED) + f"""
        , e AS (SELECT now.id, -last.rn AS o, last.build, last.status FROM now JOIN last ON now.name = last.name
                UNION ALL SELECT id, 0, 'current', status FROM now),
        h AS (SELECT id, string_agg('  #' || build || ': ' || status, chr(10) ORDER BY o) AS tail FROM e GROUP BY id),
        x AS (SELECT c.*, h.tail, now.duration_s, trim(coalesce(now.failure_msg, ''), {SPACES}) AS msg,
                     trim(now.failure_txt, {SPACES}) || ' ' || coalesce(doc.text, '') AS txt, doc.text AS log, t.*
              FROM c JOIN now USING (id) JOIN h USING (id)
              LEFT JOIN documents doc ON now.name = 'case ' || doc.doc_id || ' [PIPE-' || doc.doc_id || ']'
              LEFT JOIN (SELECT key, status AS tstatus, type, priority, summary FROM tickets) t
                ON t.key = regexp_extract(now.name, 'PIPE-[0-9]+')),
        y AS (SELECT *, CASE WHEN n = 0 THEN '' WHEN bad = 0 THEN chr(10) || 'first failure — was consistently passing before this build'
                 WHEN bad >= greatest(1, n // 2) THEN chr(10) || 'recurring — ' || bad || ' of ' || n || ' prior runs also failed'
                 ELSE chr(10) || 'intermittent — ' || bad || ' prior failure(s) in window' END AS note FROM x)
        SELECT id, '## Build' || chr(10) || 'Build #{BUILD}  Branch: main  Ref: #{REF_BUILD}' {NL2} '## System context' || chr(10) || '{CONTEXT}'
               {NL2} {HEAD.format(n='name', s='status', d='(' + DURATION.format(c='duration_s') + ')')} {NL2} {FAILURE.format(m='msg', t=f'trim(txt, {SPACES})')}
               || CASE WHEN key IS NULL THEN '' ELSE chr(10) || chr(10) || '## JIRA tickets' || chr(10) || '■ ' || key || ' [' || type || ' · ' || tstatus || '] ' || priority || ' — ' || summary END
               {NL2} '## History' || chr(10) || ok || ' / ' || (n + 1) || ' passed' || note || chr(10) || tail
               || CASE WHEN log IS NULL THEN '' ELSE chr(10) || chr(10) || '## Log' || chr(10) || left(log, 3000) END
               {NL2} {_sql(V.INSTRUCTION)} AS prompt
        FROM y"""),
    "prompt_sections": (prompt_sections, with_views("turns", more=f"""
        x AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN '' ELSE trim(failure_message, {SPACES}) END AS msg,
                     CASE WHEN id % 2 = 0 THEN '' ELSE trim(failure_text, {SPACES}) END AS txt FROM turns)""") + f"""
        SELECT id, '## Build' || chr(10) || 'Build #{BUILD}  Branch: ?  Ref: #?' {NL2} {HEAD.format(n='name', s="'timeout'", d="'3m 12s'")}
               {NL2} {FAILURE.format(m='msg', t='txt')} {NL2} '## History' || chr(10) || 'no prior history' {NL2} {_sql(V.INSTRUCTION)} AS prompt
        FROM x"""),
    "log_chain": (log_chain, with_views("runs", more=f"""
        logs AS (SELECT doc_id, trim(right(text || chr(10), {LOG_TAIL}), {SPACES}) AS log FROM documents WHERE lang = 'en' AND strlen(text) = length(text)),
        x AS (SELECT id, name, status, log FROM runs
              LEFT JOIN logs ON cast(regexp_extract(name, 'case ([0-9]+)', 1) AS bigint) = doc_id AND log_url IS DISTINCT FROM '#'
              WHERE build = '{BUILD}' AND status IN ('fail', 'error', 'timeout'))""") + f"""
        SELECT id, log, '## Build' || chr(10) || 'Build #{BUILD}  Branch: ?  Ref: #?' {NL2} {HEAD.format(n='name', s='status', d="'1s'")}
               {NL2} '## Failure' || chr(10) || '(no failure details captured)' {NL2} '## History' || chr(10) || 'no prior history'
               || CASE WHEN coalesce(log, '') = '' THEN '' ELSE chr(10) || chr(10) || '## Log' || chr(10) || log END
               {NL2} {_sql(V.INSTRUCTION)} AS prompt
        FROM x"""),
    "report_round_trip": (report_round_trip, with_views("runs", "perf", more=DELTAS + f"""
        , now AS (SELECT *, id % 2 AS parity FROM runs WHERE build = '{BUILD}' AND status IN ('fail', 'error', 'timeout')),
        prior AS (SELECT name, id % 2 AS parity, count(*) AS n FROM runs WHERE build <> '{BUILD}' GROUP BY ALL),
        size AS (SELECT (SELECT count(*) FROM now) AS cases, (SELECT count(DISTINCT model) FROM m) AS models,
                        (SELECT count(*) FROM (SELECT DISTINCT parity, scenario, config FROM now)) AS groups)""") + f"""
        SELECT 'case' AS kind, '{BUILD}/{REF_BUILD}/' || scenario || '/' || config AS "group", name,
               status || '/' || {DURATION.format(c='duration_s')} AS detail, cast(least(7, coalesce(n, 0)) + 1 AS double) AS value
        FROM now LEFT JOIN prior USING (name, parity)
        UNION ALL SELECT 'metric', model, metric_name, unit || '/' || direction, current FROM m
        UNION ALL SELECT 'build', 'main', CASE WHEN cases > 0 THEN '2' ELSE '0' END, cast(cases AS varchar), cast(models + groups AS double) FROM size
        UNION ALL SELECT 'source', 'B', 'true', '', cast(models + (SELECT count(*) FROM now WHERE parity = 1) AS double) FROM size
        UNION ALL SELECT 'source', 'A', 'true', '', cast((SELECT count(*) FROM now WHERE parity = 0) AS double)
        UNION ALL SELECT 'source', 'none', 'false', 'OSError: no such table', 0"""),
    "user_scoring": (user_scoring, with_views("turns", more=f"""
        x AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN '' ELSE trim(failure_message, {SPACES}) END AS msg,
                     CASE WHEN id % 2 = 0 THEN '' ELSE trim(failure_text, {SPACES}) END AS txt FROM turns),
        p AS (SELECT id, '## Build' || chr(10) || 'Build #{BUILD}  Branch: ?  Ref: #?' {NL2} {HEAD.format(n='name', s="'timeout'", d="'3m 12s'")}
               {NL2} {FAILURE.format(m='msg', t='txt')} {NL2} '## History' || chr(10) || 'no prior history' {NL2} {_sql(V.INSTRUCTION)} AS prompt FROM x)""") + """
        SELECT id, CASE WHEN contains(prompt, '403') THEN 'Analysis failed: refused' WHEN contains(prompt, 'der ') THEN 'not JSON: ' || length(prompt)
                        ELSE 'prompt of ' || length(prompt) || ' characters' END AS text,
               CASE WHEN contains(prompt, '403') THEN 'ANALYSIS ERROR' WHEN contains(prompt, 'der ') THEN 'AI ANALYSIS' ELSE 'LENGTH' END AS tag,
               CASE WHEN contains(prompt, '403') OR contains(prompt, 'der ') THEN 'warn' ELSE 'error' END AS tag_type
        FROM p"""),
}
