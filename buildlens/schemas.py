"""Explicit schemas of every input and of the nested report; nothing is inferred."""

from pyspark.sql import types as T

TEST_RUNS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("build", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_s", T.FloatType()),
    T.StructField("failure_msg", T.StringType()),
    T.StructField("failure_txt", T.StringType()),
    T.StructField("jira", T.StringType()),
    T.StructField("jira_url", T.StringType()),
    T.StructField("task_url", T.StringType()),
    T.StructField("log_url", T.StringType()),
    T.StructField("ran_at", T.TimestampNTZType()),
])

PERFORMANCE_METRICS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("build", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("recorded_at", T.TimestampNTZType()),
])

FETCH_LOG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("connect_s", T.DoubleType()),
    T.StructField("transfer_s", T.DoubleType()),
    T.StructField("cached", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

RAW_TICKETS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("fields", T.StructType([
        T.StructField("summary", T.StringType()),
        T.StructField("status", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("issuetype", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("priority", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("updated", T.StringType()),
        T.StructField("description", T.StringType()),
    ])),
])

HISTORY = T.ArrayType(T.StructType([
    T.StructField("build", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("current", T.BooleanType()),
]))

ANALYSIS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("tag_type", T.StringType()),
])

TICKET_CONTEXT = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("match", T.StringType()),
]))

TEST_CASE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("failure_message", T.StringType()),
    T.StructField("failure_text", T.StringType()),
    T.StructField("jira", T.StringType()),
    T.StructField("jira_url", T.StringType()),
    T.StructField("task_url", T.StringType()),
    T.StructField("log_url", T.StringType()),
    T.StructField("history", HISTORY),
    T.StructField("ai_analysis", ANALYSIS),
    T.StructField("log_file", T.StringType()),
    T.StructField("search_hint", T.StringType()),
    T.StructField("jira_context", TICKET_CONTEXT),
    T.StructField("config", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("is_scenario_error", T.BooleanType()),
    T.StructField("error_label", T.StringType()),
])

SCENARIO = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("jira", T.StringType()),
    T.StructField("jira_url", T.StringType()),
    T.StructField("test_cases", T.ArrayType(TEST_CASE)),
])

METRIC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("current", T.DoubleType()),
    T.StructField("reference", T.DoubleType()),
    T.StructField("history_values", T.ArrayType(T.DoubleType())),
    T.StructField("history_builds", T.ArrayType(T.StringType())),
])

CHIPS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("css_class", T.StringType()),
]))

MODEL = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("summary_note", T.StringType()),
    T.StructField("summary_chips", CHIPS),
    T.StructField("metrics", T.ArrayType(METRIC)),
])

BUILD = T.StructType([
    T.StructField("number", T.StringType()),
    T.StructField("build_url", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("branch_url", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("commit_url", T.StringType()),
    T.StructField("ref_build", T.StringType()),
    T.StructField("ref_build_url", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("badges", T.MapType(T.StringType(), T.LongType())),
])

REPORT = T.StructType([
    T.StructField("build", BUILD),
    T.StructField("failures", T.ArrayType(SCENARIO)),
    T.StructField("performance", T.ArrayType(MODEL)),
])
