"""The test tables seen as test runs, measurements, fetches, cases and tickets.

Every select list is valid in Spark and in DuckDB and keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUILD, REF_BUILD = "1247", "1244"
JIRA_BASE, TASK_BASE, LOG_BASE = "https://tracker.example/browse/", "https://ci.example/tasks/", "https://ci.example/logs/"

# One build per day: 1218..1247.
RUNS = """
    cast(1217 + day(ts) AS string) AS build,
    'suite-' || cast(user_id % 5 AS string) AS scenario,
    'cfg-' || cast(event_id % 2 AS string) AS config,
    'case ' || cast(user_id AS string) || ' [PIPE-' || cast(user_id AS string) || ']' AS name,
    CASE WHEN event_type = 'error' THEN CASE WHEN value < 50 THEN 'fail' WHEN value < 100 THEN 'error' ELSE 'timeout' END
         WHEN event_type = 'signup' AND value > 100 THEN 'skip' ELSE 'pass' END AS status,
    value AS duration_s,
    CASE event_type WHEN 'error' THEN chr(9) || ' HTTP ' || cast(400 + event_id % 200 AS string) || ' on ' || props || chr(10)
                    WHEN 'click' THEN '' END AS failure_msg,
    props AS failure_txt,
    CASE user_id % 4 WHEN 0 THEN 'INFRA-' || cast(user_id AS string) WHEN 1 THEN '' END AS jira,
    CASE event_id % 3 WHEN 0 THEN 'https://kept.example/t/' || cast(event_id AS string) WHEN 1 THEN '' END AS jira_url,
    CASE event_id % 5 WHEN 0 THEN 'https://kept.example/j/' || cast(event_id AS string) WHEN 1 THEN '' END AS task_url,
    CASE event_id % 4 WHEN 0 THEN 'https://kept.example/l/' || cast(event_id AS string) WHEN 1 THEN '#' WHEN 2 THEN '' END AS log_url,
    ts AS ran_at,
    event_id AS id
"""

# 20 models x 5 metrics; several writes per cell and real gaps.
PERF = """
    cast(1217 + day(ts) AS string) AS build,
    'model-' || cast(user_id % 20 AS string) AS model,
    event_type AS metric_name,
    CASE WHEN event_id % 7 = 0 THEN 'ms' ELSE 'u' END AS unit,
    CASE WHEN event_type IN ('view', 'error') THEN 'lower_better' ELSE 'higher_better' END AS direction,
    value,
    ts AS recorded_at,
    event_id AS id
"""

FETCHES = """
    'source-' || cast(user_id % 3 AS string) AS source,
    'log ' || cast(event_id AS string) AS key,
    'https://ci.example/logs/' || cast(event_id AS string) AS url,
    event_type <> 'error' AS ok,
    'logs/' || cast(event_id AS string) || '.log' AS path,
    cast(floor(value * 1000) AS bigint) AS bytes,
    cast(floor(value) AS double) / 8 AS s,
    cast(floor(value) AS double) / 40 AS connect_s,
    cast(floor(value) AS double) / 20 AS transfer_s,
    event_type = 'view' AS cached,
    ts,
    event_id AS id
"""

SPANS = """
    'tool-' || cast(user_id AS string) AS source,
    event_type AS span,
    value AS seconds,
    CASE WHEN day(ts) <= 15 THEN 'before' ELSE 'after' END AS phase
"""

# Documents as tickets: three projects, newest = longest.
TICKETS = """
    CASE doc_id % 3 WHEN 0 THEN 'PIPE-' WHEN 1 THEN 'INFRA-' ELSE 'OPS-' END || cast(doc_id AS string) AS key,
    source || ' ' || lang AS summary,
    lang AS status,
    source AS type,
    CASE WHEN n_chars > 2000 THEN 'High' ELSE 'Low' END AS priority,
    'https://tracker.example/browse/' || cast(doc_id AS string) AS url,
    n_chars AS updated,
    text
"""

# Conversation turns as cases with long names and texts.
TURNS = """
    conv_id * 1000 + turn AS id,
    role AS scenario,
    'cfg' AS config,
    CASE conv_id % 3 WHEN 0 THEN 'Turn [PIPE-' || cast(conv_id AS string) || '] ' || text ELSE text END AS name,
    CASE WHEN turn % 2 = 0 THEN text ELSE 'HTTP 503 from API_GATEWAY: ' || text END AS failure_message,
    CASE WHEN turn % 2 = 1 THEN text ELSE 'code 404, then 500: ' || text END AS failure_text,
    CASE conv_id % 4 WHEN 0 THEN 'INFRA-' || cast(conv_id AS string) WHEN 1 THEN '' END AS jira,
    CASE turn % 5 WHEN 3 THEN text WHEN 4 THEN '  ' END AS search_hint
"""

# Documents whose text gets issue keys around it.
KEYED = """
    doc_id,
    CASE doc_id % 5 WHEN 0 THEN '[PIPE-' || cast(doc_id AS string) || '] ' || text
                    WHEN 1 THEN text || ' QA7-33'
                    WHEN 2 THEN 'éPIPE-9 ' || text || ' A-1 x_PIPE-2'
                    WHEN 3 THEN 'PIPE-12a ' || text || ' (OPS-7)'
                    ELSE text END AS name
"""

VIEWS = {
    "runs": ("events", RUNS),
    "perf": ("events", PERF),
    "fetches": ("events", FETCHES),
    "spans": ("events", SPANS),
    "tickets": ("documents", TICKETS),
    "turns": ("conversations", TURNS),
    "keyed": ("documents", KEYED),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    table(spark, sf_dir, base).createOrReplaceTempView(f"base_{base}")
    return spark.sql(f"SELECT {columns} FROM base_{base}")


def with_views(*names: str, more: str = "") -> str:
    """WITH clause defining the views (and further CTEs) for the SQL side."""
    parts = [f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"
