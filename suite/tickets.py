"""Direct and related tickets."""

from pyspark.sql import functions as F

from buildlens.functions import terms as S
from buildlens.operators import tickets as TK
from suite.tables import view, with_views
from suite.text import KEY, TERMS, W

FIRST = rf"regexp_extract(name, '(^|[^{W}])({KEY})($|[^{W}])', 2)"
PROJECTS = ["PIPE", "INFRA"]


def pending_tickets(spark, d):
    """Runs with a blank ticket count as done without result, those with one as enriched."""
    ticket = F.struct(F.col("jira").alias("key"))
    context = F.when(F.col("jira") == "", F.array().cast("array<struct<key:string>>")).when(F.col("jira") != "", F.array(ticket))
    runs = view(spark, d, "runs").withColumn("jira_context", context)
    return TK.pending_tickets(runs).select("id", "name")


def ticket_direct(spark, d):
    runs = view(spark, d, "runs")
    cases = runs.withColumn("direct_key", S.direct_key(F.col("jira"), F.col("name")))
    found = TK.direct_tickets(cases, view(spark, d, "tickets"))
    return found.select("id", "ticket.key", "ticket.summary", "ticket.status", "ticket.type", "ticket.priority", "ticket.match")


def ticket_related(spark, d):
    cases = TK.match_tickets(view(spark, d, "turns"), view(spark, d, "tickets"), PROJECTS)
    rows = cases.select("id", F.posexplode("jira_context").alias("pos", "t"))
    return rows.select("id", "pos", "t.key", "t.summary", "t.match")


RAW = """
    CASE doc_id % 3 WHEN 0 THEN 'PIPE-' WHEN 1 THEN 'INFRA-' ELSE 'OPS-' END || cast(doc_id AS string) AS key,
    named_struct('summary', source || ' ' || lang, 'status', named_struct('name', lang),
                 'issuetype', CASE WHEN doc_id % 4 > 0 THEN named_struct('name', source) END, 'priority', named_struct('name', cast(NULL AS string)),
                 'updated', CASE WHEN doc_id % 11 > 0 THEN '2024-01-' || lpad(cast(doc_id % 28 + 1 AS string), 2, '0') || 'T10:20:30.000+0530' END,
                 'description', text) AS fields
"""


def ticket_flatten(spark, d):
    """Documents as raw issue records, flattened and then searched by the conversation turns."""
    view(spark, d, "tickets")
    raw = spark.sql(f"SELECT {RAW} FROM base_documents")
    flat = TK.flatten_tickets(raw, "https://tracker.example/")
    cases = TK.match_tickets(view(spark, d, "turns"), flat, PROJECTS)
    hits = cases.select("id", F.explode("jira_context").alias("t")).groupBy("t.key").agg(F.count(F.lit(1)).alias("hits"))
    return flat.select("key", "summary", "status", "type", "priority", "url", "updated", F.length("text").cast("long").alias("chars")).join(hits, "key", "left")


QUERIES = {
    "pending_tickets": (pending_tickets, with_views("runs") + "SELECT id, name FROM runs WHERE jira IS NULL"),
    "ticket_direct": (ticket_direct, with_views("runs", "tickets", more=f"""
        k AS (SELECT id, CASE WHEN jira <> '' THEN jira ELSE {FIRST} END AS key FROM runs)""") + """
        SELECT id, key, summary, status, type, priority, 'direct' AS match FROM k JOIN tickets USING (key)"""),
    "ticket_related": (ticket_related, with_views("turns", "tickets", more=TERMS + rf""",
        asked AS (SELECT t.id, CASE WHEN jira <> '' THEN jira ELSE {FIRST} END AS direct_key, terms.ws[1:3] AS ws
                  FROM turns t JOIN terms ON t.id = terms.id),
        wanted AS (SELECT DISTINCT id, lower(unnest(ws)) AS token FROM asked),
        tokens AS (SELECT DISTINCT key, updated, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS token
                   FROM tickets WHERE key LIKE 'PIPE-%' OR key LIKE 'INFRA-%'),
        hits AS (SELECT DISTINCT id, key, updated FROM wanted JOIN tokens USING (token)),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, key DESC) AS rn FROM hits) WHERE rn <= 9),
        both_kinds AS (SELECT a.id, a.direct_key AS key, 'direct' AS match, 0 AS rn FROM asked a JOIN tickets ON tickets.key = a.direct_key
                  UNION ALL
                  SELECT top.id, top.key, 'related', top.rn FROM top JOIN asked a ON a.id = top.id WHERE top.key <> a.direct_key),
        ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY id ORDER BY rn) - 1 AS integer) AS pos FROM both_kinds)""") + """
        SELECT id, pos, key, summary, match FROM ranked JOIN tickets USING (key) WHERE pos < 5"""),
    "ticket_flatten": (ticket_flatten, with_views("turns", more=TERMS + rf""",
        tk AS (SELECT *, 'https://tracker.example/browse/' || key AS url, concat_ws(chr(10), summary, body) AS text FROM (
            SELECT CASE doc_id % 3 WHEN 0 THEN 'PIPE-' WHEN 1 THEN 'INFRA-' ELSE 'OPS-' END || doc_id AS key, source || ' ' || lang AS summary, lang AS status,
                   CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END AS type, '' AS priority, text AS body,
                   CASE WHEN doc_id % 11 > 0 THEN make_timestamp(2024, 1, doc_id % 28 + 1, 4, 50, 30.0) END AS updated FROM documents)),
        asked AS (SELECT t.id, CASE WHEN jira <> '' THEN jira ELSE {FIRST} END AS direct_key, terms.ws[1:3] AS ws
                  FROM turns t JOIN terms ON t.id = terms.id),
        wanted AS (SELECT DISTINCT id, lower(unnest(ws)) AS token FROM asked),
        tokens AS (SELECT DISTINCT key, updated, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS token
                   FROM tk WHERE key LIKE 'PIPE-%' OR key LIKE 'INFRA-%'),
        met AS (SELECT DISTINCT id, key, updated FROM wanted JOIN tokens USING (token)),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC NULLS LAST, key DESC) AS rn FROM met) WHERE rn <= 9),
        both_kinds AS (SELECT a.id, a.direct_key AS key, 0 AS rn FROM asked a JOIN tk ON tk.key = a.direct_key
                  UNION ALL SELECT top.id, top.key, top.rn FROM top JOIN asked a ON a.id = top.id WHERE top.key <> a.direct_key),
        h AS (SELECT key, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS pos FROM both_kinds) WHERE pos <= 5 GROUP BY key)""") + """
        SELECT tk.key, summary, status, type, priority, url, updated, length(text) AS chars, hits FROM tk LEFT JOIN h ON h.key = tk.key"""),
}
