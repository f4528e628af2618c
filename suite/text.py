"""Text, number and label functions over whole columns."""

from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions import terms as S
from buildlens.functions import text as X
from buildlens.functions.numbers import compact_number
from buildlens.functions.prompts import parse_response, ticket_lines
from suite.failures import DURATION
from suite.tables import BUILD, table, view, with_views

SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
W = r"\p{L}\p{N}_"
WORDS = rf"regexp_extract_all({{c}}, '[{W}]+')"


def on(template: str, column: str) -> str:
    """Template with the column filled in."""
    return template.replace("{c}", column)


KEY = r"[A-Z][A-Z0-9]+-\p{Nd}+"
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(V.STOP_WORDS)) + "]"
FIRST_KEY = rf"regexp_extract({{c}}, '(^|[^{W}])({KEY})($|[^{W}])', 2)"
BARE = rf"regexp_replace({{c}}, '(^|[^{W}]){KEY}($|[^{W}])', '\1\2', 'g')"


def words_where(c, pattern, more=""):
    return f"list_filter({on(WORDS, c)}, lambda w: regexp_full_match(w, '{pattern}'){more})"


CODES = words_where("{c}", r"[45]\p{Nd}{2}")
UPPERS = words_where("{c}", "[A-Z][A-Z0-9_]{2,}")
PLAIN = words_where("lower({c})", "[a-z]{4,}", f" AND NOT list_contains({STOP_LIST}, w)")


def _docs(spark, d):
    return table(spark, d, "documents")


def _joined(c):
    return F.array_join(c, ",")


def blank_normalise(spark, d):
    edge = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\t\xa0 ")).otherwise(F.lit(" \r\n"))
    c = F.when(F.col("lang") != "de", F.concat(edge, F.col("text"), edge))
    return _docs(spark, d).select("doc_id", X.normalise_blank(c).alias("failure_message"))


def build_template(spark, d):
    c = F.concat(F.col("url"), F.lit("/{build}/"), F.col("html"), F.lit("{build}"))
    pages = table(spark, d, "pages").select("page_id", "url", c.alias("c"))
    return pages.select(
        "page_id",
        X.fill_build(F.col("c"), BUILD).alias("filled"),
        F.array_join(X.fill_build_list(F.array("url", F.lit("{build}.xml"), F.lit("x")), BUILD), "|").alias("listed"),
        X.fill_build_map(F.create_map(F.lit("{build}"), F.concat(F.col("url"), F.lit("#{build}"))), BUILD)["{build}"].alias("mapped"))


def duration_text(spark, d):
    """Every run in seconds and every order line's price as seconds, as text, some unreadable."""
    runs = view(spark, d, "runs").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("k"), F.col("duration_s").cast("string").alias("s"))
    lines = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"),
        F.when(F.col("l_quantity") == 1, "n/a").when(F.col("l_quantity") == 2, "-1").when(F.col("l_quantity") > 2, (F.col("l_extendedprice") / 100).cast("string")).alias("s"))
    return runs.unionByName(lines).select("k", X.duration_text(F.col("s")).alias("duration"))


def safe_name(spark, d):
    return _docs(spark, d).select("doc_id", X.safe_name(F.col("text")).alias("safe"))


def status_label(spark, d):
    runs = view(spark, d, "runs")
    known = F.when(F.col("duration_s") > 200, F.lit("na")).when(F.col("duration_s") > 150, F.col("scenario")).otherwise(F.col("status"))
    return runs.select("id", X.status_label(known).alias("symbol"))


def compact_number_query(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", compact_number(F.col("l_extendedprice")).alias("price"),
        compact_number(F.col("l_extendedprice") / 7e6).alias("small"),
        compact_number(F.col("l_quantity")).alias("quantity"),
        compact_number(F.col("l_returnflag")).alias("flag"))


def http_codes(spark, d):
    return _docs(spark, d).select("doc_id", _joined(S.http_codes(F.concat(F.lit("é404 503, 4040 "), F.col("text")), F.col("text"))).alias("codes"))


def issue_key(spark, d):
    return view(spark, d, "keyed").select("doc_id", S.issue_key(F.col("name")).alias("issue_key"),
                                          S.without_issue_keys(F.col("name")).alias("rest"))


def upper_ids(spark, d):
    noisy = F.concat(F.lit("THE API_V2 éHTTP "), F.upper(F.col("lang")), F.lit(" AB ENV_VAR "), F.col("text"))
    return _docs(spark, d).select("doc_id", _joined(S.upper_ids(F.col("text"), noisy)).alias("ids"))


def plain_words(spark, d):
    return _docs(spark, d).select("doc_id", _joined(S.plain_words(F.col("text"))).alias("words"))


def _terms(spark, d):
    c = F.col
    return view(spark, d, "turns").withColumn("terms", S.search_terms(c("name"), c("failure_message"), c("failure_text"), c("search_hint")))


def search_terms(spark, d):
    return _terms(spark, d).select("id", _joined(F.col("terms")).alias("terms"))


def search_text(spark, d):
    return _terms(spark, d).select("id", S.search_text(F.col("terms"), ["PIPE", "INFRA"]).alias("scoped"),
                                   S.search_text(F.col("terms")).alias("plain"))


def cap_marker(spark, d):
    return _docs(spark, d).select("doc_id", X.cap_with_marker(X.strip(F.col("text")), 4000).alias("text"))


def log_tail(spark, d):
    """Last bytes of every page; a length that does not split characters is checked as hex."""
    tail = X.tail_bytes(F.encode("html", "UTF-8"), 1000)
    return table(spark, d, "pages").select("page_id", F.octet_length(tail).alias("n"), F.lower(F.hex(tail)).alias("tail"))


def ticket_lines_query(spark, d):
    t = view(spark, d, "tickets")
    entry = lambda key, match: F.struct(key.alias("key"), F.col("type"), F.nullif("status", F.lit("de")).alias("status"),
                                        F.nullif("priority", F.lit("Low")).alias("priority"), F.col("text").alias("summary"),
                                        F.lit(match).alias("match"))
    tickets = F.array(entry(F.col("key"), "direct"), entry(F.lit(""), "related"), entry(F.concat("key", F.lit("0")), "related"))
    return t.select("key", ticket_lines(tickets).alias("lines"))


def parse_response_query(spark, d):
    """Every conversation turn as a response: plain, fenced, without fields, not JSON, or no object."""
    kind = F.col("conv_id") % 6
    full = F.to_json(F.struct("text", F.col("role").alias("tag"), F.lit(" warn ").alias("tag_type")))
    raw = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.to_json(F.struct("text")))
        .when(kind == 3, F.concat(F.lit("```\n  "), F.to_json(F.struct(F.col("turn").alias("text"))), F.lit("  \n```")))
        .when(kind == 4, F.concat(F.lit("[1, 2, "), F.col("turn").cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("No JSON: "), F.col("text")))
    )
    r = parse_response(raw)
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


QUERIES = {
    "blank_normalise": (blank_normalise, f"""
        SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE trim(text, {SPACES}) END AS failure_message FROM documents"""),
    "build_template": (build_template, f"""
        SELECT page_id, replace(url || '/{{build}}/' || html || '{{build}}', '{{build}}', '{BUILD}') AS filled,
               url || '|{BUILD}.xml|x' AS listed, url || '#{BUILD}' AS mapped FROM pages"""),
    "duration_text": (duration_text, f"""
        WITH a AS (SELECT 'r' || event_id AS k, value AS s FROM events
                   UNION ALL
                   SELECT l_orderkey || '-' || l_linenumber, CASE WHEN l_quantity > 2 THEN l_extendedprice / 100 END FROM lineitem)
        SELECT k, {DURATION.format(c='s')} AS duration FROM a"""),
    "safe_name": (safe_name, rf"SELECT doc_id, left(regexp_replace(text, '[^{W}-]', '_', 'g'), 80) AS safe FROM documents"),
    "status_label": (status_label, with_views("runs") + """
        SELECT id, CASE WHEN duration_s > 200 THEN '—' WHEN duration_s > 150 THEN '?'
                        ELSE CASE status WHEN 'pass' THEN '✓' WHEN 'fail' THEN '✗' WHEN 'error' THEN '✗' WHEN 'timeout' THEN '⏱' ELSE '⚠' END
                   END AS symbol FROM runs"""),
    "compact_number": (compact_number_query, """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_extendedprice = floor(l_extendedprice) THEN printf('%d', cast(l_extendedprice AS bigint)) ELSE printf('%g', l_extendedprice) END AS price,
               printf('%g', l_extendedprice / 7e6) AS small, printf('%d', cast(l_quantity AS bigint)) AS quantity, l_returnflag AS flag
        FROM lineitem"""),
    "http_codes": (http_codes, "SELECT doc_id, array_to_string(list_concat(['503'], "
                   + on(CODES, "text") + ", " + on(CODES, "text") + "), ',') AS codes FROM documents"),
    "issue_key": (issue_key, with_views("keyed") + f"""
        SELECT doc_id, {on(FIRST_KEY, 'name')} AS issue_key, {on(BARE, 'name')} AS rest FROM keyed"""),
    "upper_ids": (upper_ids, f"""SELECT doc_id, array_to_string(list_concat({on(UPPERS, 'text')}, {on(UPPERS, "left('THE API_V2 éHTTP ' || upper(lang) || ' AB ENV_VAR ' || text, 300)")}), ',') AS ids FROM documents"""),
    "plain_words": (plain_words, f"SELECT doc_id, array_to_string({on(PLAIN, 'text')}, ',') AS words FROM documents"),
}

TERMS = f"""
bare AS (SELECT *, {on(BARE, 'name')} AS bare FROM turns),
found AS (SELECT id, list_concat({on(CODES, 'failure_message')}, {on(CODES, 'failure_text')},
                 {on(UPPERS, 'bare')}, {on(UPPERS, 'left(failure_message, 300)')}, {on(PLAIN, 'bare')}) AS ws,
                 CASE WHEN trim(coalesce(search_hint, ''), {SPACES}) <> '' THEN list_filter({words_where('search_hint', '[a-zA-Z]{3,}')},
                      lambda w: NOT list_contains({STOP_LIST}, lower(w)))[1:6] END AS hinted FROM bare),
flat AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM found),
firsts AS (SELECT id, min(i) AS i, arg_min(w, i) AS w FROM flat GROUP BY id, lower(w)),
auto AS (SELECT id, list(w ORDER BY i)[1:6] AS ws FROM firsts GROUP BY id),
terms AS (SELECT found.id, coalesce(hinted, auto.ws, []) AS ws FROM found LEFT JOIN auto ON auto.id = found.id)"""
EITHER = """array_to_string(list_transform(ws[1:3], lambda t: 'text ~ "' || t || '"'), ' OR ')"""

QUERIES |= {
    "search_terms": (search_terms, with_views("turns", more=TERMS) + "SELECT id, array_to_string(ws, ',') AS terms FROM terms"),
    "search_text": (search_text, with_views("turns", more=TERMS) + f"""
        SELECT id, CASE WHEN len(ws) = 0 THEN '' ELSE 'project in (PIPE, INFRA) AND (' || {EITHER} || ') ORDER BY updated DESC' END AS scoped,
               CASE WHEN len(ws) = 0 THEN '' ELSE '(' || {EITHER} || ') ORDER BY updated DESC' END AS plain FROM terms"""),
    "cap_marker": (cap_marker, f"""
        WITH s AS (SELECT doc_id, trim(text, {SPACES}) AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) > 4000 THEN left(t, 4000) || chr(10) || '… (truncated)' ELSE t END AS text FROM s"""),
    "log_tail": (log_tail, """
        SELECT page_id, cast(least(1000, strlen(html)) AS integer) AS n,
               right(lower(hex(encode(html))), 2000) AS tail FROM pages"""),
    "ticket_lines": (ticket_lines_query, with_views("tickets", more="""
        x AS (SELECT key, ' [' || type || ' · ' || CASE WHEN status = 'de' THEN '?' ELSE status END || '] '
                     || CASE WHEN priority = 'Low' THEN '' ELSE priority END || ' — ' || text AS rest FROM tickets)""") + """
        SELECT key, '■ ' || key || rest || chr(10) || '· ' || key || '0' || rest AS lines FROM x"""),
    "parse_response": (parse_response_query, f"""
        WITH s AS (SELECT *, conv_id % 6 AS k FROM conversations)
        SELECT conv_id, turn,
               CASE WHEN k <= 2 THEN trim(text, {SPACES}) WHEN k = 3 THEN cast(turn AS varchar)
                    WHEN k = 4 THEN 'Analysis failed: response is not a JSON object'
                    ELSE left(trim('No JSON: ' || text, {SPACES}), 500) END AS text,
               CASE WHEN k <= 1 THEN role WHEN k = 4 THEN 'ANALYSIS ERROR' ELSE 'AI ANALYSIS' END AS tag,
               CASE WHEN k IN (2, 3) THEN 'error' ELSE 'warn' END AS tag_type
        FROM s"""),
}
