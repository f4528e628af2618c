"""Tickets for failing cases: direct keys and related ones by shared terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions import terms as S
from buildlens.functions.text import null_to_blank
from buildlens.operators.sizing import cut_lineage, dealt_out, fits, join_unique, measure, widest_row

#: Bytes of text whose words one task ranks; they take it about eight times as many.
TASK_TEXT = 32 << 20
TICKET_FIELDS = ["key", "summary", "status", "type", "priority", "url"]


def _moment(text: Column) -> Column:
    """An ISO date and time, with or without an offset, as the time in UTC; NULL if it is none."""
    local = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1).try_cast("timestamp_ntz")
    sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", i) for i in (1, 2, 3))
    ahead = F.coalesce(hours.try_cast("int") * 60 + minutes.try_cast("int"), F.lit(0)) * F.when(sign == "-", -1).otherwise(1)
    ahead = F.when(F.length(text) > 19, ahead).otherwise(0)
    return local - F.make_dt_interval(mins=ahead)


def flatten_tickets(raw: DataFrame, base_url: str) -> DataFrame:
    """Nested issue records as flat tickets that a search can take: missing parts become '', ``text`` is summary and description, ``updated`` is
    in UTC, NULL if it is no time."""
    key, summary = null_to_blank(F.col("key")), null_to_blank(F.col("fields.summary"))
    described = F.col("fields.description") if "description" in raw.schema["fields"].dataType.names else F.lit(None).cast("string")
    return raw.select(
        key.alias("key"),
        summary.alias("summary"),
        null_to_blank(F.col("fields.status.name")).alias("status"),
        null_to_blank(F.col("fields.issuetype.name")).alias("type"),
        null_to_blank(F.col("fields.priority.name")).alias("priority"),
        F.concat(F.lit(base_url.rstrip("/") + "/browse/"), key).alias("url"),
        _moment(F.col("fields.updated")).alias("updated"),
        F.concat_ws("\n", summary, described).alias("text"),
    )


def pending_tickets(cases: DataFrame, skip_if_present: bool = True) -> DataFrame:
    """Cases never enriched: no context at all. An empty list means done."""
    return cases.filter(F.col("jira_context").isNull()) if skip_if_present else cases


def with_search(cases: DataFrame, n_terms: int = V.SEARCH_TERMS) -> DataFrame:
    """Adds ``terms`` and ``direct_key``."""
    hint = F.col("search_hint") if "search_hint" in cases.columns else None
    return cases.withColumns({
        "terms": S.search_terms(
            F.col("name"), F.col("failure_message"), F.col("failure_text"), hint, n_terms),
        "direct_key": S.direct_key(F.col("jira"), F.col("name")),
    })


def _entry(match: str) -> Column:
    return F.struct(*TICKET_FIELDS, F.lit(match).alias("match"))


def direct_tickets(cases: DataFrame, tickets: DataFrame) -> DataFrame:
    """Cases with the ticket their ``direct_key`` names; cases without one are left out."""
    named = _by_key(tickets).withColumnRenamed("direct", "ticket")
    return join_unique(cases.filter(F.col("direct_key") != ""), named, ["direct_key"], "inner")


def _by_key(tickets: DataFrame) -> DataFrame:
    """One record, the newest, for each key; records without a key are no direct tickets."""
    age = ["updated"] if "updated" in tickets.columns else []
    newest = F.max(F.struct(*age, _entry("direct").alias("entry")))
    return (
        tickets.filter(F.col("key") != "").groupBy(F.col("key").alias("direct_key"))
        .agg(newest["entry"].alias("direct"))
    )


def ticket_postings(
    tickets: DataFrame,
    projects: Sequence[str] = (),
    depth: int = V.MAX_RELATED + V.SEARCH_SLACK,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Per token, the ``depth`` tickets updated last whose text has it.

    A search returns ``depth`` tickets, newest first, over any of its terms.
    Each of them is among the newest ``depth`` of some single term, so longer
    lists can never matter and a token found in every ticket costs no more
    than a rare one. The ranking is limited before the shuffle, by a sort of a
    task's tokens; so tickets are dealt out first, TASK_TEXT bytes to a task. Only the
    ``wanted`` tokens (column ``token``, few enough to broadcast) are ranked.
    """
    if projects:
        tickets = tickets.filter(F.split_part(F.col("key"), F.lit("-"), F.lit(1)).isin(list(projects)))
    tickets = dealt_out(tickets.select("updated", *TICKET_FIELDS, "text"), F.octet_length("text"), TASK_TEXT)
    tokens = tickets.select(F.explode(S.ticket_tokens(F.col("text"))).alias("token"), "updated", *TICKET_FIELDS)
    if wanted is not None:
        tokens = tokens.join(F.broadcast(wanted), "token", "left_semi")
    newest = W.partitionBy("token").orderBy(F.desc("updated"), F.desc("key"))
    return (
        tokens.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= depth)
        .groupBy("token")
        .agg(F.collect_list(F.struct("updated", *TICKET_FIELDS)).alias("posting"))
    )


def _newest(found: Column) -> Column:
    """Distinct tickets, newest first, equal times by key downwards."""
    return F.reverse(F.array_sort(F.array_distinct(found)))


def related_tickets(
    cases: DataFrame,
    tickets: DataFrame,
    projects: Sequence[str] = (),
    n_terms: int = V.SEARCH_TERMS,
    max_related: int = V.MAX_RELATED,
) -> DataFrame:
    """Per distinct question (``terms``, ``direct_key``) the tickets found, newest first.

    Cases asking the same question are answered once, whatever their number.
    """
    depth = max_related + V.SEARCH_SLACK
    top = F.slice("terms", 1, n_terms)
    asked = cases.select(top.alias("top"), "direct_key").distinct()
    wanted = asked.select("top", "direct_key", F.explode("top").alias("term")).withColumn("token", F.lower("term"))
    tokens = wanted.select("token").distinct()
    n_tokens, size = measure(tokens)
    few = fits(n_tokens, size)
    postings = ticket_postings(tickets, projects, depth, tokens if few else None)
    # At most ``depth`` tickets per token, none wider than the widest.
    most = n_tokens * depth
    small = few and fits(most, most * widest_row(tickets.select(*TICKET_FIELDS)))
    found = (
        join_unique(wanted, postings, ["token"], "inner", small=small)
        .groupBy("top", "direct_key")
        .agg(F.slice(_newest(F.flatten(F.collect_list("posting"))), 1, depth).alias("found"))
    )
    related = F.transform(
        F.filter("found", lambda t: t["key"] != F.col("direct_key")),
        lambda t: F.struct(*[t[c].alias(c) for c in TICKET_FIELDS], F.lit("related").alias("match")),
    )
    return found.select("top", "direct_key", related.alias("related"))


def match_tickets(
    cases: DataFrame,
    tickets: DataFrame,
    projects: Sequence[str] = (),
    n_terms: int = V.SEARCH_TERMS,
    max_related: int = V.MAX_RELATED,
) -> DataFrame:
    """Cases with ``jira_context``: the direct ticket, then related ones up to max_related + 1 in all."""
    asking = with_search(cases.drop("jira_context"), n_terms)
    # Terms come from whole texts and are used several times: find them once.
    asking = cut_lineage(asking.withColumn("top", F.slice("terms", 1, n_terms)))
    related = cut_lineage(related_tickets(asking, tickets, projects, n_terms, max_related))
    direct = _by_key(tickets)
    none = F.array().cast("array<struct<key:string,summary:string,status:string,type:string,"
                          "priority:string,url:string,match:string>>")
    first = F.when(F.col("direct").isNotNull(), F.array("direct")).otherwise(none)
    return (
        join_unique(join_unique(asking, direct, ["direct_key"]), related, ["top", "direct_key"])
        .withColumn("jira_context", F.slice(
            F.concat(first, F.coalesce("related", none)), 1, max_related + 1))
        .drop("top", "direct", "related")
    )
