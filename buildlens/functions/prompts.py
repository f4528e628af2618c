"""Prompt text out of a failing case, and the parsed response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.history import history_tail, prompt_note, prompt_rate
from buildlens.functions.text import head, normalise_blank, null_to_blank, strip


def ticket_lines(tickets: Column) -> Column:
    """One line per ticket with a key, joined by newlines; direct ones marked."""
    keyed = F.filter(tickets, lambda t: null_to_blank(t["key"]) != "")
    return F.array_join(
        F.transform(
            keyed,
            lambda t: F.concat(
                F.when(t["match"] == "direct", "■ ").otherwise("· "),
                t["key"],
                F.lit(" ["),
                F.coalesce(t["type"], F.lit("?")),
                F.lit(" · "),
                F.coalesce(t["status"], F.lit("?")),
                F.lit("] "),
                null_to_blank(t["priority"]),
                F.lit(" — "),
                null_to_blank(t["summary"]),
            ),
        ),
        "\n",
    )


def failure_block(message: Column, details: Column) -> Column:
    message, details = normalise_blank(message), normalise_blank(details)
    return F.concat(
        F.lit("## Failure\n"),
        F.when(message != "", F.concat(F.lit("Message: "), message, F.lit("\n"))).otherwise(""),
        F.when(details != "", F.concat(F.lit("\nDetails:\n"), head(details, V.PROMPT_DETAILS_CAP))).otherwise(""),
        F.when((message == "") & (details == ""), "(no failure details captured)").otherwise(""),
    )


def history_block(history: Column) -> Column:
    note = prompt_note(history)
    return F.concat(
        F.lit("## History\n"),
        prompt_rate(history),
        F.when(note != "", F.concat(F.lit("\n"), note)).otherwise(""),
        F.when(F.size(history) > 0, F.concat(F.lit("\n"), history_tail(history))).otherwise(""),
    )


def prompt_text(
    number: Column,
    branch: Column,
    ref_build: Column,
    name: Column,
    status: Column,
    duration: Column,
    message: Column,
    details: Column,
    tickets: Column,
    history: Column,
    log: Column,
    context: Column,
) -> Column:
    """Sections joined by blank lines; context, tickets and log only where there are any."""
    unknown = F.lit("?")
    history = F.coalesce(history, F.array().cast("array<struct<build:string,status:string,duration:string,current:boolean>>"))
    lines = ticket_lines(tickets)

    def section(title: str, body: Column) -> Column:
        return F.when(null_to_blank(body) != "", F.concat(F.lit(f"## {title}\n"), body))

    return F.concat_ws(
        "\n\n",
        F.concat(
            F.lit("## Build\nBuild #"), F.coalesce(number, unknown),
            F.lit("  Branch: "), F.coalesce(branch, unknown),
            F.lit("  Ref: #"), F.coalesce(ref_build, unknown),
        ),
        section("System context", context),
        F.concat(
            F.lit("## Failing test\nName: "), null_to_blank(name),
            F.lit("\nStatus: "), F.upper(F.coalesce(status, F.lit("fail"))),
            F.lit("  Duration: "), F.coalesce(duration, F.lit(V.EMPTY_MARK)),
        ),
        failure_block(message, details),
        section("JIRA tickets", lines),
        history_block(history),
        section("Log", head(log, V.PROMPT_LOG_CAP)),
        F.lit(V.INSTRUCTION),
    )


def strip_code_fences(raw: Column) -> Column:
    return strip(F.regexp_replace(null_to_blank(raw), V.CODE_FENCE, ""))


_END = "end of answer"
_STRICT = {"allowSingleQuotes": "false"}


def parse_response(raw: Column) -> Column:
    """Response text as struct(text, tag, tag_type).

    An object gives its fields with defaults, the last of a repeated key counting; text that is not JSON, or
    JSON with anything but white space after it, is kept raw; JSON that is no object becomes an analysis-error row.
    """
    cleaned = strip_code_fences(raw)
    # As first of two items of a list the answer must be one whole value, with nothing after it.
    items = F.from_json(F.concat(F.lit("["), cleaned, F.lit(f',"{_END}"]')), "array<string>", _STRICT)
    whole = F.coalesce((F.size(items) == 2) & (F.try_element_at(items, F.lit(2)) == _END), F.lit(False))
    fields = F.from_json(cleaned, "text string, tag string, tag_type string", _STRICT)

    def field(key: str, default: str) -> Column:
        return strip(F.coalesce(fields[key], F.lit(default)))

    def result(text: Column, tag: Column, tag_type: Column) -> Column:
        return F.struct(text.alias("text"), tag.alias("tag"), tag_type.alias("tag_type"))

    return (
        F.when(~whole, result(head(cleaned, V.RAW_RESPONSE_CAP), F.lit(V.DEFAULT_TAG), F.lit("warn")))
        .when(cleaned.startswith("{"), result(field("text", ""), field("tag", V.DEFAULT_TAG), field("tag_type", "error")))
        .otherwise(result(F.lit("Analysis failed: response is not a JSON object"), F.lit(V.ERROR_TAG), F.lit("warn")))
    )
