"""Prompts, responses, the user's function and saving."""

import pytest
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.prompts import parse_response, ticket_lines
from buildlens.operators import analysis as AN

TICKETS = "array<struct<key:string,summary:string,status:string,type:string,priority:string,url:string,match:string>>"
CASES = ("id long, name string, status string, duration string, failure_message string, failure_text string, "
         f"history array<struct<build:string,status:string,duration:string,current:boolean>>, jira_context {TICKETS}, log string")


def test_full_prompt(spark):
    history = [("1246", "pass", "1s", False), ("current", "fail", "18.1s", True)]
    tickets = [("P-1", "Token", "Open", "Bug", "High", "u", "direct"), ("", "x", "", "", "", "", "related"), ("P-2", None, None, None, None, None, "related")]
    df = spark.createDataFrame([(1, "Bearer", "fail", "18.1s", " HTTP 403\n", "d" * 2500, history, tickets, "l" * 3500)], CASES)
    got = AN.with_prompt(df, {"number": "1247", "branch": "main", "ref_build": "1244"}, "Agents.").first()["prompt"]
    assert got == "\n\n".join([
        "## Build\nBuild #1247  Branch: main  Ref: #1244",
        "## System context\nAgents.",
        "## Failing test\nName: Bearer\nStatus: FAIL  Duration: 18.1s",
        "## Failure\nMessage: HTTP 403\n\nDetails:\n" + "d" * 2000,
        "## JIRA tickets\n■ P-1 [Bug · Open] High — Token\n· P-2 [? · ?]  — ",
        "## History\n1 / 2 passed\nfirst failure — was consistently passing before this build\n  #1246: pass\n  #current: fail",
        "## Log\n" + "l" * 3000,
        V.INSTRUCTION,
    ])


def test_bare_prompt(spark):
    df = spark.createDataFrame([(1, "n", "timeout", "—", "", None, [], None, None)], CASES)
    got = AN.with_prompt(df, {}).first()["prompt"]
    assert got == "\n\n".join([
        "## Build\nBuild #?  Branch: ?  Ref: #?", "## Failing test\nName: n\nStatus: TIMEOUT  Duration: —",
        "## Failure\n(no failure details captured)", "## History\nno prior history", V.INSTRUCTION])


def test_parse_response(one):
    rows = ['{"text": " a ", "tag": "T", "tag_type": "ok"}', '```json\n{"text": "b"}\n```', '```\n  {"text": 5, "tag": null}  \n```',
            "plain " * 200, "[1, 2]", '{"broken": ', "", '"just text"', '{"text": {"x": 1}}', "{}"]
    got = [tuple(r) for r in one(parse_response, "x string", *rows)]
    tag = "AI ANALYSIS"
    assert got[:4] == [("a", "T", "ok"), ("b", tag, "error"), ("5", tag, "error"), (("plain " * 200).strip()[:500], tag, "warn")]
    assert got[4][1:] == ("ANALYSIS ERROR", "warn") and got[7][1:] == ("ANALYSIS ERROR", "warn")
    assert got[5] == ('{"broken":', tag, "warn") and got[6] == ("", tag, "warn")
    assert got[8][0].replace(" ", "") == '{"x":1}' and got[9] == ("", tag, "error")


def test_what_counts_as_one_object(one):
    tag = "AI ANALYSIS"
    rows = {
        '{"text": "a"} and more': ('{"text": "a"} and more', tag, "warn"),
        '{"text": "a"}, {"text": "b"}': ('{"text": "a"}, {"text": "b"}', tag, "warn"),
        '{"text": "a"}]': ('{"text": "a"}]', tag, "warn"),
        "1], [2": ("1], [2", tag, "warn"),
        "{'text': 'a'}": ("{'text': 'a'}", tag, "warn"),
        '{"text": "a", "text": "b", "tag": "x", "tag": "y"}': ("b", "y", "error"),
        '{"text": "a", "score": NaN, "more": [-Infinity]}': ("a", tag, "error"),
        '{"text": "a"}  \n ': ("a", tag, "error"),
        '{"text": "braces } and \\"quotes\\" ]", "tag": null}': ('braces } and "quotes" ]', tag, "error"),
        '{"text": true, "tag": 1.50}': ("true", "1.5", "error"),
        "null": ("Analysis failed: response is not a JSON object", "ANALYSIS ERROR", "warn"),
        "12 13": ("12 13", tag, "warn"),
    }
    assert [tuple(r) for r in one(parse_response, "x string", *rows)] == list(rows.values())


@pytest.fixture
def answer():
    def call(system, prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return '{"text": "%s", "tag": "OK", "tag_type": "ok"}' % prompt.upper()
    return call


def test_score_turns_errors_into_rows(spark, answer):
    df = spark.createDataFrame([(1, "x"), (2, "bad")], "id long, prompt string")
    got = {r["id"]: tuple(r["ai_analysis"]) for r in AN.score(df, answer, concurrency=2).collect()}
    assert got == {1: ("X", "OK", "ok"), 2: ("Analysis failed: no answer", "ANALYSIS ERROR", "warn")}


def test_saved_batches_survive_a_stop_and_are_not_run_again(spark, tmp_path, answer):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, prompt string")
    out, calls = str(tmp_path / "scored"), spark.sparkContext.accumulator(0)

    def counting(system, prompt):
        calls.add(1)
        return answer(system, prompt)

    AN.score(df.filter("id < 15"), counting).write.parquet(out)  # what an interrupted run left
    got = AN.score_and_save(df, counting, out, batches=3)
    assert sorted(r["id"] for r in got.collect()) == list(range(40))
    assert calls.value == 40
    assert AN.score_and_save(df, counting, out, batches=3).count() == 40 and calls.value == 40


def test_pending_and_attach(spark, answer):
    df = spark.createDataFrame([(1, None), (2, ("", "", "")), (3, (" \n", "", "")), (4, ("done", "T", "ok"))],
                               "id long, ai_analysis struct<text:string,tag:string,tag_type:string>")
    assert sorted(r["id"] for r in AN.pending_analysis(df).collect()) == [1, 2, 3]
    assert AN.pending_analysis(df, skip_if_present=False).count() == 4
    scored = AN.score(spark.createDataFrame([(1, "x")], "id long, prompt string"), answer)
    got = {r["id"]: r["ai_analysis"] and r["ai_analysis"]["text"] for r in AN.attach_analysis(df, scored).collect()}
    assert got == {1: "X", 2: "", 3: " \n", 4: "done"}


def test_lines_skip_tickets_without_key(one):
    assert one(ticket_lines, f"t {TICKETS}", ([],), (None,)) in ([["", None]], ["", None], ["", ""])
