"""Search terms and ticket matching: worked cases, properties of many."""

import random

from pyspark.sql import functions as F

from buildlens.fixed_values import STOP_WORDS
from buildlens.functions import terms as S
from buildlens.operators import tickets as TK

CASE = "id long, name string, failure_message string, failure_text string, jira string, search_hint string"
FIELDS = ["key", "summary", "status", "type", "priority", "url"]


def texts():
    rng = random.Random(11)
    words = ("test the Upload retry HTTP http API_V2 403 503 4040 x404 éHTTP Éclair token TOKEN Token using USING load "
             "PIPE-12 A-1 QA7-33 chunk_7 NOT not über [INFRA-9] case-x 500. (404) timeout Timeout ABC abc").split()
    text = lambda n: rng.choice(" ,|").join(rng.choice(words) for _ in range(rng.randrange(n)))
    return [(i, text(14), text(60), text(30), None, text(8) if i % 4 == 0 else rng.choice([None, "", " \n"])) for i in range(300)]


def terms_of(spark, rows):
    terms = S.search_terms(F.col("name"), F.col("failure_message"), F.col("failure_text"), F.col("search_hint"))
    return {r["id"]: r["terms"] for r in spark.createDataFrame(rows, CASE).select("id", terms.alias("terms")).collect()}


def test_terms_of_worked_cases(spark):
    assert terms_of(spark, [
        (1, "Pump PIPE-12 drains SLOWLY", "got 503 from VALVE_A", "then 418", None, None),
        (2, "Pump drains", "503", "", None, "the leaky Valve at 7"),
        (3, "the test", "", "", None, " \n"),
        (4, "Gauge gauge GAUGE", "4040 x404", "", None, None),
    ]) == {1: ["503", "418", "SLOWLY", "VALVE_A", "pump", "drains"], 2: ["leaky", "Valve"], 3: [], 4: ["GAUGE"]}


def test_terms_of_many_texts_are_short_distinct_parts(spark):
    rows = texts()
    got = terms_of(spark, rows)
    for i, name, message, details, _, hint in rows:
        terms = got[i]
        assert len(terms) <= 6 and all(t.lower() in " ".join((name, message, details, hint or "")).lower() for t in terms)
        if not (hint or "").strip():
            assert len({t.lower() for t in terms}) == len(terms)
            assert not {t for t in terms if t.islower()} & set(STOP_WORDS)


def test_issue_keys(one):
    rows = ["Bearer [PIPE-458] x", "xPIPE-1 QA7-33", "A-1 PIPE-12a", None]
    assert one(S.issue_key, "x string", *rows) == ["PIPE-458", "QA7-33", "", ""]
    assert one(S.without_issue_keys, "x string", "a [P1-2] AB-3 CD-4.") == ["a []  ."]
    assert one(S.direct_key, "j string, n string", ("X-1", "[PIPE-2]"), ("", "[PIPE-2]"), (None, "none")) == ["X-1", "PIPE-2", ""]


def test_search_text(one):
    text = lambda t: S.search_text(t, ["PIPE", "OPS"])
    assert one(text, "t array<string>", (["403", "HTTP", "token", "more"],), ([],)) == [
        'project in (PIPE, OPS) AND (text ~ "403" OR text ~ "HTTP" OR text ~ "token") ORDER BY updated DESC', ""]
    assert one(lambda t: S.search_text(t), "t array<string>", (["a"],)) == ['(text ~ "a") ORDER BY updated DESC']


TICKET = "key string, summary string, status string, type string, priority string, url string, updated long, text string"


def contexts(spark, cases, tickets, projects=()):
    found = TK.match_tickets(spark.createDataFrame(cases, CASE), tickets, projects).collect()
    assert len(found) == len(cases)
    return {r["id"]: [(t["key"], t["match"]) for t in r["jira_context"]] for r in found}


def test_matching_with_a_token_in_every_ticket(spark):
    """Ticket i is newer than ticket i - 1, all have the word valve, every tenth has pump, odd ones are of another project."""
    tickets = spark.createDataFrame(
        [(f"{'OPS' if i % 2 else 'PIPE'}-{i}", "", "", "", "", "", i, "valve pump" if i % 10 == 0 else "valve") for i in range(100)], TICKET)
    # most of the cases are copies of one question
    cases = [(i, "valve", "", "", "PIPE-96", None) for i in range(150)]
    cases += [(1000, "pump", "", "", None, None), (1001, "OPS-7 pump", "", "", None, None), (1002, "nothing", "", "", None, None)]
    got = contexts(spark, cases, tickets, ["PIPE"])
    assert all(got[i] == [("PIPE-96", "direct"), *[(f"PIPE-{k}", "related") for k in (98, 94, 92, 90)]] for i in range(150))
    pump = [(f"PIPE-{k}", "related") for k in (90, 80, 70, 60, 50)]
    assert got[1000] == pump and got[1001] == [("OPS-7", "direct"), *pump[:4]] and got[1002] == []
    assert max(len(p["posting"]) for p in TK.ticket_postings(tickets).collect()) == 9


def test_blank_and_repeated_ticket_keys(spark):
    tickets = spark.createDataFrame([("", "no key", "", "", "", "", 9, "x"), ("OPS-2", "old", "", "", "", "", 1, "x"),
                                     ("OPS-2", "new", "", "", "", "", 2, "x")], TICKET)
    cases = spark.createDataFrame([(1, "qq", "", "", "OPS-2", None), (2, "qq", "", "", None, None)], CASE)
    got = {r["id"]: [(t["summary"], t["match"]) for t in r["jira_context"]] for r in TK.match_tickets(cases, tickets).collect()}
    assert got == {1: [("new", "direct")], 2: []}
    direct = TK.direct_tickets(TK.with_search(cases), tickets).collect()
    assert [(r["id"], r["ticket"]["summary"]) for r in direct] == [(1, "new")]


def test_wanted_tokens_do_not_change_postings(spark):
    df = spark.createDataFrame([(f"P-{i}", "", "", "", "", "", i, f"common w{i % 3}") for i in range(40)],
                               "key string, summary string, status string, type string, priority string, url string, updated long, text string")
    wanted = spark.createDataFrame([("common",)], "token string")
    all_of = {r["token"]: sorted(t["key"] for t in r["posting"]) for r in TK.ticket_postings(df).collect()}
    some = {r["token"]: sorted(t["key"] for t in r["posting"]) for r in TK.ticket_postings(df, wanted=wanted).collect()}
    assert some == {"common": all_of["common"]} and len(all_of["common"]) == 9


def test_postings_ranked_in_many_tasks(spark, monkeypatch):
    rows = [(f"P-{i}", i % 13, f"kappa w{i % 7} w{i % 29} {'pad ' * (i % 5)}") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, updated long, text string").coalesce(1)
    for c in TK.TICKET_FIELDS[1:]:
        df = df.withColumn(c, F.lit(""))

    def postings():
        found = TK.ticket_postings(df)
        return found, {r["token"]: sorted(t["key"] for t in r["posting"]) for r in found.collect()}

    whole, expected = postings()
    monkeypatch.setattr(TK, "TASK_TEXT", 256)
    dealt, found = postings()
    assert found == expected and len(expected["kappa"]) == 9
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in (whole, dealt)]
    assert ["REPARTITION_BY_NUM" in p for p in plans] == [False, True]


def test_pending(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("K",)])], "id long, jira_context array<struct<key:string>>")
    assert [r["id"] for r in TK.pending_tickets(df).collect()] == [1]
    assert TK.pending_tickets(df, skip_if_present=False).count() == 3


def test_flatten(spark, tmp_path):
    from buildlens.sources.documents import read_tickets
    (tmp_path / "t.json").write_text(
        '{"key": "P-1", "fields": {"summary": "s", "status": {"name": "Open"}, "issuetype": null, "updated": "2024-01-02T03:04:05.000+0000"}}\n{"key": "P-2"}\n')
    rows = TK.flatten_tickets(read_tickets(spark, str(tmp_path)), "http://t/").orderBy("key").collect()
    assert tuple(rows[0])[:6] == ("P-1", "s", "Open", "", "", "http://t/browse/P-1") and rows[0]["updated"].day == 2
    assert tuple(rows[1])[:6] == ("P-2", "", "", "", "", "http://t/browse/P-2")


def test_times_and_texts_of_flat_tickets(spark):
    import datetime as dt
    from buildlens.schemas import RAW_TICKETS
    times = {"AB-1": "2031-05-06T01:02:03.5+0530", "AB-2": "2031-05-06T01:02:03-01:00", "AB-3": "2031-05-06T01:02:03Z", "AB-4": "yesterday", "AB-5": None, "AB-6": "2031-13-45T01:02:03"}
    raw = spark.createDataFrame([(k, ("sum", None, None, None, t, "gateway broke" if k != "AB-3" else None)) for k, t in times.items()], RAW_TICKETS)
    flat = TK.flatten_tickets(raw, "http://t")
    got = {r["key"]: (r["updated"], r["text"]) for r in flat.collect()}
    assert got["AB-1"] == (dt.datetime(2031, 5, 5, 19, 32, 3, 500000), "sum\ngateway broke")
    assert got["AB-2"][0] == dt.datetime(2031, 5, 6, 2, 2, 3) and got["AB-3"] == (dt.datetime(2031, 5, 6, 1, 2, 3), "sum")
    assert [got[k][0] for k in ("AB-4", "AB-5", "AB-6")] == [None] * 3
    # flat tickets are what a search takes; those without a time come last
    cases = spark.createDataFrame([(1, "gateway down [AB-3]", "", "", None, None)], CASE)
    found = TK.match_tickets(cases, flat).first()["jira_context"]
    assert [t["key"] for t in found] == ["AB-3", "AB-2", "AB-1", "AB-6", "AB-5"]


def test_many_tokens_give_the_same_tickets(spark, monkeypatch):
    tickets = spark.createDataFrame([(f"P-{i}", f"s{i}", "", "", "", "", i, f"common word{i % 5}") for i in range(40)],
                                    "key string, summary string, status string, type string, priority string, url string, updated long, text string")
    cases = spark.createDataFrame([(i, f"common word{i % 7} NAME", "", "", None, None) for i in range(50)], CASE)
    found = lambda: sorted((r["id"], [t["key"] for t in r["jira_context"]]) for r in TK.match_tickets(cases, tickets).collect())
    few = found()
    for module in ("sizing", "tickets"):
        monkeypatch.setattr(f"buildlens.operators.{module}.fits", lambda *a: False)
    assert found() == few and few[0][1] == [f"P-{i}" for i in range(39, 34, -1)]


def test_every_turn_searches_the_flat_tickets(spark, tmp_path):
    from suite.tickets import ticket_flatten
    documents = [(1, "404"), (2, "rotor"), (3, "rotor"), (4, "casing"), (6, "turbine"), (9, "idle")]
    turns = [(1, 0, "rotor"), (1, 1, "rotor"), (1, 2, "rotor"), (1, 3, "turbine"), (1, 4, "rotor"), (2, 5, "as in OPS-2"), (4, 7, "unknown")]
    spark.createDataFrame([(i, t, "xx", "wiki", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(c, n, "user", t) for c, n, t in turns], "conv_id long, turn long, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["key"]: r["hits"] for r in ticket_flatten(spark, str(tmp_path)).collect()}
    # even turns ask for 404, 500 and their word, turn 3 for its hint; OPS is no project of the search, but may be named
    assert got == {"INFRA-1": 3, "OPS-2": 1, "PIPE-3": 3, "INFRA-4": 1, "PIPE-6": 1, "PIPE-9": None}
