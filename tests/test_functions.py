"""Column functions on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from buildlens.functions import history as H
from buildlens.functions import numbers as N
from buildlens.functions import text as X
from buildlens.functions import trends as D


def doubles():
    rng = random.Random(7)
    ties = [0.05, 0.15, 0.25, 18.15, 18.45, 2.675, 0.125, 0.5, 1.5, 2.5, 59.96, 999999.5, 123456.5, 99999.95]
    odd = [1e-5, 0.00012345678, 1234567.5, 12345678.9, 1e15 + 0.3, 1e16, 1e22, 0.1 + 0.2, 100000.5, 0.001, 9999999.0]
    cents = [round(rng.uniform(-500, 500), 2) for _ in range(1500)]
    wide = [rng.uniform(0, 1e6) for _ in range(500)] + [10 ** rng.uniform(-4, 7) for _ in range(500)]
    return [*ties, *odd, *[-x for x in ties + odd], *cents, *wide]


@pytest.mark.parametrize("fn, want", [
    (lambda x: N.round_half_even(x, 1), lambda x: round(x, 1)),
    (lambda x: N.round_half_even(x, 3), lambda x: round(x, 3)),
    (lambda x: N.fixed_text(x, 1), lambda x: f"{x:.1f}"),
    (lambda x: N.fixed_text(x, 0), lambda x: f"{x:.0f}"),
    (N.float_text, repr),
    (N.compact_number, lambda x: str(int(x)) if x == int(x) else f"{x:g}"),
])
def test_numbers_follow_the_stored_value(one, fn, want):
    xs = doubles()
    got = one(fn, "x double", *xs)
    assert [(x, g) for x, g in zip(xs, got)] == [(x, want(x)) for x in xs]


def test_compact_number_of_texts(one):
    assert one(N.compact_number, "x string", "12.0", "3.25", "n/a", None, "nan") == ["12", "3.25", "n/a", None, "nan"]


def test_duration_text(one):
    got = one(X.duration_text, "x string", None, "0", "-1", "18.5", "n/a", "60", "192", "30", "59.96", "119.6", "0.04", "1d", " 2 ", "1e1", "x5")
    assert got == ["—", "—", "—", "18.5s", "—", "1m 0s", "3m 12s", "30.0s", "60.0s", "1m 60s", "0.0s", "—", "2.0s", "10.0s", "—"]


def test_safe_name_keeps_letters_of_any_script(one):
    got = one(X.safe_name, "x string", "a b/c-d_é", "x" * 100, "[Ω1]")
    assert got == ["a_b_c-d_é", "x" * 80, "_Ω1_"]


def test_normalise_blank(one):
    assert one(X.normalise_blank, "x string", None, " \n\tab c\xa0 \x1f", "") == ["", "ab c", ""]


def test_links(one):
    link = lambda s, k: X.ticket_link(s, k, "http://t/")
    assert one(link, "s string, k string", ("u", "K-1"), ("", "K-1"), (None, "")) == ["u", "http://t/K-1", "#"]
    assert one(lambda s, k: X.ticket_link(s, k, ""), "s string, k string", ("", "K-1")) == ["#"]
    named = lambda s, n: X.name_link(s, n, "http://l/")
    assert one(named, "s string, n string", (None, "a b"), ("u", "a")) == ["http://l/a_b", "u"]
    assert one(lambda s, n: X.name_link(s, n, ""), "s string, n string", (None, "a b")) == ["#"]
    assert one(X.has_link, "x string", None, "", "#", "u") == [False, False, False, True]


def test_cap_and_tail(one):
    assert one(lambda c: X.cap_with_marker(c, 3), "x string", "abc", "abcd") == ["abc", "abc\n… (truncated)"]
    tails = one(lambda c: X.tail_bytes(c, 4), "x binary", bytearray(b"0123456789"), bytearray(b"ab"))
    assert [bytes(t) for t in tails] == [b"6789", b"ab"]
    assert bytes(one(lambda c: X.tail_bytes(c, 0), "x binary", bytearray(b"abc"))[0]) == b"abc"


def test_build_placeholder(one):
    assert one(lambda c: X.fill_build(c, "7"), "x string", "r/{build}/{build}.xml", "none") == ["r/7/7.xml", "none"]
    assert one(lambda c: X.fill_build_list(c, "7"), "x array<string>", (["{build}", "a"],)) == [["7", "a"]]
    assert one(lambda c: X.fill_build_map(c, "7"), "x map<string,string>", ({"k": "{build}"},)) == [{"k": "7"}]


def test_labels(one):
    assert one(X.status_label, "x string", "pass", "timeout", "na", "other", None) == ["✓", "⏱", "—", "?", "?"]
    assert one(X.trend_label, "x string", "good", "bad", "neu", "x") == ["up", "down", "neu", "neu"]


def delta(c, r, d):
    pct = D.delta_pct(c, r)
    return F.struct(F.round(pct, 4).alias("p"), D.delta_text(pct, r).alias("t"), D.delta_class(pct, d).alias("c"),
                    D.metric_status(pct, d).alias("s"))


def test_deltas(one):
    up, down = "higher_better", "lower_better"
    got = one(delta, "c double, r double, d string",
              (100.0, 0.0, up), (110.0, 100.0, up), (90.0, 100.0, up), (101.0, 100.0, up), (90.0, 100.0, down),
              (110.0, 100.0, down), (100.0, 100.0, up), (102.0, 100.0, up), (float("nan"), 1.0, up), (61.1, 66.7, up),
              (-90.0, -100.0, up))
    assert [tuple(g) for g in got] == [
        (0.0, "→ N/A", "neu", "neutral"), (10.0, "▲ +10.0%", "pos", "improved"), (-10.0, "▼ -10.0%", "neg", "regressed"),
        (1.0, "▲ +1.0%", "neu", "neutral"), (-10.0, "▼ -10.0%", "pos", "improved"), (10.0, "▲ +10.0%", "neg", "regressed"),
        (0.0, "→ 0%", "neu", "neutral"), (2.0, "▲ +2.0%", "neu", "neutral"), (pytest.approx(float("nan"), nan_ok=True), "▼ nan%", "neu", "neutral"),
        (-8.3958, "▼ -8.4%", "neg", "regressed"), (10.0, "▲ +10.0%", "pos", "improved")]


def test_sparkline(one):
    bars = lambda v, d: D.sparkline(v, d)
    up = [72.4, 71.1, 70.3, 68.9, 66.7, 64.2, 62.5, 61.1]
    got = one(bars, "v array<double>, d string", ([], "higher_better"), ([5.0] * 3, "lower_better"), (up, "higher_better"),
              ([280.0, 285.0, 290.0, 295.0, 300.0, 305.0, 308.0, 312.0], "lower_better"), ([1.0], "higher_better"))
    assert got == [[], [20, 20, 20], [20, 19, 18, 16, 14, 11, 9, 8], [20, 18, 16, 14, 12, 11, 10, 8], [20]]
    rng = random.Random(3)
    rows = [([rng.uniform(0, 100) for _ in range(20)], d) for d in ("higher_better", "lower_better") for _ in range(20)]
    for heights in one(bars, "v array<double>, d string", *rows):
        assert min(heights) == 8 and max(heights) == 20


def test_units_chips_notes(one):
    assert one(D.unit_text, "u string, d string", ("ms", "lower_better"), ("", "higher_better")) == [
        "ms · ↓ lower better · bars inv.", "· ↑ higher better"]
    chip = one(D.chip, "n string, c double, u string, s string", ("Upload Throughput", 234.0, "ms", "pos"))[0]
    assert tuple(chip) == ("upload through", "234.0 ms", "green")
    note = lambda g, t: D.summary_note(g, t, F.lit("1244"))
    assert one(note, "g string, t string", ("mine", "good"), ("", "good"), (None, "bad"), (None, "neu")) == [
        "mine", "All metrics at best in recent window", "Performance regression — investigation recommended",
        "All metrics stable vs ref build #1244"]
    given = "g array<struct<label:string,value:string,css_class:string>>, d array<struct<label:string,value:string,css_class:string>>"
    kept = one(D.chips_or_given, given, ([("a", "1", None)], [("b", "2", "red")]), ([], [("b", "2", "red")]), (None, [("b", "2", "red")]))
    assert [[tuple(c) for c in k] for k in kept] == [[("a", "1", "")], [("b", "2", "red")], [("b", "2", "red")]]


ENTRY = "h array<struct<build:string,status:string,duration:string,current:boolean>>"


def strip(statuses, now="fail"):
    return ([(str(i), s, "1s", False) for i, s in enumerate(statuses)] + [("current", now, "1s", True)],)


def test_history_classes(one):
    rows = [([],), strip([]), strip(["pass"] * 7), strip(["fail", "fail", "pass", "error", "timeout"]),
            strip(["pass", "pass", "fail", "pass", "pass", "pass"]), strip(["pass", "pass"], "pass"), strip(["skip", "fail"]),
            ([("1", "fail", "1s", None), ("2", "fail", "1s", None)],)]
    got = one(lambda h: F.struct(H.pass_rate_text(h), H.failure_note(h), H.prompt_rate(h), H.prompt_note(h)), ENTRY, *rows)
    first, recurring = "first failure — consistent pass until current build", "recurring failure — flaky or persistent issue"
    assert [tuple(g)[:2] for g in got] == [
        ("", ""), ("0 / 1 passed", ""), ("7 / 8 passed", first), ("1 / 6 passed", recurring),
        ("5 / 7 passed", "intermittent — 1 prior failure(s) in window"), ("3 / 3 passed", ""), ("0 / 3 passed", recurring),
        ("0 / 2 passed", recurring)]
    assert got[0][2] == "no prior history"
    assert got[2][3] == "first failure — was consistently passing before this build"
    assert got[3][3] == "recurring — 4 of 5 prior runs also failed"
    assert got[5][3] == "first failure — was consistently passing before this build"


def test_history_tail(one):
    assert one(H.history_tail, ENTRY, ([],), strip(["pass"])) == ["", "  #0: pass\n  #current: fail"]
    assert one(H.history_tail, ENTRY, strip(["pass"] * 12))[0].count("\n") == 7
