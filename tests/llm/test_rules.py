"""The rules' counts against a plain Python version, and the compiled table against its rows."""

import re

import pytest
from pyspark.sql import functions as F

from buildlens.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "a b a b a b", "a b c a b c", "x x x x", "é ü 😀😀 ß\n\n é ü 😀😀 ß", "#*$ %& |<> a\x0bb\x0cc\rd",
       "same line\nsame line\n \nsame line ", "a b a b a b", "the end. The end, THE END!"]


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(3)}
    stops = sum(w.lower().strip(rules.ENDS) in rules.STOP_WORDS for w in words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), stops)


@pytest.fixture(scope="module")
def texts():
    import random
    rng = random.Random(5)
    made = [" ".join(rng.choice(["ab", "c", "the", "d#", "e\n", "\tf"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return ODD + made + ["word " * 30_000 + "end"]


@pytest.mark.parametrize("weak", [False, True])
def test_counts_against_plain_python(spark, texts, weak, monkeypatch):
    if weak:  # different runs share a hash, so that the words themselves must decide
        monkeypatch.setattr(rules, "_hash", lambda *words: F.pmod(F.xxhash64(*words), F.lit(5)))
    rows = rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id < len(texts) - 1:
            assert tuple(r[c] for c in rules.MEASURES) == plain(texts[r.doc_id]), texts[r.doc_id]
    long = next(r for r in rows if r.doc_id == len(texts) - 1)
    assert (long.n_words, long.n_repeat_words) == (30_001, 30_000)


def test_table_is_compiled_to_its_rows(spark, texts):
    table = (rules.Rule("few", "n_words", least=3), rules.Rule("signs", "symbol_share", most=0.1), rules.Rule("between", "word_length", least=1.5, most=3))
    rows = rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()
    for r in rows:
        want = [x.name for x in (*rules.BASE, *table)
                if (x.least is not None and r[x.measure] < x.least) or (x.most is not None and r[x.measure] > x.most)]
        assert r.failed_rules == want
        assert r.kept == (not want)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_base_bounds(spark):
    word = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(word[:49])), (1, " ".join(word[:50])), (2, " ".join(word[:25] * 2)), (3, " ".join(word[:50] + word[:50][::-1])),
            (4, " ".join([*word[:26], *word[30:50], "x", *word[:6], "y", *word[6:26]]))]
    got = {r.doc_id: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string"), ()).collect()}
    assert [got[i].base_failed for i in range(4)] == [True, False, True, False]
    assert got[4].base_failed == (200 * got[4].n_repeat_words > 100 * got[4].n_words)


def test_unknown_measure(spark):
    with pytest.raises(ValueError):
        rules.judged(spark.createDataFrame([], "doc_id long, text string"), [rules.Rule("x", "nothing", least=1)])


def test_extra_columns_empty_table_and_plan(spark, documents):
    df = documents((1, "a " * 60), (1, "a " * 60), (None, None))
    clash = df.withColumnRenamed("score", "kept").withColumnRenamed("key", "words").withColumnRenamed("node", "row")
    out = rules.judged(clash)
    assert out.columns[:4] == ["doc_id", "text", "words", "row"]
    assert out.count() == 3
    assert rules.judged(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_each_step_is_computed_once(spark, documents):
    from buildlens.llm.suite import QUERIES
    plan = rules.judged(documents((1, "a"))).select("doc_id", "n_words", "word_chars", "n_repeat_words", "kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("xxhash64") == 1
    assert "op11_quality_rules" in QUERIES
