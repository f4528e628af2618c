import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.llm import learning, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held_out_accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id").filter("label is not null").collect()
    assert len(rows) > 500
    return np.mean([r.predicted == r.label for r in rows])


def test_quality_on_held_out_rows(tables):
    scored = quality.scores(*tables)
    assert held_out_accuracy(scored, tables[1], "quality") > 0.98
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(tables):
    scored = toxicity.scores(*tables)
    assert held_out_accuracy(scored, tables[1], "toxic") > 0.98
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows_have_scores(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rng = random.Random(1)
    docs = documents((None, None), (7, ""), (7, ""), (8, "x" * 200_000), *[(i, " ".join(rng.choice(["foo", "bar", "bad" * (i % 2) or "ok"]) for _ in range(30))) for i in range(40)])
    for scores in (quality.scores, toxicity.scores):
        assert scores(docs, labels).filter("score between 0 and 1").count() == 44
        assert scores(docs, labels.limit(0)).filter("score between 0 and 1").count() == 44
        assert scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_isotonic_pools_violators(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.3, 1.0), (0.5, 0.0), (0.9, 1.0)], "raw double, label double")
    at, value = learning.isotonic(rows)
    assert (np.diff(value) >= 0).all() and len(at) == 3


def test_labels_that_disagree_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in learning.labelled(docs, labels, "quality", 1, 5).collect()} == {3, 4}


@pytest.mark.parametrize("spelling, word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"),
                                            ("$cum", "scum"), ("idi0t", "idiot")])
def test_restoration(spark, tables, spelling, word):
    model = _model(tables)
    assert toxicity.Restorer(model)(f"so {spelling} there") == {word}


def test_restoration_against_all_paths(spark, tables):
    from itertools import product
    model = _model(tables)

    def cost(word):
        total, a, b = 0.0, 0, 0
        for c in [*word, None]:
            z = 0 if c is None else toxicity.CLASS_OF.get(c, 1)
            total += model[a, b, z]
            a, b = b, z
        return total

    rng = random.Random(2)
    for _ in range(60):
        spelling = "".join(rng.choice("abcdeilostz0134570@$!(") for _ in range(rng.randint(2, 9)))
        paths = {"".join(p) for p in product(*toxicity.choices(spelling))}
        assert abs(cost(toxicity.restore(spelling, model)) - max(map(cost, paths))) < 1e-9


def test_long_spellings_are_whole(spark, tables):
    import time
    spaced = " ".join("abcdefghijklmnopqrstuvwxyzabcdefghijkl")
    assert [m.group() for m in toxicity.HIDDEN.finditer(f"so {spaced} there")] == [spaced]
    looks = "l0o" * 30
    assert [m.group() for m in toxicity.HIDDEN.finditer(f"so {looks} there")] == [looks]
    began = time.perf_counter()
    for text in ("!" * 200_000, "a " * 100_000, "l0" * 100_000, "x" * 200_000, "$a" * 100_000 + "!"):
        toxicity.Restorer(_model(tables))(text)
    assert time.perf_counter() - began < 30


def test_plain_text_is_no_hidden_word():
    assert not [m.group() for m in toxicity.HIDDEN.finditer("THE!! OF!! tionre$$$ page 12, v2.0 a-b")]


_MODELS = []


def _model(tables):
    if not _MODELS:
        _MODELS.append(toxicity.language_model(tables[0].limit(3000)))
    return _MODELS[0]


def test_hidden_spellings_are_those_of_the_whole_pattern():
    import random

    rng = random.Random(5)
    for alphabet in ("ab1 .", "aAé0!_- \n", "ii*_.d |(3", "aaa\u0660\u00b2\U0001d4d0 4-", "xyz$@ \t.7"):
        for size in range(60):
            for _ in range(60):
                text = "".join(rng.choices(alphabet, k=size))
                assert list(toxicity.hidden(text)) == [m.group() for m in toxicity.HIDDEN.finditer(text)], text
