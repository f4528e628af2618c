import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from buildlens.llm import graph, near_dup
from buildlens.llm.common import hashed_words


def kmers(text):
    words = (text or "").split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def similarity(a, b):
    """Longest common subsequence of the k-mers, by the textbook table."""
    x, y = kmers(a), kmers(b)
    row = [0] * (len(y) + 1)
    for p in x:
        before = row[:]
        for j, q in enumerate(y):
            row[j + 1] = before[j] + 1 if p == q else max(before[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1]) if x and y else float(len(x) == len(y))


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(150)]
        for _ in range(rng.randint(1, 9)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 9])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            rows.append((i, " ".join(copy)))
            i += 1
        half = base[:]
        rows.append((i, " ".join(half[75:] + half[:75])))
        rows.append((i + 1, " ".join(base[:60] + [word() for _ in range(90)])))
        i += 2
    # sections under one line that repeats, with that line once more in front, in the middle, twice, and left out once
    line = [word() for _ in range(8)]
    for _ in range(5):
        sections = [line + [word() for _ in range(12)] for _ in range(12)]
        flat = [w for x in sections for w in x]
        for copy in (flat, line + flat, flat[:100] + line + flat[100:], line + line + flat, flat[8:]):
            rows.append((i, " ".join(copy)))
            i += 1
    # a table of equal rows, and a longer one
    for n in (30, 33, 60):
        rows.append((i, " ".join(line * n)))
        i += 1
    return rows


def test_classes_are_the_components_of_all_links(documents):
    rows = corpus()
    edges = [(a, b) for a, x in rows for b, y in rows if a < b and similarity(x, y) >= 0.8]
    least = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = near_dup.near_duplicates(documents(*rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == least
    assert {r.doc_id for r in found if r.kept} == set(least.values())


def test_odd_rows(documents):
    docs = documents((-1, None), (-2, ""), (-3, " "), (-4, "one two"), (-5, "one  two"), (None, "one three"), (None, "one three"), (-8, "x " * 20_000), (-9, "x " * 19_000))
    found = near_dup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == {-1: -3, -2: -3, -3: -3, -4: -5, -5: -5, None: None, -8: -9, -9: -9}
    assert Counter(r.doc_id for r in found if r.kept) == Counter([-3, -5, None, -9])
    left = near_dup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([-3, -5, None, -9])
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_needs_few_comparisons(documents, monkeypatch):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = base[:]
        copy[rng.randrange(200)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    made = []
    real = near_dup._compare
    monkeypatch.setattr(near_dup, "_compare", lambda pairs, orders: made.append(real(pairs, orders)) or made[-1])
    assert {r.class_id for r in near_dup.near_duplicates(documents(*rows)).collect()} == {0}
    assert sum(x.count() for x in made) < 10 * len(rows)


@pytest.mark.parametrize("a, b", [("a b c d e f g", "a b c d e f g"), ("a a a a a a a a", "a a a a a a a a a"), ("a b c d e f g h i j", "f g h i j a b c d e")])
def test_alignment_of_kmers(a, b):
    orders = []
    for text in (a, b):
        for _, _, words, firsts, *_ in hashed_words(pa.array([text])):
            orders.append(near_dup.plain_kmers(words, firsts)[0].astype(np.uint32))
    assert abs(near_dup.similarity(*orders, 0.01) - similarity(a, b)) < 1e-9


@pytest.mark.parametrize("kinds", [2, 5, 40, 400])
def test_alignment_is_the_longest_common_subsequence(kinds, monkeypatch):
    monkeypatch.setattr(near_dup, "BITS", 16)
    rng = random.Random(kinds)
    for _ in range(60):
        a = [rng.randrange(kinds) for _ in range(rng.randint(0, 90))]
        b = [x for x in a if rng.random() < 0.9]
        for _ in range(rng.randint(0, 9)):
            b.insert(rng.randint(0, len(b)), rng.randrange(kinds))
        row = [0] * (len(b) + 1)
        for p in a:
            before = row[:]
            for j, q in enumerate(b):
                row[j + 1] = before[j] + 1 if p == q else max(before[j + 1], row[j])
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert near_dup.aligned(x, y, 1000) == row[-1] == near_dup._by_bits(x, y)
        exact = row[-1] / (len(a) + len(b) - row[-1]) if a and b else float(len(a) == len(b))
        common = sum((Counter(a) & Counter(b)).values())
        bound = common / (len(a) + len(b) - common) if a and b else exact
        assert near_dup.most_similar(near_dup.ranked(x), near_dup.ranked(y)) == bound >= exact
        for least in (0.5, 0.8):
            assert near_dup.similarity(x, y, least) == exact or max(exact, near_dup.similarity(x, y, least)) < least


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200}
