import random
import re

import numpy as np
import pytest

from buildlens.llm import leaks

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


def test_verbatim_items_are_found_and_nothing_else(spark, benchmark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = {r.item_id: plain(r.text) for r in benchmark.collect()}
    held = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, i) for d, t in held.items() for i, x in items.items() if x in t}
    assert want and {(r.doc_id, r.item_id) for r in leaks.leaks(docs, benchmark).collect()} == want
    assert leaks.clean(docs, benchmark).count() == len(held) - len({d for d, _ in want})


@pytest.mark.parametrize("items", [400, 15])
def test_paraphrases(spark, benchmark, monkeypatch, items):
    monkeypatch.setattr(leaks, "ITEMS", items)
    rng = random.Random(3)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    hosts = [r.text for r in docs.limit(60).collect()]
    extra, want = [], set()
    for k, item in enumerate(benchmark.collect()):
        words = item.text.split()
        if len(words) < 15:
            continue
        words = [w.upper() if rng.random() > 0.12 else rng.choice(hosts).split()[0] for w in words]
        host = hosts[k].split()
        at = rng.randrange(len(host) + 1)
        extra.append((-1 - k, " ".join(host[:at] + words + host[at:])))
        want.add((-1 - k, item.item_id))
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(docs.union(spark.createDataFrame(extra, "doc_id long, text string")), benchmark).collect()}
    assert len(want & found) >= 0.95 * len(want)


def test_items_in_most_documents_in_few_and_of_one_word(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(30)), (2, "Zebra!"), (3, "two words"), (4, " . "), (None, text(20)), (5, text(25)), (5, text(25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"{text(60)} {items[0][1]} {text(40)}" if i % 10 else text(80)) for i in range(57)]
    docs += [(100, f"a zebra {text(9)}"), (101, f"{text(5)} Two, WORDS {text(3)}"), (102, f"two other words {text(20)}"), (103, items[4][1]), (104, items[6][1])]
    found = sorted(((r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()), key=str)
    want = [(i, 1) for i in range(57) if i % 10] + [(100, 2), (101, 3), (103, None), (104, 5)]
    assert found == sorted(want, key=str)
    for n in (1, 3, 7):
        few = [(0, items[0][1]), *((k, text(50)) for k in range(1, n))]
        assert [(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(few, "doc_id long, text string"), bench.filter("item_id = 1")).collect()] == [(0, 1)]


def test_recall_of_candidates(spark, benchmark, monkeypatch):
    """Of paraphrases that are leaks by their common subsequences, the cosine search alone must point at nearly all."""
    rng = random.Random(8)
    hosts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars > 3000").select("text").limit(300).collect()]
    items = benchmark.collect()
    docs, want = [], set()
    for k in range(600):
        item, host = items[k % len(items)], hosts[k % len(hosts)].split()
        said = [w if rng.random() > 0.25 else rng.choice(host) for w in item.text.split()]
        at = rng.randrange(len(host))
        docs.append((k, " ".join(host[:at] + said + host[at:])))
        want.add((k, item.item_id))
    monkeypatch.setattr(leaks.Phrases, "find", lambda self, terms, firsts: iter(()))
    monkeypatch.setattr(leaks, "_verified", lambda *a: (1.0, 1.0, 1.0, 0))
    (block,) = leaks.item_blocks(benchmark)
    known = leaks.with_terms(spark.createDataFrame(docs, "doc_id long, text string"), block, "text", ["doc_id"])
    batches = known.toArrow().to_batches()
    found = {(batch.column("doc_id")[f[0]].as_py(), block.ids[f[1]]) for batch, found in leaks._search(block, *leaks.latent(known, block))(iter(batches)) for f in found}
    assert len(want & found) >= 0.95 * len(want)
    assert len(found) <= 20 * len(want)


def test_odd_rows(documents, benchmark):
    docs = documents((None, None), (1, ""), (1, ""), (2, ". ! ?"), (3, "word " * 50_000))
    assert leaks.leaks(docs, benchmark).count() == 0
    assert leaks.clean(docs, benchmark).columns == docs.columns
    assert leaks.clean(docs, benchmark).count() == 5
    assert leaks.leaks(docs.limit(0), benchmark).count() == 0
    assert leaks.leaks(docs, benchmark.limit(0)).count() == 0
    assert leaks.leaks(docs, benchmark.selectExpr("item_id", "cast(null as string) as text")).count() == 0


def test_lcs():
    assert leaks.lcs(leaks.masks_of(np.array([1, 2, 3, 4, 2])), 5, [2, 9, 3, 2, 4, 2]) == 4
