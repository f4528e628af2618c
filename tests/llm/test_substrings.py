import hashlib
import random
import re

import pytest

from buildlens.llm import substrings

RNG = random.Random(5)
SMALL = [(None if i == 0 else i, " ".join(RNG.choice("ab") for _ in range(RNG.randrange(0, 120)))) for i in range(60)]
SMALL += [(100, None), (101, ""), (102, "x " * 300), (103, "x y\x1cz \t\x0b" * 100)]


def brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def found(df, window):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.removed(df, window=window)).collect()}


@pytest.mark.parametrize("name, value", [("SHARD_WORDS", 60_000), ("SHARD_WORDS", 50), ("HOT_SEGMENTS", 3), ("BROADCAST_BYTES", 0)])
def test_every_way_agrees_with_brute_force(documents, monkeypatch, name, value):
    monkeypatch.setattr(substrings, name, value)
    assert found(documents(*SMALL), 6) == brute(SMALL, 6)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs, 20) == brute([(r.doc_id, r.text) for r in docs.collect()], 20)


def test_repeated_rows_and_empty_table(documents):
    text = " ".join(map(str, range(30)))
    rows = substrings.removed(documents((1, text), (1, text), (2, text + " more"))).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept) for r in rows] == [(0, text), (0, text), (30, "more")]
    assert substrings.removed(documents()).count() == 0


def test_automaton_finds_earliest_places():
    a = substrings.Automaton()
    a.add([1, 2, 3, 4, 1, 2, 3], 100)
    a.add([9, 2, 3, 4, 9], 10)
    a.settle()
    assert list(a.earliest([1, 2, 3, 4, 9], 3)) == [(0, 102), (1, 13), (2, 14)]
