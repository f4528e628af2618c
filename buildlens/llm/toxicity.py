"""Toxicity of documents through a noisy channel.

A writer who hides a word spells it with look-alike characters (``1d10t``), spaces or points
between its letters (``i d i o t``), or repeated letters (``idiiiot``). Each such spelling is a lattice of
possible letters; Viterbi decoding finds its likeliest restoration under a character trigram
model, whose counts are gathered from the whole corpus. The original and the restored words
are then scored.

The score's evidence is learned from labelled rows: for whole words and beginnings of words the log odds of toxic
documents against others, from how many of each hold them. The FEATURES ones in most toxic documents are looked at, those in at least LEAST_TOXIC of them.
A word's evidence is that of its best feature, a document's the sum of its STRONGEST words' evidence: one word that clean
documents hardly hold, or two that are doubtful alone. Isotonic calibration turns it into a probability. It is fitted
on a quarter of the labelled rows with features learned from the others; then features are learned from all.

Only the text is an input of a score. Null texts are empty texts and get a score like any
other; repeated rows and null ids keep a row each. Without toxic labels every score is 0. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import drop_stored, store
from buildlens.llm.learning import fold, isotonic, labelled

PARTS, HELD = 3, 1
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
LEAST_TOXIC = 3
LEAST_ODDS = 1.0
FEATURES = 200_000
STRONGEST = 2
#: Evidence that counts as certain; raw scores are shares of it.
CERTAIN = 20.0

#: Letters that a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_LOOK = "".join(re.escape(c) for c in LOOKS)
_LETTER = r"[^\W\d_]"
#: Spellings that may hide a word: look-alikes among letters, single letters apart, letters repeated three times.
HIDDEN = re.compile(
    rf"(?<![\w{_LOOK}])(?:(?=[{_LOOK}]*{_LETTER}+[{_LOOK}]+{_LETTER}|[{_LOOK}]+{_LETTER}|{_LETTER}+[013457@$](?![\w{_LOOK}]))(?:{_LETTER}|[{_LOOK}]){{3,}})"
    rf"|(?<!\w){_LETTER}(?:([\x20.\-_*]){_LETTER}(?!{_LETTER})){{2,}}(?!\w)"
    rf"|(?<!\w){_LETTER}*({_LETTER})\2\2{_LETTER}*")
_WORD = re.compile(rf"{_LETTER}+")
#: What a code point may be, as bits: of a word, a letter, a look-alike, a mark between single letters.
_IN_WORD, _IS_LETTER, _IS_LOOK, _IS_APART = 1, 2, 4, 8
_KIND = np.zeros(0x110000, np.uint8)
for _bit, _pattern in ((_IN_WORD, r"\w"), (_IS_LETTER, _LETTER), (_IS_LOOK, f"[{_LOOK}]"), (_IS_APART, r"[\x20.\-_*]")):
    for _run in re.finditer(f"{_pattern}+", "".join(map(chr, range(0x110000)))):
        _KIND[_run.start() : _run.end()] |= _bit
#: Classes of the character model: 0 is a word's edge, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
WIDE = 64
_CLASS = np.zeros(0x180, np.int64)
_CLASS[[ord(c) for c in LETTERS]] = np.arange(2, 2 + len(LETTERS))
_CLASS[[c for c in range(0x180) if chr(c).isalpha() and not _CLASS[c]]] = 1
CLASS_OF = {c: 2 + i for i, c in enumerate(LETTERS)}


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of character trigrams by class, words' edges included, flat."""
    counts = np.zeros(WIDE**3, np.int64)
    for text in texts:
        points = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le"), "<u4")
        classes = _CLASS[np.minimum(points, 0x17F)]
        keys = (classes[:-2] * WIDE + classes[1:-1]) * WIDE + classes[2:]
        counts += np.bincount(keys, minlength=WIDE**3)
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDE**3, np.int64)
    for batch in batches:
        held, size = [], 0
        for t in batch.column(0):
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size > 1_000_000:
                total += trigrams(["  ".join(held)])
                held, size = [], 0
        total += trigrams(["  ".join(held)])
    keys = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a class after two classes, [a, b, c], from the trigram counts of all documents.

    Each task sends its counts (what is gathered grows with the corpus); their sum has at most 64^3 rows.
    """
    rows = docs.select(text_col).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(WIDE**3)
    for key, n in rows:
        counts[key] = n
    counts = counts.reshape(WIDE, WIDE, WIDE)
    pairs = counts.sum(0)
    singles = pairs.sum(0) + 1
    two = (pairs + 5 * singles / singles.sum()) / (pairs.sum(1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(three)


def choices(spelling: str) -> list[list[str]]:
    """The lattice: for each place what it may hold, longest runs as one letter or two, separators as nothing."""
    places: list[list[str]] = []
    letters = [c for c in spelling.lower() if c not in " .-_*"]
    i = 0
    while i < len(letters):
        j = i
        while j < len(letters) and letters[j] == letters[i]:
            j += 1
        c = letters[i]
        held = list(LOOKS.get(c, c))
        if not c.isalpha() and (j == len(letters) or i == 0) and c in "!|+(":
            held.append("")
        places.append(held + ([x * 2 for x in held if x] if j - i > 1 else []))
        i = j
    return places


def restore(spelling: str, model: np.ndarray) -> str:
    """The likeliest word that a spelling stands for."""
    now: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for place in choices(spelling):
        ahead: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), cost in now.items():
            for held in place:
                x, y, score = a, b, cost
                for c in held:
                    z = CLASS_OF.get(c, 1)
                    score += model[x, y, z]
                    x, y = y, z
                if (x, y) not in ahead or score > ahead[x, y]:
                    ahead[x, y] = score
                    back[x, y] = ((a, b), held)
        now = ahead
        steps.append(back)
    state = max(now, key=lambda s: now[s] + model[s[0], s[1], 0])
    word = []
    for back in reversed(steps):
        state, held = back[state]
        word.append(held)
    return "".join(reversed(word))


def hidden(text: str) -> Iterator[str]:
    """What HIDDEN finds in a text, one after the other.

    It is tried only at the beginnings of runs that it may match: of letters and look-alikes, where these meet; of a word with a letter three
    times in a row; and of single letters apart.
    """
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), "<u4")
    kind = _KIND[points]
    letter, look, inside = (kind & b != 0 for b in (_IS_LETTER, _IS_LOOK, _IN_WORD))
    either = letter | look
    starts = []
    meet = np.flatnonzero((letter[:-1] & look[1:]) | (look[:-1] & letter[1:]))
    if len(meet):
        begins = np.flatnonzero(either[1:] & ~either[:-1]) + 1
        starts += begins[np.searchsorted(begins, meet, side="right") - 1].tolist()
    triple = np.flatnonzero((points[:-2] == points[1:-1]) & (points[1:-1] == points[2:]) & letter[2:])
    if len(triple):
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        starts += begins[np.searchsorted(begins, triple, side="right") - 1].tolist()
    apart = kind & _IS_APART != 0
    alone = np.flatnonzero(letter[1:-4] & ~inside[:-5] & apart[2:-3] & letter[3:-2] & apart[4:-1] & letter[5:])
    starts += (alone + 1).tolist()
    end = 0
    for at in sorted(set(starts)):
        if at > end and (found := HIDDEN.match(text, at - 1)):
            yield found.group()
            end = found.end()


class Restorer:
    """Restored words of texts; equal spellings are decoded once."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, str] = {}

    def __call__(self, text: str) -> set[str]:
        out = set()
        for spelling in hidden(text):
            if spelling not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[spelling] = restore(spelling, self.model)
            out.add(self.known[spelling])
        return out


def words(text: str, restorer: Restorer) -> set[str]:
    return set(_WORD.findall(text.lower())) | restorer(text)


def features(found: set[str]) -> set[str]:
    """Whole words (=word) and beginnings (^begin)."""
    out = {"=" + w for w in found}
    for size in BEGINNINGS:
        out.update("^" + w[:size] for w in found if len(w) > size)
    return out


def evidence(docs: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Features and their log odds, from labelled documents (text, label), each text once."""
    sizes = {r["label"]: r["count"] for r in docs.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1.0, 0), sizes.get(0.0, 0)

    def counted(known: set[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(model)
            seen: Counter = Counter()
            for batch in batches:
                for t in batch.column(0):
                    held = features(words(t.as_py() or "", restorer))
                    seen.update(held if known is None else held & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

        return count

    def by_feature(label: int, known: set[str] | None) -> DataFrame:
        return docs.filter(F.col("label") == label).select("text").mapInArrow(counted(known), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    often = {r["feature"]: r["n"] for r in by_feature(1, None).filter(F.col("n") >= LEAST_TOXIC).orderBy(F.desc("n"), "feature").limit(FEATURES).collect()}
    against = {r["feature"]: r["n"] for r in by_feature(0, set(often)).collect()}
    odds = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((against.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in often.items()}
    return {f: o for f, o in odds.items() if o > LEAST_ODDS}


class Scorer:
    """The evidence of a text's strongest words, as a share of what is certain."""

    def __init__(self, odds: dict[str, float], model: np.ndarray):
        self.whole = {f[1:]: o for f, o in odds.items() if f[0] == "="}
        self.begins = {f[1:]: o for f, o in odds.items() if f[0] == "^"}
        self.restorer = Restorer(model)

    def __call__(self, text: str) -> float:
        held = words(text, self.restorer)
        best = {w: self.whole[w] for w in held & self.whole.keys()}
        for size in BEGINNINGS:
            for word in held:
                if len(word) > size and (odds := self.begins.get(word[:size])) and odds > best.get(word, 0.0):
                    best[word] = odds
        found = best.values()
        return min(1.0, sum(sorted(found)[-STRONGEST:]) / CERTAIN)


def raw_scores(docs: DataFrame, odds: dict[str, float], model: np.ndarray, keep: list[str], points: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``keep`` and ``raw``, the share of certain evidence, or the probability that ``points`` give it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(odds, model)
        for batch in batches:
            values = np.array([scorer(t.as_py() or "") for t in batch.column("text")], np.float64)
            if points:
                values = np.interp(values, *points)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values)], [*keep, "raw"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(score, f"{kinds}, raw double")


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = PARTS, held: int = HELD, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = language_model(docs)
    found = labelled(docs.select("doc_id", "text"), labels, label, parts, held)
    known = store(found.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")))
    fitted = F.pmod(F.xxhash64("text", F.lit(label)), F.lit(4)) != 0
    partly = evidence(known.filter(fitted), model)
    points = isotonic(raw_scores(known.filter(~fitted), partly, model, ["label"]), level=True) if partly else (np.array([0.0, 1.0]), np.zeros(2))
    odds = evidence(known, model)
    drop_stored(known)
    scored = raw_scores(docs.select("doc_id", "text"), odds, model, ["doc_id"], points)
    return scored.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), F.col("raw").alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
