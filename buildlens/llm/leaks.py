"""Benchmark decontamination by latent semantic retrieval.

Texts are lower-cased words without punctuation, kept as the numbers of the benchmark's terms that they are (other words can match
no item). Passages are runs of consecutive blocks of BLOCK words; an item is compared with passages of one block more than it
fills, which hold it wherever it begins. Over the terms of the benchmark, all blocks of the corpus and the items themselves form a TF-IDF
matrix, and a randomised SVD of it is computed in one pass over the blocks: every task multiplies its rows with a random sign matrix (a
count sketch) and sends the product, of a size that does not depend on the rows. The sums stand for the corpus beside the items' rows, scaled to
the same norm, and the RANK leading right singular vectors of both are kept. Passages and items are projected on them alike, and pairs with a
cosine of COSINE or more are candidates.

A candidate is verified on the words around: the longest common subsequence with the item must
hold LCS of the item's words, and ANSWER of its answer's (the item's last words, or a column of its own),
or nearly all of the item (WHOLE). So paraphrases that change, drop or insert words are found.

Words in more than COMMON of the blocks weigh less in proportion, but never nothing. An item with fewer than LEAST_WORDS words that are rarer than COMMON of the blocks has
too little weight to tell its passages from others; it is searched as all the others are, and besides it is found wherever it
stands word for word. Of fewer than LEAST_WORDS words there is no paraphrase; such items, be they one word, are found word for word. Items without a word are in no text. The benchmark is the query set: it is taken in blocks of
ITEMS items, each of which goes over all documents, and only a block is sent to the tasks. Null texts are empty. Repeated
rows and null ids, of documents and of items, are kept. An empty table on either side gives an empty result. ``clean`` keeps all columns, which
may have any name but ``_terms`` for the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from buildlens.llm.common import hashed_words, mix, small, store, windows

BLOCK = 16
ITEMS = 200
SKETCH = 128
RANK = 256
#: Words of texts that are worked on at a time, but for a longer text, which is taken whole.
PIECE = 100_000
COSINE = 0.5
COMMON = 0.1
LCS, ANSWER, WHOLE = 0.7, 0.5, 0.9
ANSWER_WORDS = 8
LEAST_WORDS = 5
SUM_TASKS = 16
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[b for b in range(128) if not chr(b).isalnum()]] = True


def word_hashes(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, index of each row's first word) of lower-cased texts."""
    for first, last, words, firsts, *_ in hashed_words(pc.utf8_lower(column), separates=_SEPARATES):
        yield first, last, words, firsts


def _blocks(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of every word, numbered over all texts, and the number of blocks before each text (one more at the end)."""
    sizes = np.diff(firsts)
    n = -(-sizes // BLOCK)
    before = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return before[owner] + (np.arange(firsts[-1]) - firsts[:-1][owner]) // BLOCK, before


class Items:
    """A block of the benchmark: word sequences, and its terms in hash order. ``sequences`` are the items as numbers of terms."""

    def __init__(self, ids: list, texts: list[str], answers: list[str | None]):
        self.ids, words, given_answers = [], [], []
        said = [w for *_, found, firsts in word_hashes(pa.array(texts, pa.string())) for w in np.split(found, firsts[1:-1])]
        given = [w for *_, found, firsts in word_hashes(pa.array(answers, pa.string())) for w in np.split(found, firsts[1:-1])]
        for i, own, answer in zip(ids, said, given, strict=True):
            if len(own):
                self.ids.append(i)
                words.append(own)
                given_answers.append(answer if len(answer) else own[-ANSWER_WORDS:])
        self.terms = np.unique(np.concatenate([*words, *given_answers, np.zeros(0, np.uint64)]))
        self.sequences = [self.term(w) for w in words]
        self.answers = [self.term(w) for w in given_answers]

    def term(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(words), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1).astype(np.int32)
        return np.where(self.terms[at] == words, at, np.int32(-1))

    def rows(self) -> np.ndarray:
        out = np.zeros((len(self.sequences), len(self.terms)), np.float32)
        for i, terms in enumerate(self.sequences):
            np.add.at(out[i], terms, 1)
        return out


def with_terms(docs: DataFrame, items: Items, text_col: str, kept_columns: list[str]) -> DataFrame:
    """Columns of the documents with ``_terms``, the number of the term of every word, written down: texts are read and split once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            found = []
            for _, _, words, firsts in word_hashes(part.column(text_col)):
                terms = items.term(words)
                found += [terms[a:b].tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.select(kept_columns).columns, pa.array(found, pa.binary())], [*kept_columns, "_terms"])

    kept = [f for f in docs.schema.fields if f.name in kept_columns]
    return store(docs.mapInArrow(split, StructType([*kept, StructField("_terms", BinaryType())])))


def _pieces(batches: Iterator[pa.RecordBatch], items: Items, column: str) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, last row, terms, index of each row's first word) of about PIECE words each, from ``_terms`` or from texts."""
    for batch in small(batches):
        if column != "_terms":
            for first, last, words, firsts in word_hashes(batch.column(column)):
                yield batch, first, last, items.term(words), firsts
            continue
        rows = batch.column("_terms")
        sizes = np.asarray(pc.binary_length(rows)) // 4
        first = 0
        while first < batch.num_rows:
            last, total = first, 0
            while last < batch.num_rows and (last == first or total + sizes[last] <= PIECE):
                total += int(sizes[last])
                last += 1
            firsts = np.concatenate(([0], np.cumsum(sizes[first:last]))).astype(np.int64)
            yield batch, first, last, np.frombuffer(b"".join(rows.slice(first, last - first).to_pylist()), np.int32), firsts
            first = last


def _sketch(items: Items, column: str):
    """Rows (r, data): for r < SKETCH a row of the count sketch of the task's block-term matrix, for r = SKETCH the
    number of times each term occurs, and for SKETCH + 1 the number of blocks."""

    n = len(items.terms)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, blocks = np.zeros(SKETCH * n), np.zeros(n), 0
        for _, _, _, terms, firsts in _pieces(batches, items, column):
            block, before = _blocks(firsts)
            blocks += int(before[-1])
            own = np.flatnonzero(terms >= 0)
            term, at = terms[own].astype(np.int64), block[own]
            seen += np.bincount(term, minlength=n)
            starts = np.searchsorted(block, np.arange(before[-1]))
            h = mix(terms[starts].astype(np.uint64) + mix(np.arange(before[-1], dtype=np.uint64) + np.uint64(len(terms))))[at]
            sign = np.where(h >> np.uint64(63) == 0, 1.0, -1.0)
            total += np.bincount((h % np.uint64(SKETCH)).astype(np.int64) * n + term, sign, minlength=SKETCH * n)
        rows = [*total.reshape(SKETCH, n).astype(np.float32), seen.astype(np.float32), np.array([blocks], np.float32)]
        yield _numbered(rows)

    return sketch


def _numbered(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())], ["r", "data"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.frombuffer(data, np.float32).astype(np.float64)
            sums[r] = sums[r] + row if r in sums else row
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["r", "data"])


def _summed(known: DataFrame, column: str, step) -> list[np.ndarray]:
    made = known.select(column).mapInArrow(step, "r int, data binary").repartition(SUM_TASKS, "r").mapInArrow(_sum, "r int, data binary")
    sums = {r["r"]: np.frombuffer(r["data"]) for r in made.collect()}
    return [sums[r] for r in sorted(sums)]


def latent(known: DataFrame, items: Items, column: str = "_terms") -> tuple[np.ndarray, np.ndarray]:
    """Term weights times right singular vectors (row t is what one occurrence of term t adds to a passage's coordinates), and for each
    term the share of blocks that it is in, at most."""
    n = len(items.terms)
    sums = _summed(known, column, _sketch(items, column))
    if not n or not sums or not sums[-1][0]:
        return np.zeros((n, 1), np.float32), np.zeros(n)
    blocks = sums[SKETCH + 1][0]
    seen = np.minimum(sums[SKETCH], blocks)
    idf = np.log1p(blocks / (1 + seen)) * np.minimum(1.0, COMMON * blocks / np.maximum(seen, 1))
    corpus, own = np.stack(sums[:SKETCH]) * idf, items.rows() * idf
    rows = np.vstack([corpus, own * max(1.0, np.linalg.norm(corpus) / max(1e-9, np.linalg.norm(own)))])
    values, left = np.linalg.eigh(rows @ rows.T)
    kept = np.flatnonzero(values > 1e-9 * max(1e-9, values[-1]))[-RANK:]
    right = rows.T @ left[:, kept] / np.sqrt(values[kept])
    return (idf[:, None] * right).astype(np.float32), seen / blocks


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bits: ``masks`` has the places of each word in the one sequence."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if (m := masks.get(w)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _running(x: np.ndarray) -> np.ndarray:
    """Sums before each row, in double precision, and the whole sum at the end."""
    return np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))


class Phrases:
    """Items looked for word for word."""

    def __init__(self, items: Items, which: list[int]):
        self.by_size: dict[int, dict[int, list[int]]] = {}
        self.sequences = items.sequences
        for i in which:
            size = min(len(items.sequences[i]), LEAST_WORDS)
            start = int(self._windows(items.sequences[i][:size], size)[0])
            self.by_size.setdefault(size, {}).setdefault(start, []).append(i)

    @staticmethod
    def _windows(terms: np.ndarray, size: int) -> np.ndarray:
        return windows((terms + 1).astype(np.uint64), size)

    def find(self, terms: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, word) of the first place of an item in a text."""
        for size, starts in self.by_size.items():
            h = self._windows(terms, size)
            for at in np.flatnonzero(np.isin(h, np.array(list(starts), np.uint64))).tolist():
                text = int(np.searchsorted(firsts, at, side="right")) - 1
                for i in starts[int(h[at])]:
                    end = at + len(self.sequences[i])
                    if end <= firsts[text + 1] and np.array_equal(terms[at:end], self.sequences[i]):
                        yield text, i, at - int(firsts[text])


def _coordinates(terms: np.ndarray, block: np.ndarray, before: np.ndarray, firsts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum of the vectors of every block's terms, word by word of all blocks at once."""
    places = np.full((int(before[-1]), BLOCK), len(vectors), np.int32)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = block * BLOCK + (np.arange(len(terms)) - firsts[:-1][owner]) % BLOCK
    places.ravel()[at[terms >= 0]] = terms[terms >= 0]
    places.sort(axis=1)  # other words last, so that blocks without any more words are left out
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    coords = np.zeros((len(places), vectors.shape[1]), np.float32)
    for k in range(BLOCK):
        some = np.flatnonzero(places[:, k] < len(vectors))
        if 2 * len(some) > len(places):
            coords += padded[places[:, k]]
        elif len(some):
            coords[some] += padded[places[some, k]]
    return coords


def _search(items: Items, vectors: np.ndarray, shares: np.ndarray, column: str = "_terms"):
    shown = items.rows() @ vectors
    norms = np.linalg.norm(shown, axis=1, keepdims=True)
    unit = np.divide(shown, norms, out=np.zeros_like(shown), where=norms > 1e-6).T
    masks = [masks_of(w) for w in items.sequences]
    answers = [masks_of(w) for w in items.answers]
    phrases = Phrases(items, [i for i, w in enumerate(items.sequences) if np.count_nonzero(shares[w] <= COMMON) < LEAST_WORDS])
    scales: dict[int, list[int]] = {}
    for i, w in enumerate(items.sequences):
        if len(w) < LEAST_WORDS:
            continue
        scales.setdefault(-(-len(w) // BLOCK) + 1, []).append(i)

    widest = max(scales, default=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Every batch with what is found in its rows: (row, item, cosine, share of the item, share of the answer, word)."""
        for batch, first, _, terms, firsts in _pieces(batches, items, column):
            found: list[tuple] = []
            exact: dict[tuple[int, int], int] = {}
            for text, item, word in phrases.find(terms, firsts):
                exact.setdefault((text, item), word)
            block, before = _blocks(firsts)
            own = np.flatnonzero(terms >= 0)
            best: dict[tuple[int, int], list] = {}
            if len(own):
                coords = _coordinates(terms, block, before, firsts, vectors)
                text_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
                scores = _running(coords @ unit)
                squares = [_running(np.append(np.einsum("ij,ij->i", coords[k:], coords[: len(coords) - k]), np.zeros(k))) for k in range(min(widest, len(coords)))]
                last_of = before[1:][text_of]
                start = np.arange(len(coords))
                for scale, own in scales.items():
                    # a text's passages end with it; a shorter text is one passage
                    some = np.flatnonzero((start + scale <= last_of) | (start == before[:-1][text_of]))
                    end = np.minimum(some + scale, last_of[some])
                    square = squares[0][end] - squares[0][some]
                    for k in range(1, min(scale, len(squares))):
                        square += 2 * (squares[k][np.maximum(end - k, some)] - squares[k][some])
                    real = square > 1e-3
                    some, end, size = some[real], end[real], np.sqrt(square[real])
                    near = scores[np.ix_(end, own)] - scores[np.ix_(some, own)]
                    for p, at in zip(*np.nonzero(near >= COSINE * size[:, None]), strict=True):
                        b = int(some[p])
                        best.setdefault((int(text_of[b]), own[at]), []).append((b, int(end[p]), float(near[p, at] / size[p])))
            for (text, item), spans in best.items():
                hit = _verified(spans, terms[firsts[text] : firsts[text + 1]], int(before[text]), items.sequences[item], masks[item], items.answers[item], answers[item])
                if hit:
                    found.append((first + text, item, *hit))
                    exact.pop((text, item), None)
            found += [(first + text, item, 1.0, 1.0, 1.0, word) for (text, item), word in exact.items()]
            yield batch, found

    return search


def _verified(spans: list[tuple[int, int, float]], words: np.ndarray, before: int, item: np.ndarray, masks: dict[int, int], answer: np.ndarray,
              answer_masks: dict[int, int]) -> tuple[float, float, float, int] | None:
    """Best (cosine, share of the item, share of the answer, first word) of the regions of a text that passages point at."""
    regions: list[list] = []
    for a, b, cosine in sorted(spans):
        a, b = (a - before) * BLOCK, (b - before) * BLOCK
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
            regions[-1][2] = max(regions[-1][2], cosine)
        else:
            regions.append([a, b, cosine])
    best = None
    reach = len(item) + len(item) // 2
    own = np.unique(item)
    for a, b, cosine in regions:
        start = max(0, a - len(item))
        part = words[start : b + len(item)]
        # no more words can be in common than are words of the item at all
        shared = np.concatenate(([0], np.cumsum(np.isin(part, own))))
        for offset in range(0, max(1, len(part) - len(item) // 2), max(1, len(item) // 4)):
            if shared[min(len(part), offset + reach)] - shared[offset] < LCS * len(item):
                continue
            near = part[offset : offset + reach].tolist()
            share = lcs(masks, len(item), near) / len(item)
            if share < LCS or best and share <= best[1]:
                continue
            answered = lcs(answer_masks, len(answer), near) / len(answer)
            if answered >= ANSWER or share >= WHOLE:
                best = (cosine, share, answered, start + offset)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          answer_col: str | None = None) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, lcs and answer (shares), and word, where the
    text around it begins."""
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, cosine double, lcs double, answer double, word long"
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def report(items: Items, search):
        item_type = to_arrow_type(benchmark.schema[item_col].dataType)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in search(batches):
                cols = list(zip(*found, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array([items.ids[i] for i in cols[1]], item_type),
                     *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())],
                    ["doc_id", "item_id", "cosine", "lcs", "answer", "word"])

        return rows

    parts = []
    for items in item_blocks(benchmark, item_col, item_text_col, answer_col):
        known = with_terms(asked, items, "text", ["doc_id"])
        parts.append(known.mapInArrow(report(items, _search(items, *latent(known, items))), kinds))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Texts go to the tasks twice and are split there each time, which costs less than to write all rows down with their terms.
    """
    out, last = docs, None
    for items in item_blocks(benchmark, item_col, item_text_col, answer_col):
        if last is not None:
            out = store(out)
        out = out.mapInArrow(_without(_search(items, *latent(out, items, text_col), text_col), docs.columns), docs.schema)
        last = items
    return out


def _without(search, columns: list[str]):
    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keep = None, np.zeros(0, bool)
        for batch, found in search(batches):
            if batch is not last:
                if last is not None:
                    yield last.filter(pa.array(keep)).select(columns)
                last, keep = batch, np.ones(batch.num_rows, bool)
            keep[[f[0] for f in found]] = False
        if last is not None:
            yield last.filter(pa.array(keep)).select(columns)

    return without


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> Iterator[Items]:
    """The benchmark in blocks of at most about ITEMS items."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), answer.alias("answer"))
    numbered = asked.withColumn("part", F.lit(0))
    n = asked.count()
    if n > ITEMS:
        numbered = store(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-2 * n // ITEMS)))))
    parts = 1 if n <= ITEMS else -(-2 * n // ITEMS)
    for part in range(parts):
        rows = numbered.filter(F.col("part") == part).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], [r["answer"] for r in rows])
