"""Best-fit packing by exact-complement hashing.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Only the
histogram of piece lengths (at most ``capacity`` numbers, however many documents) comes
to the driver. There, sums of one, two and three lengths are looked up as exact
complements of each gap, as often as the counts allow; lengths without a complement are
placed best-fit. Of several plans, which differ in how small a length exact fills begin at, the shortest is taken. The result is a list of patterns with multiplicities. Each piece finds
its place by its length and its rank within that length, so no task holds the pieces of
one length: ranks come from slots of bounded size plus the slots' offsets.

Null texts are empty: one piece with the end token alone. Null or repeated ids are
packed like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.llm.common import give_back, small, store

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
SLOT_ROWS = 250_000
CACHED_CHUNKS = 300_000
CACHED_WORDS = 400_000


class Encoder:
    """Ids of a text as little-endian bytes, equal to the tokenizer's; equal words are encoded once.

    The tokenizer normalizes and splits at white space first, so a text's ids are those of its
    white-space-free chunks in order. A chunk of Latin-1 letters, perhaps with one point or comma
    behind, is one word in lower case for the model. Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.bytes_as = {b: (b if b in kept else next(other)) for b in range(256)}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin1").translate(self.bytes_as)
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        plain = chunk.isascii() or max(chunk) < "Ā"
        if plain and chunk.isalpha() and "ª" not in chunk and "º" not in chunk:
            return self.word(chunk.lower())
        if plain and chunk[-1] in ".," and (head := chunk[:-1]).isalpha() and "ª" not in head and "º" not in head:
            return self.word(head.lower()) + self.word(chunk[-1])
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        chunks, found = self.chunks, []
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space for Python alone
        for chunk in re.findall(r"[^ \t\n\r]+", text) if odd else text.split():
            ids = chunks.get(chunk)
            if ids is None:
                ids = self.chunk(chunk)
                if len(chunks) >= CACHED_CHUNKS:
                    chunks.clear()
                chunks[chunk] = ids
            found.append(ids)
        return b"".join(found)

    def forget(self) -> None:
        """Keep no words: the worker is kept for tasks of other kinds, which need its memory."""
        self.chunks.clear()
        self.words.clear()
        give_back()


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder for each Python worker, so that its tokenizer is read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        try:
            for batch in small(batches):
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    ids = own.text(text.as_py() or "") + b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        at.append(i)
                        rows.append((piece, start, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in cols[1:4])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])
        finally:
            own.forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence, how many such sequences) that use up all counts.

    Exact fills of small lengths can use up what larger ones need. So plans are made with exact fills for all lengths, for those
    above some shares of the capacity, and for none, each with best fit for the rest, and the one of fewest sequences is
    taken, of equal ones that with the most exact fills. No plan is worse than best fit alone.
    """
    plans = [_plan(counts, capacity, least) for least in sorted({0, *(capacity // k for k in (8, 5, 4, 3, 2, 1))})]
    return min(plans, key=lambda p: sum(times for _, times in p))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns by best fit, largest lengths first: a piece goes to the fullest sequence that has room, equal sequences as one."""
    open_: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(pattern: list[int], times: int, room: int) -> None:
        open_[room].append((pattern, times))
        filled[room] = True

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            rooms = np.flatnonzero(filled[length:])
            if len(rooms):
                room = length + int(rooms[0])
                pattern, times = open_[room].pop()
                filled[room] = bool(open_[room])
                used = min(n, times)
                if times > used:
                    put(pattern, times - used, room)
                put([*pattern, length], used, room - length)
                n -= used
            else:
                each = min(n, capacity // length)
                put([length] * each, n // each, capacity - length * each)
                n %= each
    return [found for classes in open_ for found in classes]


def _plan(counts: dict[int, int], capacity: int, least: int) -> list[tuple[list[int], int]]:
    """Exact fills of lengths above ``least``, as often as the counts allow, then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[list[int], int]] = []

    def use(pattern: list[int]) -> None:
        sizes, uses = np.unique(pattern, return_counts=True)
        times = int((left[sizes] // uses).min())
        left[sizes] -= uses * times
        out.append((pattern, times))

    def pair(total: int, most: int) -> list[int] | None:
        """Two available lengths of this sum, the larger one as large as may be and at most ``most``."""
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        fits = (left[high] > 0) & (left[total - high] > (high * 2 == total))
        return [int(high[fits.argmax()]), total - int(high[fits.argmax()])] if fits.any() else None

    def complement(gap: int, most: int) -> list[int] | None:
        if gap <= most and left[gap]:
            return [gap]
        if found := pair(gap, most):
            return found
        for first in range(min(most, gap - 2), (gap - 1) // 3, -1):
            if left[first]:
                left[first] -= 1
                found = pair(gap - first, first)
                left[first] += 1
                if found:
                    return [first, *found]
        return None

    for length in range(capacity, least, -1):
        while left[length]:
            if length == capacity:
                use([length])
                continue
            left[length] -= 1
            found = complement(capacity - length, length)
            left[length] += 1
            if not found:
                break
            use([length, *found])
    return out + best_fit({int(length): int(left[length]) for length in np.flatnonzero(left)}, capacity)


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Sorted runs of ranks: ranks from ``rank`` on of ``length`` go to sequences from ``sequence`` on, at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            rank = taken.get(size, 0)
            rows.append((size, rank, sequence, offset))
            taken[size] = rank + times
            offset += size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add ``rank`` of each piece among those of its length, from 0."""
    slots = max(16, -(-max(counts.values(), default=0) // SLOT_ROWS))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)))
    sizes = dealt.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "slot").orderBy(*order)
    return (dealt.withColumn("inside", F.row_number().over(inside) - 1)
            .join(offsets, ["length", "slot"])
            .withColumn("rank", F.col("first") + F.col("inside")).drop("slot", "first", "inside"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Place every piece: the columns of ``pieces`` with sequence_id and offset."""
    rows = store(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = places(plan(counts, capacity))
    key = found["length"] << 44 | found["rank"] if len(found["length"]) else found["length"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found["sequence"][at] + rank - found["rank"][at]), pa.array(found["offset"][at])],
                [*kept.schema.names, "sequence_id", "offset"])

    made = ranked(rows, counts).select(*rows.columns, "rank")
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return made.mapInArrow(place, schema)
