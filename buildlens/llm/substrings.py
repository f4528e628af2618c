"""Repeated passages, by suffix automata of reference shards.

A word is removed if a window of WINDOW consecutive words over it also starts earlier, in a
document of smaller id or earlier in the same document. Documents of equal id and equal text
are one document; of equal id and other text, the order is by a hash.

Of its windows, a document's anchors are the k-mers of least hash, one for each run of windows
that agree on it; equal windows have equal anchors. Anchors that occur once are dropped. A
run of windows on a repeated anchor is a segment, and all segments on an anchor go to the same
reference shard. An equal segment is wholly removed but for its first occurrence, by grouping.
Where an anchor has different segments, which overlap in part, the shard builds a suffix automaton of
their first occurrences, each state knowing its earliest place, and streams the segments
through it: matching statistics of WINDOW words and more, whose earliest place is another one,
mark windows to remove. Shards are cut at SHARD_WORDS words, at anchors; a shard goes to the task
that has its anchors rather than to all tasks, as all of a corpus has no size to broadcast.

An anchor with more than HOT_SEGMENTS different segments (a common short phrase) would be too
large for one shard: its windows are grouped by their own hash instead, with the same result.

Null texts have no words. Every row of the input gives one row. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import SPACES, drop_stored, hashed_words, small, store, windows

WINDOW = 20
K = 8
SHARD_WORDS = 60_000
HOT_SEGMENTS = 5_000
BROADCAST_BYTES = 48 << 20
_WORDS = re.compile(b"[^" + bytes(SPACES) + b"]+")


def runs(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one text: its anchors' places, hashes, and the first window of each; a run ends where the next begins."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = windows(words, k)
    place = np.arange(len(words) - window + 1) + sliding_window_view(grams, window - k + 1).argmin(1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], grams[place[first]], first


def _per_text(column) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, words, firsts, *_ in hashed_words(column):
        for i in range(first, last):
            yield i, words[firsts[i - first] : firsts[i - first + 1]]


def _anchors(window: int, k: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, hashes, places = [], [], []
            for i, words in _per_text(batch.column(2)):
                place, h, _ = runs(words, window, k)
                rows.append(np.full(len(place), i))
                hashes.append(h)
                places.append(place)
            at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                              pa.array(np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.int64)),
                                              pa.array(np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32))], ["doc_id", "key", "h", "place"])

    return anchors


def _segments(window: int, k: int):
    """(doc_id, key, h, seg, start, n): n windows from word ``start`` on, on a repeated anchor; seg is their hash."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple] = []
            for i, words in _per_text(batch.column(2)):
                wanted = np.asarray(batch.column(3)[i].values)
                place, h, first = runs(words, window, k)
                total = len(words) - window + 1
                for r in np.flatnonzero(np.isin(place, wanted)).tolist():
                    start = int(first[r])
                    end = int(first[r + 1]) if r + 1 < len(first) else total
                    part = words[start : end + window - 1]
                    seg = int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True)
                    out.append((i, int(h[r].astype(np.int64)), seg, start, end - start))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], ["doc_id", "key", "h", "seg", "start", "n"])

    return segments


def _contents(window: int):
    """(doc_id, key, h, seg, start, words): the segments listed for each document, their words as 32-bit hashes."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple] = []
            for i, words in _per_text(batch.column(2)):
                short = words.astype(np.uint32)
                for s in batch.column(3)[i].as_py():
                    out.append((i, s["h"], s["seg"], s["start"], short[s["start"] : s["start"] + s["n"] + window - 1].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["doc_id", "key", "h", "seg", "start", "words"])

    return contents


class Automaton:
    """Suffix automaton of several word sequences; every state knows the least place value of its occurrences' ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def add(self, words: list[int], place: int) -> None:
        """``place`` is the value of the first word; the others follow."""
        last = 0
        for end, word in enumerate(words, place):
            last = self._extend(last, word, end)

    def _extend(self, last: int, word: int, end: int) -> int:
        nexts, link, length, least = self.next, self.link, self.length, self.least
        there = nexts[last].get(word)
        if there is not None and length[there] == length[last] + 1:
            least[there] = min(least[there], end)
            return there
        new = there
        if there is None:
            new = self._state({}, length[last] + 1, end)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p < 0:
                link[new] = 0
                return new
            there = nexts[p][word]
            if length[there] == length[p] + 1:
                link[new] = there
                return new
        else:
            p = last
        copy = self._state(dict(nexts[there]), length[p] + 1, 1 << 62)
        link[copy] = link[there]
        link[there] = copy
        while p >= 0 and nexts[p].get(word) == there:
            nexts[p][word] = copy
            p = link[p]
        if new == there:
            least[copy] = end
            return copy
        link[new] = copy
        return new

    def _state(self, nexts: dict[int, int], length: int, least: int) -> int:
        self.next.append(nexts)
        self.link.append(-1)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def settle(self) -> None:
        """Tell every state the places of the longer ones that end alike."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])

    def earliest(self, words: list[int], window: int) -> Iterator[tuple[int, int]]:
        """Stream a sequence: for each of its windows found here, the index of its first word and its least end."""
        state, matched = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                    matched = self.length[state]
                yield i - window + 1, self.least[state]


def _shards(window: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor to windows (doc_id, key, start) that occur earlier in another segment."""
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["h"] != last and size > SHARD_WORDS:
                    yield _found(held, window, batch.schema)
                    held, size = [], 0
                last = row["h"]
                held.append(row)
                size += len(row["words"]) // 4
        if held:
            yield _found(held, window, batch.schema)

    return shards


def _found(held: list[dict], window: int, schema: pa.Schema) -> pa.RecordBatch:
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["key"]) for r in held})
    rank = {k: i for i, k in enumerate(order)}
    automaton = Automaton()
    parts = []
    for r in held:
        words = np.frombuffer(r["words"], np.uint32).tolist()
        place = (rank[r["doc_id"] is not None, r["doc_id"] or 0, r["key"]] << 36) + r["start"]
        parts.append((r, words, place))
        automaton.add(words, place)
    automaton.settle()
    out = [(r["doc_id"], r["key"], r["start"] + t) for r, words, place in parts for t, end in automaton.earliest(words, window) if end < place + t + window - 1]
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], schema.field("doc_id").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                                      ["doc_id", "key", "start"])


def _single(window: int):
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of segments to one row for each window, with its hash."""
        for batch in batches:
            out = []
            for i, (start, raw) in enumerate(zip(batch.column("start").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                out += [(i, start + t, int.from_bytes(hashlib.blake2b(raw[4 * t : 4 * (t + window)], digest_size=8).digest(), "little", signed=True))
                        for t in range(len(raw) // 4 - window + 1)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())],
                                             ["doc_id", "key", "start", "w"])

    return single


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of each document, with those that overlap or touch made one."""
    for batch in small(batches):
        lists = batch.column(2)
        starts, ends, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
        for i in range(batch.num_rows):
            values = lists[i].values
            start, reach = np.asarray(values.field("start")), np.maximum.accumulate(np.asarray(values.field("end")))
            first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
            starts.append(start[first])
            ends.append(reach[np.concatenate((first[1:], [len(start)])) - 1])
            sizes.append(len(first))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans)], ["doc_id", "key", "spans"])


def _beside(docs: DataFrame, lists: DataFrame, size: int, how: str) -> DataFrame:
    """Documents with what is listed for them: the lists are broadcast where they were measured to be small."""
    side = F.broadcast(lists) if size <= BROADCAST_BYTES else lists
    return docs.join(side.withColumnRenamed("doc_id", "own_id").withColumnRenamed("key", "own_key"),
                     F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), how).drop("own_id", "own_key")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, key, spans) of the documents with words to remove: spans are disjoint (start, end) in words, end exclusive;
    key is the hash of id and text."""
    k = min(K, window)
    keyed = _keyed(docs, id_col, text_col)
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, key long"
    anchors = keyed.mapInArrow(_anchors(window, k), f"{kind}, h long, place int")
    again = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("n > 1")
    lists = store(again.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")))
    size = lists.agg(F.coalesce(F.sum(F.size("places") * 4 + 40), F.lit(0))).first()[0]
    found = _beside(keyed, lists, size, "inner").mapInArrow(_segments(window, k), f"{kind}, h long, seg long, start int, n int")
    # rank: rows of one id and text are one document, and none of them is an earlier one
    by_seg = Window.partitionBy("seg").orderBy(F.col("doc_id").asc_nulls_first(), "key", "start")
    segments = store(found.withColumn("nth", F.rank().over(by_seg)))
    drop_stored(lists)

    whole = segments.filter("nth > 1").select("doc_id", "key", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    firsts = segments.filter("nth = 1").drop("nth")
    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("segs")).filter("segs > 1")
    asked = store(firsts.join(several, "h").groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "seg", "start", "n", "segs")).alias("asked")))
    size = asked.agg(F.coalesce(F.sum(F.size("asked") * 40 + 40), F.lit(0))).first()[0]
    hot = F.transform(F.filter("asked", lambda s: s["segs"] > HOT_SEGMENTS), lambda s: s)
    cold = F.filter("asked", lambda s: s["segs"] <= HOT_SEGMENTS)
    read = f"{kind}, h long, seg long, start int, words binary"
    beside = _beside(keyed, asked, size, "inner")
    shared = beside.withColumn("asked", cold).filter(F.size("asked") > 0).mapInArrow(_contents(window), read)
    marked = shared.repartition("h").sortWithinPartitions("h", "seg").mapInArrow(_shards(window), f"{kind}, start int")
    common = beside.withColumn("asked", hot).filter(F.size("asked") > 0).mapInArrow(_contents(window), read)
    by_window = Window.partitionBy("w").orderBy(F.col("doc_id").asc_nulls_first(), "key", "start")
    marked_common = common.mapInArrow(_single(window), f"{kind}, start int, w long").withColumn("nth", F.rank().over(by_window)).filter("nth > 1")
    partly = marked.unionByName(marked_common.select("doc_id", "key", "start")).select("doc_id", "key", "start", (F.col("start") + window).alias("end"))
    spans = whole.unionByName(partly).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return store(spans.mapInArrow(_merged, f"{kind}, spans array<struct<start:int,end:int>>"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def _mask(batch: pa.RecordBatch, i: int, words: list[bytes]) -> np.ndarray:
    gone = np.zeros(len(words) + 1, np.int64)
    for s in batch.column(3)[i].as_py() or ():
        gone[s["start"]] += 1
        gone[s["end"]] -= 1
    return np.cumsum(gone[:-1]) > 0


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, and kept, the words left joined by one space."""
    spans = repeated(docs, id_col, text_col, window)
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 8 + 40), F.lit(0))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for i, text in enumerate(batch.column(2)):
                words = _WORDS.findall(text.as_buffer()) if text.is_valid else []
                if batch.column(3)[i].is_valid:
                    gone = _mask(batch, i, words)
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                rows.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = _beside(_keyed(docs, id_col, text_col), spans, size, "left").select("doc_id", "key", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
