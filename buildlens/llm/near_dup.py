"""Near-duplicate documents by Order MinHash.

A text is the sequence of its overlapping k-mers of K words, each labelled with how often it
occurred before in the text. For each of SKETCHES hash functions the two labelled k-mers of
least hash are kept in their text order; texts that share such a sketch are candidates.
Block moves break sketches, so they follow edit similarity and not only common k-mers.

Candidates are verified by banded alignment of the k-mers without their labels, so that one more copy
of a repeated line costs no more than itself: the longest chain of common k-mers that runs forward in
both texts, within the band that the similarity allows. Of a text with n and one with m k-mers whose
chain has L, the similarity is L / (n + m - L); links have SIMILARITY or more. Equal texts are one class
and are compared once.

No group's pairs are all made. Every text of a sketch is compared with the sketch's least text, its
hub, and a text that fails with the hub's nearest. Texts that are then in the hub's component, by links
of this sketch or others, need no comparison among themselves. The rest are compared, block by block,
with one another and with the texts of the hub's component, as long as they are in different components.
The words' distance n + m - 2 L is a metric, so by their distances from the hub most pairs are known to
be too far apart. So a sketch of similar texts costs one comparison for each text, however many there are.

A text of fewer than K words is one k-mer of its words. Null is an empty text; texts without
words are copies of one another. Repeated rows and null ids keep a row each. An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import drop_stored, hashed_words, mix, small, store, windows
from buildlens.llm.graph import components

K = 5
SIMILARITY = 0.8
SKETCHES = 12
#: Similarities below this are not computed exactly; by the triangle inequality such a text shares no link with a
#: partner of the text it is compared with.
GREY = 0.5
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TOP = np.uint64(2**64 - 1)


def plain_kmers(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive texts, whose first words have the indexes ``firsts`` (one more at the end): hashes of the k-mers in
    order, and how many each text has."""
    sizes = np.diff(firsts)
    counts = np.where(sizes >= K, sizes - K + 1, (sizes > 0).astype(np.int64))
    whole = windows(words, K)
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = firsts[:-1][owner] + np.arange(begins[-1]) - begins[owner]
    kmers = whole[np.minimum(at, len(whole) - 1)] if len(whole) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((sizes > 0) & (sizes < K)):
        kmers[begins[i]] = windows(words[firsts[i] : firsts[i + 1]], int(sizes[i]))[0]
    return kmers, counts


def labelled_kmers(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with every k-mer labelled by how often it occurred before in its text."""
    kmers, counts = plain_kmers(words, firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    own = mix(kmers + mix(owner.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    run = np.flatnonzero(fresh)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.concatenate((run, [len(order)]))))
    return mix(kmers + nth * np.uint64(0x9E6C63D0876A9A47)), counts


def sketches(kmers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of SKETCHES hashes for each text; a text without k-mers has constant ones."""
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begins = np.cumsum(n) - n
    spot = np.arange(len(kmers))
    for j, seed in enumerate(_SEEDS):
        h = mix(kmers ^ seed)
        least = np.minimum.reduceat(h, begins)
        first = np.minimum.reduceat(np.where(h == np.repeat(least, n), spot, len(kmers)), begins)
        h[first] = _TOP
        least = np.minimum.reduceat(h, begins)
        second = np.minimum.reduceat(np.where(h == np.repeat(least, n), spot, len(kmers)), begins)
        a, b = kmers[np.minimum(first, second)], kmers[np.maximum(first, second)]
        out[some, j] = mix(mix(a + np.uint64(j)) * np.uint64(3) + b)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = np.zeros((batch.num_rows, SKETCHES), np.uint64)
        total = np.zeros(batch.num_rows, np.int64)
        for first, last, words, firsts, *_ in hashed_words(batch.column(2)):
            kmers, counts = labelled_kmers(words, firsts)
            rows[first:last] = sketches(kmers, counts)
            total[first:last] = counts
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.astype(np.int64).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), lists], ["doc_id", "key", "size", "sketches"])


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found: list[bytes] = [b""] * batch.num_rows
        for first, _, words, firsts, *_ in hashed_words(batch.column(1)):
            kmers, counts = plain_kmers(words, firsts)
            short = kmers.astype(np.uint32)
            for i, part in enumerate(np.split(short, np.cumsum(counts)[:-1])):
                found[first + i] = part.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "kmers"])


def _by_pairs(at_a: np.ndarray, at_b: np.ndarray) -> int:
    """Longest chain of matching places, given as pairs."""
    chain = at_b[np.lexsort((-at_b, at_a))]
    if len(chain) < 2 or (np.diff(chain) > 0).all():
        return len(chain)
    tails: list[int] = []
    for x in chain.tolist():
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence by bit rows, BITS columns of ``b`` at a time; carries go on from block to block."""
    row = a.tolist()
    carry = bytearray(len(row))
    common = 0
    for begin in range(0, len(b), BITS):
        part = b[begin : begin + BITS].tolist()
        masks: dict[int, int] = {}
        for i, x in enumerate(part):
            masks[x] = masks.get(x, 0) | 1 << i
        full = (1 << len(part)) - 1
        v = full
        for i, x in enumerate(row):
            m = masks.get(x, 0)
            if m or carry[i]:
                total = v + (v & m) + carry[i]
                carry[i] = total >> len(part)
                v = (total & full) | (v & ~m)
        common += len(part) - v.bit_count()
    return common


BITS = 8192
PAIRS = 8


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest chain of common k-mers running forward in both. Places further apart than the band may be left out
    of it: no chain that the band is made for has such.

    What both begin or end with is part of a longest chain. Of the rest, the pairs of equal k-mers are made where they are
    few for the length; texts that repeat themselves are aligned by bit rows.
    """
    least = min(len(a), len(b))
    differs = np.flatnonzero(a[:least] != b[:least])
    begin = int(differs[0]) if len(differs) else least
    a, b = a[begin:], b[begin:]
    least -= begin
    differs = np.flatnonzero(a[len(a) - least :] != b[len(b) - least :])
    end = least - 1 - int(differs[-1]) if len(differs) else least
    a, b = a[: len(a) - end], b[: len(b) - end]
    at_a, at_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    if not len(at_a):
        return begin + end
    order = np.argsort(b[at_b], kind="stable")
    ranked = b[at_b][order]
    low, high = np.searchsorted(ranked, a[at_a], "left"), np.searchsorted(ranked, a[at_a], "right")
    times = high - low
    total = int(times.sum())
    if total > PAIRS * (len(a) + len(b)):
        return begin + end + _by_bits(a[at_a], b[at_b])
    of_b = at_b[order][np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    of_a = np.repeat(at_a, times)
    near = np.abs(of_a - of_b) <= band
    return begin + end + _by_pairs(of_a[near], of_b[near])


def ranked(kmers: np.ndarray) -> np.ndarray:
    """The k-mers in order of their hash, equal ones told apart by a number."""
    order = np.sort(kmers).astype(np.uint64)
    run = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), order[1:] != order[:-1])))
    nth = np.arange(len(order)) - np.repeat(run, np.diff(np.concatenate((run, [len(order)]))))
    return order << np.uint64(32) | nth.astype(np.uint64)


def most_similar(a: np.ndarray, b: np.ndarray) -> float:
    """What the similarity of two texts, of which ``ranked`` k-mers are given, cannot exceed, in whatever order they come."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return common / (len(a) + len(b) - common)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two k-mer sequences; exact from ``least`` on, else another value below that."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    if (most := most_similar(ranked(a), ranked(b))) < least:
        return most
    common = aligned(a, b, int((n + m) * (1 - least) / (1 + least)) + 1)
    return common / (n + m - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [similarity(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), GREY)
                  for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["a", "b", "s"])


def _compare(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """(a, b, s) for pairs of nodes (a, b)."""
    of_a = orders.select(F.col("node").alias("a"), F.col("kmers").alias("kmers_a"))
    of_b = orders.select(F.col("node").alias("b"), F.col("kmers").alias("kmers_b"))
    rows = pairs.select("a", "b").distinct().join(of_a, "a").join(of_b, "b").select("a", "b", "kmers_a", "kmers_b")
    return store(rows.mapInArrow(_verify, "a long, b long, s double"))


def _rest(least: float):
    def rest(key: tuple, group: pa.Table) -> pa.Table:
        """Links that join components among a block of a sketch's texts, or between two blocks of them.
        A pair that shares several sketches is compared at the first of them."""
        bucket, same = key[0].as_py(), key[1] == key[2]
        node, block = group.column("node").to_pylist(), np.asarray(group.column("block"))
        shown = np.asarray(group.column("sketches").combine_chunks().flatten()).reshape(len(node), -1)
        kmers = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("kmers")]
        bags = [ranked(x) for x in kmers]
        size = np.array([len(x) for x in kmers])
        low, high = np.asarray(group.column("low")), np.asarray(group.column("high"))
        most = (1 - least) / (1 + least)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        comp = group.column("component").to_pylist()
        degree = np.zeros(len(node), np.int64)
        partners: list[set[int]] = [set() for _ in node]
        links = []
        for i in np.flatnonzero(block == key[2].as_py()).tolist():
            other = np.arange(i) if same else np.flatnonzero(block == key[1].as_py())
            shared = shown[other] == shown[i]
            first = shown[i][shared.argmax(1)]
            fits = (first == bucket) & shared.any(1) & (np.minimum(size[other], size[i]) >= least * np.maximum(size[other], size[i]))
            slack = (size[other] + size[i]) * most + 2
            other = other[fits & (low[other] <= high[i] + slack) & (low[i] <= high[other] + slack)]
            far: set[int] = set()
            for j in other[np.argsort(-degree[other], kind="stable")].tolist():
                if j in far or root(comp[i]) == root(comp[j]):
                    continue
                s = most_similar(bags[j], bags[i])
                if s >= least:
                    s = similarity(kmers[j], kmers[i], GREY)
                if s >= least:
                    links.append((node[j], node[i]))
                    parent[root(comp[i])] = root(comp[j])
                    degree[[i, j]] += 1
                    partners[i].add(j)
                    partners[j].add(i)
                elif s < GREY:
                    far |= partners[j]
        cols = list(zip(*links, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return rest


BLOCK = 400
BROADCAST_NODES = 300_000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of its class) and kept (it is the one row that stands
    for its class: of rows with that id, an arbitrary but fixed one)."""
    return _classes(docs, id_col, text_col, least).drop("key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: one of each."""
    found = store(_classes(docs, id_col, text_col, least))
    kept = found.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    if kept.count() <= BROADCAST_NODES:
        kept = F.broadcast(kept)
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    out = docs.withColumn("_key", key).join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    if not found.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "_key"])
    return out.select(*docs.columns)


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = store(keyed.mapInArrow(_sketch, f"doc_id {kind}, key binary, size long, sketches array<long>").withColumn("row", F.monotonically_increasing_id()))
    nodes = store(rows.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("sketches").alias("sketches"), F.first("size").alias("size"), F.min("row").alias("row"))
                  .withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", "size", F.explode("sketches").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .select("bucket", F.col("least.node").alias("hub"), F.col("least.size").alias("hub_size"))
    shared = store(members.join(buckets, "bucket"))
    # of a text's rows, only those of its least id are read again
    wanted = nodes.join(shared.select("node").distinct(), "node").select(F.col("key").alias("_key"), F.col("least_id").alias("_id"), "node")
    if shared.count() // SKETCHES <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    orders = store(keyed.join(wanted, same).select("node", "text").mapInArrow(_order, "node long, kmers binary")
                   .groupBy("node").agg(F.first("kmers").alias("kmers")))

    one = _compare(shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), orders)
    seen = shared.join(one.select(F.col("a").alias("hub"), F.col("b").alias("node"), "s"), ["hub", "node"])
    second = seen.groupBy("bucket").agg(F.max_by("node", F.struct("s", "node")).alias("next"))
    loose = seen.filter(F.col("s") < least).join(second, "bucket").filter("node <> next")
    two = _compare(loose.select(F.col("next").alias("a"), F.col("node").alias("b")).join(one, ["a", "b"], "left_anti"), orders)
    sure = one.unionByName(two).filter(F.col("s") >= least).select("a", "b")
    found = store(components(sure))

    named = store(shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    hubs = named.filter("node = hub").select("bucket", F.col("component").alias("hub_component"))
    # distances from the hub: exact from GREY on, else at least (n + m) / 3
    known = seen.select("bucket", "node", "s", ((F.col("size") + F.col("hub_size")) * (1 - F.col("s")) / (1 + F.col("s"))).alias("d"),
                        ((F.col("size") + F.col("hub_size")) / 3).alias("far")) \
        .select("bucket", "node", "s", F.when(F.col("s") >= GREY, F.col("d")).otherwise(F.col("far")).alias("low"),
                F.when(F.col("s") >= GREY, F.col("d")).otherwise(F.lit(float("inf"))).alias("high"))
    placed = named.filter("node <> hub").join(hubs, "bucket").join(known, ["bucket", "node"]).withColumn("apart", F.col("component") != F.col("hub_component"))
    loners = placed.filter("apart").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c"), F.max("component").alias("d"), F.max("s").alias("nearest"))
    asked = store(placed.join(loners, "bucket").filter(F.col("apart") | (F.col("s") < least) | (F.col("nearest") >= GREY))
                  .select("bucket", "node", "component", "low", "high", "apart", "n", "c", "d"))
    joined = asked.filter("NOT apart").groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    left = (asked.join(joined, "bucket", "left").filter("c <> d OR m IS NOT NULL")
            .withColumn("alone", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("beside", F.ceil(F.coalesce("m", F.lit(0)) / BLOCK).cast("int"))
            .join(nodes.select("node", "sketches"), "node").join(orders, "node")
            .withColumn("block", F.when(F.col("apart"), F.pmod(F.xxhash64("node"), F.col("alone"))).otherwise(F.col("alone") + F.pmod(F.xxhash64("node"), F.col("beside"))).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("alone") - 1 + F.when(F.col("apart"), F.col("beside")).otherwise(0))))
            .select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "component", "low", "high", "sketches", "kmers", "block"))
    three = left.groupBy("bucket", "x", "y").applyInArrow(_rest(least), "a long, b long")
    final = components(sure.unionByName(three))

    own = store(nodes.select("key", "node", "least_id", "row").join(final, "node", "left").withColumn("component", F.coalesce("component", "node")))
    leaders = own.groupBy("component").agg(F.min("least_id").alias("class_id"), F.min(F.struct("least_id", "row"))["row"].alias("leader"))
    classes = own.join(leaders, "component").select("key", "class_id", "leader")
    first = rows.groupBy("key", "doc_id").agg(F.min("row").alias("row"))
    lead = first.join(classes, "key").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("key", F.col("row").alias("stands"))
    drop_stored(orders, shared, asked)
    return (rows.join(classes, "key").join(lead.groupBy("key").agg(F.min("stands").alias("stands")), "key", "left")
            .select("doc_id", "key", "class_id", F.coalesce(F.col("row") == F.col("stands"), F.lit(False)).alias("kept")))
