"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and texts. Every word scores by where it stands, positive in
content and negative in menus, adverts and the like; every tag scores negative. One linear
scan finds the contiguous region of the greatest sum. Its words of positive score are the
text, block by block.

Weights are learned from labelled pages: pages with an ``article`` or ``main`` element, whose
words count as content, all others as not, for each tag and each class or id name. Where the
labelled pages say little, common names of page parts (NEGATIVE, POSITIVE) are the prior.
The fit uses at most about FIT_PAGES labelled pages, chosen by hash.

A null page, or one without content, has an empty text; repeated rows and null ids keep a row
each; broken markup is read as far as it goes, and the work grows with the length of a page, however deep its elements are nested
and however many quotes stay open; columns but the three named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 4000
PRIOR_WORDS = 50.0
LEAST_TAG = -0.05
#: A "<" outside quotes ends the search for a tag's quoted values, so that unclosed quotes are not sought to the end of the page from every tag.
TOKEN = re.compile(
    r"(?:<!--|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|title)\b[^>]*>).*?(?:(?(raw)</(?P=raw)\s*>|-->)|(?P<unclosed>\Z))"
    r"""|<(?P<shut>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:<[^>"']*+)?>|<[a-zA-Z/!?][^>]*>""", re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr
ul""".split())
#: Elements that begin where another of them is still open, and so end it.
ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
        "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
CONTAINERS = frozenset("article main nav aside footer header form dialog head button menu fieldset".split())
LABELLED = frozenset(["article", "main"])
NEGATIVE = frozenset("""nav menu navbar navigation header masthead topbar footer sidebar aside notice notices cookie cookies consent banner ad ads
advert advertisement adverts sponsored sponsor promo promotion form newsletter subscribe signup login search comment comments reply replies
discussion disqus respond share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay widget
toolbar dialog head button fieldset copyright legal alert""".split())
POSITIVE = frozenset("article main content post entry story articlebody".split())
GENERIC = {"p": 0.95, "h1": 0.8, "h2": 0.85, "h3": 0.85, "blockquote": 0.95, "pre": 0.9, "td": 0.6, "li": 0.5, "div": 0.7, "body": 0.6}


def signatures(name: str, attrs: str) -> tuple[str, ...]:
    """What weights know an element by: its tag if that names a part of a page, and its class, id and role names."""
    found = [f"<{name}>"] if name in CONTAINERS else []
    if attrs:
        for m in NAMES.finditer(attrs):
            found += [x for x in (m[1] or m[2] or m[3] or "").lower().split()]
    return tuple(found)


@lru_cache(100_000)
def prior(signature: str) -> float:
    """Share of words in content, before any page is seen; 0.5 knows nothing."""
    parts = set(re.split(r"[^a-z]+", signature.lower()))
    return 0.02 if parts & NEGATIVE else 0.98 if parts & POSITIVE else 0.5


class Spot:
    """Where an item stands: what the open elements around it say, told from what the elements around these say.

    ``fresh`` are the signatures that no element further out has. ``labelled`` tells whether an article or main is open, ``inside``
    is the nearest block element, ``content`` whether a labelled page's words here count as content.
    """

    __slots__ = ("parent", "fresh", "inside", "labelled", "header", "bad", "totals")

    def __init__(self, parent: Spot | None, name: str, fresh: tuple[str, ...]):
        self.parent, self.fresh, self.totals = parent, fresh, [0, 0]
        self.inside = name if name in BLOCKS or parent is None else parent.inside
        self.labelled = name in LABELLED or (parent is not None and parent.labelled)
        self.header = "<header>" in fresh or (parent is not None and parent.header)
        self.bad = any(prior(x) < 0.1 for x in fresh if x != "<header>") or (parent is not None and parent.bad)

    @property
    def content(self) -> bool:
        return self.labelled and not self.bad


class Item:
    """A tag, or a text with the block it stands in."""

    __slots__ = ("tag", "text", "spot", "block")

    def __init__(self, tag: str, text: str, spot: int, block: int):
        self.tag, self.text, self.spot, self.block = tag, text, spot, block


def items(page: str) -> tuple[list[Item], list[Spot]]:
    """The page in order, and the spots its items stand in, outer ones before inner ones. A tag costs the same at any depth."""
    out: list[Item] = []
    spots = [Spot(None, "body", ())]
    # open elements: name, fresh signatures, spot, and the place in the stack of the nearest block
    stack: list[tuple[str, tuple[str, ...], int, int]] = []
    names: Counter = Counter()
    around: Counter = Counter()
    at, block, spot = 0, 0, 0

    def say(text: str) -> None:
        if text:
            out.append(Item("", text, spot, block))

    def shut(size: int) -> None:
        while len(stack) > size:
            name, fresh, *_ = stack.pop()
            names[name] -= 1
            for x in fresh:
                around[x] -= 1

    last = page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, last):
        say(page[at : m.start()])
        at = m.end() if m["unclosed"] is None else len(page)
        name = m["name"].lower() if m["name"] else ""
        if not name:
            continue
        if name == "br":
            say(" ")
        out.append(Item(name, "", spot, block))
        if name in BLOCKS:
            block += 1
        if m["shut"]:
            if names[name]:
                while stack[-1][0] != name:
                    shut(len(stack) - 1)
                shut(len(stack) - 1)
        else:
            if stack and name in BLOCKS and (near := stack[-1][3]) >= 0 and name in ENDS.get(stack[near][0], ()):
                shut(near)
            if name not in VOID and not m["attrs"].endswith("/"):
                spot = stack[-1][2] if stack else 0
                fresh = tuple(x for x in dict.fromkeys(signatures(name, m["attrs"])) if not around[x])
                if fresh or name in BLOCKS or name in LABELLED:
                    spots.append(Spot(spots[spot], name, fresh))
                    spot = len(spots) - 1
                near = len(stack) if name in BLOCKS else stack[-1][3] if stack else -1
                stack.append((name, fresh, spot, near))
                names[name] += 1
                around.update(fresh)
        spot = stack[-1][2] if stack else 0
    # behind the last ">" only a comment can begin
    say(page[at:].partition("<!--")[0])
    return out, spots


class Weights:
    """Scores of words by where they stand, and of tags."""

    def __init__(self, counts: dict[str, tuple[float, float]] | None = None):
        self.counts = counts or {}

    def share(self, key: str, before: float) -> float:
        content, other = self.counts.get(key, (0.0, 0.0))
        return (content + PRIOR_WORDS * before) / (content + other + PRIOR_WORDS)

    def _range(self, keys: Iterable[str], low: float, high: float) -> tuple[float, float]:
        """The range of the logits of those keys that say anything, and of what is known before."""
        for key in keys:
            p = self.share(key, prior(key))
            if abs(p - 0.5) > 0.2:
                logit = math.log(p / (1 - p))
                low, high = min(low, logit), max(high, logit)
        return low, high

    def words(self, spots: list[Spot]) -> list[float]:
        """Scores of a word in each spot: the least of the elements around that say anything; else the nearest block's. Inside content,
        a page's header is the article's own, and other parts score nothing instead of breaking the region."""
        ranges: dict[Spot | None, tuple[float, float]] = {None: (math.inf, -math.inf)}
        scores = []
        for spot in spots:
            ranges[spot] = self._range((x for x in spot.fresh if x != "<header>"), *ranges[spot.parent])
            low, high = self._range(["<header>"], *ranges[spot]) if spot.header and not spot.labelled else ranges[spot]
            if low <= high:
                least = max(-3.0, min(3.0, low))
                scores.append(0.0 if least < 0 and (spot.labelled or high > 0) else least / 3)
            else:
                p = self.share(f"in {spot.inside}", GENERIC.get(spot.inside, 0.5))
                scores.append(max(-1.0, min(1.0, math.log(p / (1 - p)) / 3)))
        return scores

    def tag(self, name: str) -> float:
        p = self.share(f"tag {name}", 0.5)
        return max(-1.0, min(LEAST_TAG, math.log(p / (1 - p)) / 3))


def region(scores: list[float]) -> tuple[int, int]:
    """First and last (exclusive) place of the contiguous run of the greatest positive sum; the first of equal ones."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The main text: blocks joined by two line feeds."""
    parts, spots = items(page)
    known = weights.words(spots)
    scores, words = [], []
    for item in parts:
        word = known[item.spot]
        if item.tag:
            words.append(0.0)
            scores.append(weights.tag(item.tag) if word < 0.5 else LEAST_TAG)
            continue
        words.append(word)
        scores.append(word * len(item.text.split()))
    first, last = region(scores)
    blocks: dict[int, list[str]] = {}
    for item, word in zip(parts[first:last], words[first:last], strict=True):
        if not item.tag and word > 0:
            blocks.setdefault(item.block, []).append(item.text)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(t for t in texts if t)


def learn(pages: DataFrame, html_col: str = "html", most: int = FIT_PAGES) -> Weights:
    """Weights from the labelled pages."""
    whole = pages.select(html_col).filter(F.lower(html_col).rlike("<(?:article|main)\\b"))
    share = min(1.0, most / max(1, whole.count()))
    sample = whole.filter(F.pmod(F.xxhash64(html_col), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                parts, spots = items(page.as_py())
                for item in parts:
                    spot = spots[item.spot]
                    if item.tag:
                        seen[f"tag {item.tag}", spot.content] += 1
                    elif n := len(item.text.split()):
                        seen[f"in {spot.inside}", spot.content] += n
                        spot.totals[spot.content] += n
                # words of inner spots are words of the outer ones
                for spot in reversed(spots):
                    for side, n in enumerate(spot.totals):
                        if n:
                            for x in spot.fresh:
                                seen[x, bool(side)] += n
                            if spot.parent:
                                spot.parent.totals[side] += n
        rows = [(k, n if side else 0, 0 if side else n) for (k, side), n in seen.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["key", "content", "other"])

    summed = sample.mapInArrow(count, "key string, content long, other long").groupBy("key").agg(F.sum("content").alias("c"), F.sum("other").alias("o"))
    often = summed.filter(F.col("c") + F.col("o") >= 20).orderBy(F.desc(F.col("c") + F.col("o")), "key").limit(10_000)
    return Weights({r["key"]: (float(r["c"]), float(r["o"])) for r in often.collect()})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = weights or learn(pages, html_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py() or "", weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
