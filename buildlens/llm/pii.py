"""Personal data by weak-supervision aggregation, in DataFrame functions alone.

Patterns give candidate spans. Four labelers (shape, gazetteer, context, grouping) vote on
each: 1 for, -1 against, 0 no opinion. Only the counts of vote patterns, at most 3^4 for each
kind, come to the driver, where expectation-maximisation estimates each labeler's
reliability and a logistic span classifier is fitted to the posteriors. The classifier is
applied as one column expression.

The four base kinds are kept exactly as their patterns and checks find them. The classifier
decides on the added kinds (spelled-out addresses, national phone numbers, social security
numbers), of which a span is kept if it overlaps no base span.

Null texts are empty; every row of the input gives one row, repeated rows and null ids
included. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import store

BASE = ("email", "ip", "card", "phone")
ADDED = ("address_spelled", "phone_national", "ssn")
KINDS = BASE + ADDED
LABELERS = ("shape", "gazetteer", "context", "grouping")
CONTEXT_CHARS = 48
KEEP_FROM = 0.5

# Possessive repeats and looks behind keep each scan linear: a match can only begin where a run
# of its characters begins, or (mail) where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address_spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}"
                       r"(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[a-z0-9-]{1,63}){1,4}",
    "phone_national": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![.-]?[0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![.-]?[0-9])",
}
#: A text without a match of this has no match of the kind's pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]",
         "address_spelled": r"(?i)[\[(]\x20?at\x20?[\])]", "phone_national": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": r"-[0-9]{2}-"}
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
CUES = {
    "email": r"mail|contact|write to|@", "ip": r"\bip\b|address|host|server|login", "card": r"card|visa|account|pay",
    "phone": r"call|phone|tel|mobile|fax|contact", "address_spelled": r"mail|contact|write to",
    "phone_national": r"call|phone|tel|mobile|fax|contact", "ssn": r"ssn|social security|tax",
}
AGAINST = r"version|release|isbn|license|order no|part no|§"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """The digits from the right, every second one doubled, sum up to a multiple of ten."""
    d = F.reverse(digits(match))
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda s, i: s + _weighed(d.substr(i + 1, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _weighed(digit: Column, i: Column) -> Column:
    twice = digit * 2
    return F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)


def passes(kind: str, match: Column) -> Column:
    """The check of a base kind on a match of its pattern; an added kind has none."""
    n = F.char_length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(match)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v if no is None else v.when(no, -1)).otherwise(0)


def votes(kind: str, match: Column, before: Column) -> list[Column]:
    """One vote of each labeler on a candidate, given the text in front of it."""
    near = F.lower(before)
    context = _vote(near.rlike(CUES[kind]), near.rlike(AGAINST))
    d = digits(match)
    if kind in ("email", "address_spelled"):
        last = F.lower(F.regexp_extract(match, r"([A-Za-z0-9]+)$", 1))
        shape = _vote(last.rlike("^[a-z]{2,24}$"), ~last.rlike("^[a-z]{2,24}$"))
        known = _vote(last.isin(*DOMAINS))
        group = _vote(~match.rlike(r"\.\.|^\.|-\."), match.rlike(r"\.\.|^\."))
    elif kind == "ip":
        shape = _vote(passes("ip", match), ~passes("ip", match))
        known = _vote(~match.rlike(r"^(?:0|255)\."), match.rlike(r"^(?:0+\.)"))
        group = _vote(~match.rlike(r"(?:^|\.)0[0-9]"), match.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        shape = _vote(passes("card", match), ~passes("card", match))
        known = _vote(d.rlike("^[3-6]"), d.rlike("^[0189]"))
        group = _vote(match.rlike(r"^[0-9]{16,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"))
    elif kind == "phone":
        shape = _vote(passes("phone", match), ~passes("phone", match))
        known = _vote(d.rlike("^(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"))
        group = _vote(match.rlike(r"[0-9]{3}"), ~match.rlike(r"[0-9]{2}"))
    elif kind == "phone_national":
        shape = _vote(d.rlike("^[2-9][0-9]{2}[2-9]"), ~d.rlike("^[2-9][0-9]{2}[2-9]"))
        known = _vote(match.rlike(r"^\([0-9]{3}\)"))
        group = _vote(match.rlike(r"^\([0-9]{3}\) |^([0-9]{3})([ .-])[0-9]{3}\2[0-9]{4}$"), match.rlike(r"^\([0-9]{3}[^)]|^[0-9]{3}\)"))
    else:
        shape = _vote(~d.rlike("^(?:000|666|9)|^...00|0000$"), d.rlike("^(?:000|666|9)|^...00|0000$"))
        known = _vote(d.rlike("^(?:000|666|9)"), F.lit(False))
        group = _vote(F.lit(True))
    return [shape, known, context, group]


def matches(kind: str, text: Column) -> tuple[Column, Column]:
    """The texts between the matches of a kind, and the matches: both null where there can be none."""
    there = text.rlike(NEEDS[kind])
    return F.when(there, F.split(text, PATTERNS[kind], -1)), F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match of any kind, or one without a kind where a document has none:
    row (numbers the input rows), doc_id, kind, at (which match of its kind), gap (code points since the match before), match, before."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        *[c.alias(f"{part}_{kind}") for kind in KINDS for part, c in zip(("gaps", "hits"), matches(kind, text), strict=True)])
    kind_of = "array<struct<kind:string,at:int,gap:int,match:string,before:string>>"

    def of(kind: str) -> Column:
        gaps, hits = F.col(f"gaps_{kind}"), F.col(f"hits_{kind}")
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("match"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before")))
        rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["match"].alias("match"), x["before"].alias("before")))
        return F.coalesce(rows.cast(kind_of), F.array().cast(kind_of))

    return found.select("row", "doc_id", F.explode_outer(F.concat(*[of(k) for k in KINDS])).alias("c")).select("row", "doc_id", "c.*")


def _by_kind(make) -> Column:
    out = None
    for kind in KINDS:
        out = F.when(F.col("kind") == kind, make(kind)) if out is None else out.when(F.col("kind") == kind, make(kind))
    return out


def with_votes(cands: DataFrame) -> DataFrame:
    """Add ``passes`` and a vote column for each labeler."""
    cast = _by_kind(lambda k: F.array(*votes(k, F.col("match"), F.col("before"))))
    return (cands.withColumn("passes", F.coalesce(_by_kind(lambda k: passes(k, F.col("match"))), F.lit(False)))
            .withColumn("cast", cast)
            .select("*", *[F.col("cast")[i].alias(n) for i, n in enumerate(LABELERS)]).drop("cast"))


def reliabilities(counts: list[tuple], rounds: int = 60) -> tuple[dict[str, float], list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (kind, votes..., n): the share of true spans by kind, and for each
    labeler how likely each vote is on a true and on a false span. Starts from the majority of votes."""
    post = [1 / (1 + math.exp(-2.0 * sum(row[1:5]))) for row in counts]
    prior: dict[str, float] = {}
    tables: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        for kind in {row[0] for row in counts}:
            own = [(p, row[5]) for p, row in zip(post, counts, strict=True) if row[0] == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        tables = []
        for j in range(len(LABELERS)):
            sums = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for p, row in zip(post, counts, strict=True):
                sums[row[1 + j]][0] += p * row[5]
                sums[row[1 + j]][1] += (1 - p) * row[5]
            total = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            tables.append({v: (s[0] / total[0], s[1] / total[1]) for v, s in sums.items()})
        post = [_posterior(prior, tables, row) for row in counts]
    return prior, tables


def _posterior(prior: dict[str, float], tables: list[dict[int, tuple[float, float]]], row: tuple) -> float:
    logit = math.log(prior[row[0]] / (1 - prior[row[0]]))
    for j, t in enumerate(tables):
        true, false = t[row[1 + j]]
        logit += math.log(true / false)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


def train(cands: DataFrame, steps: int = 400) -> dict[str, float]:
    """Weights of the span classifier: ``bias``, each kind, and each labeler's for and against."""
    names = ["kind", *LABELERS]
    counts = [tuple(r) for r in cands.filter(F.col("kind").isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    weights = {"bias": 0.0, **{k: 0.0 for k in KINDS}, **{f"{n}{s}": 0.0 for n in LABELERS for s in "+-"}}
    if not counts:
        return weights
    prior, tables = reliabilities(counts)
    rows = []
    for row in counts:
        on = ["bias", row[0], *[f"{n}{'+' if v > 0 else '-'}" for n, v in zip(LABELERS, row[1:5], strict=True) if v]]
        rows.append((on, _posterior(prior, tables, row), math.log1p(row[5])))
    size = sum(r[2] for r in rows)
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0)
        for on, target, n in rows:
            p = 1 / (1 + math.exp(-sum(weights[f] for f in on)))
            for f in on:
                slope[f] += n * (target - p) / size
        for f in weights:
            weights[f] += 2.0 * slope[f] - 0.002 * weights[f]
    return weights


def probability(weights: dict[str, float], kind: Column, cast: list[Column]) -> Column:
    z = F.lit(weights["bias"])
    for k in KINDS:
        z = z + F.when(kind == k, weights[k]).otherwise(0.0)
    for name, vote in zip(LABELERS, cast, strict=True):
        z = z + F.when(vote > 0, weights[f"{name}+"]).when(vote < 0, weights[f"{name}-"]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, its base spans and added spans as arrays of (kind, start, end), in
    code points with the end exclusive, sorted by kind as listed in KINDS and start."""
    cands = store(with_votes(candidates(docs, id_col, text_col)))
    weights = train(cands)
    by_row = Window.partitionBy("row")
    size = F.char_length("match")
    placed = (cands.repartition("row")
              .withColumn("end", F.sum(F.col("gap") + size).over(Window.partitionBy("row", "kind").orderBy("at")))
              .withColumn("start", F.col("end") - size)
              .withColumn("base", F.col("kind").isin(*BASE) & F.col("passes"))
              .withColumn("p", probability(weights, F.col("kind"), [F.col(n) for n in LABELERS])))
    ahead = by_row.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = by_row.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(ahead), F.lit(0))
    next_at = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after), F.lit(2**31 - 1))
    extra = F.col("kind").isin(*ADDED) & (F.col("p") >= KEEP_FROM) & (reach <= F.col("start")) & (next_at >= F.col("end"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct(rank.alias("rank"), F.col("start"), F.col("end"), F.col("kind"))
    kept = placed.withColumn("extra", extra)
    gathered = kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base_spans"),
                                                 F.sort_array(F.collect_list(F.when(F.col("extra"), one))).alias("added_spans"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return gathered.select("doc_id", plain("base_spans").alias("base_spans"), plain("added_spans").alias("added_spans"))


def shown(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(shown(F.col("base_spans")), 256).alias("base_sha256"),
                        shown(F.concat("base_spans", "added_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every kept span replaced by its kind in angle brackets.

    Kinds go one after the other over the text that the earlier ones left, so of overlapping spans the
    earlier kind's counts. A null text stays null.
    """
    weights = train(store(with_votes(candidates(docs, id_col, text_col))))
    for kind in KINDS:
        gaps, hits = matches(kind, F.col(text_col))
        pieces = F.zip_with(gaps, hits, _replace(kind, weights))
        docs = docs.withColumn(text_col, F.coalesce(F.array_join(pieces, ""), F.col(text_col)))
    return docs


def _replace(kind: str, weights: dict[str, float]):
    def piece(gap: Column, match: Column) -> Column:
        if kind in BASE:
            keep = passes(kind, match)
        else:
            keep = probability(weights, F.lit(kind), votes(kind, match, F.right(gap, F.lit(CONTEXT_CHARS)))) >= KEEP_FROM
        return F.concat(gap, F.when(match.isNull(), "").when(keep, f"<{kind.upper()}>").otherwise(match))

    return piece
