"""Quality rules: a threshold table compiled into column expressions, without user functions.

``measured`` adds the counts that the rules look at: words, code points in words, symbols, lines, repeated
lines, words in repeated runs of three words, and stop words. ``judged`` compiles a table of rules, each a
measure with the least and the most it may be, into one projection: the names of the rules that a text
fails, and whether it is kept. Every row is judged by itself, so nothing is shuffled.

Null texts count as empty; without words every share is 0, and the word count fails them. Repeated rows and null ids
keep a row each, an empty table gives an empty result, texts of any length are read whole. Columns of the
input are kept, but for those that have the name of a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import WORD

SYMBOLS = "#*$%&|<>"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
RUN = 3
#: Function words of English, German, French and Spanish, lower case.
STOP_WORDS = tuple(dict.fromkeys("""
the of and to in a is that it for was on are with as at be by this from or an have not you his her they we which their were had
der die das und in ist ein eine zu mit von den auf für im nicht sich auch dem des sie er wird bei oder aus nach noch wie
le la les de un une et des est que en du qui dans pour pas au sur par ce il elle ne se plus avec son sont ou aux cette
el los las del y es por con para no lo su al como más pero sus sin sobre este entre cuando muy también hasta
""".split()))
ENDS = ".,;:!?\"'()"


@dataclass(frozen=True)
class Rule:
    """A text passes if ``measure`` is at least ``least`` and at most ``most``; None is no bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The two rules that every text must pass, whatever else is asked for.
BASE = (Rule("words", "n_words", least=50), Rule("repeated runs", "repeat_share", most=0.5))
TABLE = (
    Rule("word length", "word_length", least=2, most=12),
    Rule("symbols", "symbol_share", most=0.2),
    Rule("stop words", "stop_share", least=0.06),
    Rule("repeated lines", "dup_line_share", most=0.5),
    Rule("words in a line", "line_words", least=1.5),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
SHARES = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "stop_share": ("n_stop_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"),
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


_hash = F.xxhash64


def _run(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + k) for k in range(RUN)]


def _ordered(words: Column) -> Column:
    """(hash, at) of every run of RUN words, equal hashes next to each other."""
    places = F.when(F.size(words) >= RUN, F.sequence(F.lit(0), F.size(words) - RUN)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, lambda at: F.struct(_hash(*_run(words, at)).alias("hash"), at.alias("at"))))


def _same_as_next(words: Column, ordered: Column) -> Column:
    """Of every entry whether the next one is the same run; null if only their hashes are."""
    def same(a: Column, b: Column) -> Column:
        equal = [x == y for x, y in zip(_run(words, a["at"]), _run(words, b["at"]), strict=True)]
        return F.when(F.coalesce(a["hash"] != b["hash"], F.lit(True)), F.lit(False)).when(equal[0] & equal[1] & equal[2], F.lit(True))

    return F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), same)


def _exact_places(words: Column) -> Column:
    """Places of repeated runs, ordered by the words themselves: for a text in which two different runs have one hash."""
    places = F.sequence(F.lit(0), F.size(words) - RUN)
    ordered = F.sort_array(F.transform(places, lambda at: F.struct(F.struct(*_run(words, at)).alias("run"), at.alias("at"))))
    same = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.coalesce(a["run"] == b["run"], F.lit(False)))
    return _repeated_places(ordered, same)


def _repeated_places(ordered: Column, same: Column) -> Column:
    """Places, ascending, of the runs that equal their neighbour in the ordered list."""
    after = F.zip_with(ordered, same, lambda x, s: F.struct(x["at"].alias("at"), s.alias("same")))
    both = F.zip_with(after, F.concat(F.array(F.lit(False)), same), lambda x, s: F.when(x["same"] | s, x["at"]))
    return F.sort_array(F.array_compact(both))


def _covered(places: Column) -> Column:
    """How many words the runs at these places cover together."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(RUN), F.coalesce(b - a, F.lit(RUN))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def measured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with MEASURES and SHARES of their whole texts.

    Each projection names what the next one uses more than once, so nothing is computed twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(c) for c in documents.columns]).alias("row")
    split = documents.select(row, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
                             F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    counts = split.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACE_CHARACTERS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.btrim(F.lower(w), F.lit(ENDS)).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        "words",
        _ordered(F.col("words")).alias("ordered"),
    )
    kept = [c for c in MEASURES if c != "n_repeat_words"]
    marked = counts.select("row", *kept, "words", "ordered", _same_as_next(F.col("words"), F.col("ordered")).alias("same"))
    unsure = F.exists("same", lambda s: s.isNull())
    places = F.when(unsure, _exact_places(F.col("words"))).otherwise(_repeated_places(F.col("ordered"), F.col("same")))
    placed = marked.select("row", *kept, places.alias("places"))
    done = placed.select("row", *kept, _covered(F.col("places")).alias("n_repeat_words"))
    shares = [F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(0.0).alias(name) for name, (above, below) in SHARES.items()]
    own = [F.col("row")[c].alias(c) for c in documents.columns if c not in {*MEASURES, *SHARES}]
    return done.select("*", *shares).select(*own, *MEASURES, *SHARES)


def failed(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a measured text fails, in the order of the table."""
    tests = []
    for rule in rules:
        bounds = [F.col(rule.measure) < rule.least] if rule.least is not None else []
        bounds += [F.col(rule.measure) > rule.most] if rule.most is not None else []
        for bound in bounds:
            tests.append(F.when(bound, F.lit(rule.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def judged(documents: DataFrame, table: Sequence[Rule] = TABLE, text_col: str = "text") -> DataFrame:
    """The documents with their measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    rules = (*BASE, *table)
    unknown = {r.measure for r in rules} - {*MEASURES, *SHARES}
    if unknown:
        raise ValueError(f"no such measure: {sorted(unknown)}")
    own = documents.drop("base_failed", "failed_rules", "kept")
    fails = measured(own if text_col in own.columns else documents, text_col)
    return fails.withColumns({"base_failed": F.size(failed(BASE)) > 0, "failed_rules": failed(rules), "kept": F.size(failed(rules)) == 0})
