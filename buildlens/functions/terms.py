"""Issue keys and search terms taken from test names and failure texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.text import blank_to_null, normalise_blank, null_to_blank


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(null_to_blank(c), F.lit(pattern), F.lit(0))


def http_codes(message: Column, details: Column) -> Column:
    """4xx and 5xx codes of the message, then of the details."""
    return F.concat(_all(message, V.HTTP_CODE), _all(details, V.HTTP_CODE))


def issue_key(c: Column) -> Column:
    """First issue key in the text, '' if there is none."""
    return F.regexp_extract(null_to_blank(c), V.ISSUE_KEY, 1)


def without_issue_keys(c: Column) -> Column:
    return F.regexp_replace(null_to_blank(c), V.ISSUE_KEY, "")


def direct_key(ticket: Column, name: Column) -> Column:
    """Explicit ticket, else the first key in the name."""
    return F.coalesce(blank_to_null(ticket), issue_key(name))


def upper_ids(name: Column, message: Column) -> Column:
    """Upper-case identifiers of the name, then of the start of the message.

    Stop words are lower-case, so none of these is one.
    """
    start = F.left(null_to_blank(message), F.lit(V.UPPER_SCAN_CHARS))
    return F.concat(_all(name, V.UPPER_ID), _all(start, V.UPPER_ID))


def plain_words(name: Column) -> Column:
    """Lower-case words of the name, longer than three letters, without stop words."""
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS if len(w) > 3])
    return F.filter(_all(F.lower(name), V.LOWER_WORD), lambda w: ~F.array_contains(stop, w))


def first_distinct(words: Column, limit: int) -> Column:
    """First ``limit`` words, ignoring repeats in another case; the first spelling stays."""

    def add(kept: Column, word: Column) -> Column:
        seen = F.exists(kept, lambda k: F.lower(k) == F.lower(word))
        return F.when((F.size(kept) >= limit) | seen, kept).otherwise(F.array_append(kept, word))

    return F.aggregate(words, F.array().cast("array<string>"), add)


def _hint_words(hint: Column, limit: int) -> Column:
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.slice(F.filter(_all(hint, V.HINT_WORD), lambda w: ~F.array_contains(stop, F.lower(w))), 1, limit)


def search_terms(
    name: Column,
    message: Column,
    details: Column,
    hint: Column | None = None,
    n_terms: int = V.SEARCH_TERMS,
) -> Column:
    """Up to 2 * n_terms terms: the hint's words if given, else codes, identifiers, words."""
    limit = 2 * n_terms
    bare = without_issue_keys(name)
    # Within one kind, repeats are exact. Of the plain words, as many as there
    # are identifiers may turn out repeats in another case, so twice as many stay.
    found = F.concat(
        F.slice(F.array_distinct(http_codes(message, details)), 1, limit),
        F.slice(F.array_distinct(upper_ids(bare, message)), 1, limit),
        F.slice(F.array_distinct(plain_words(bare)), 1, 2 * limit),
    )
    automatic = first_distinct(found, limit)
    if hint is None:
        return automatic
    hint = normalise_blank(hint)
    return F.when(hint != "", _hint_words(hint, limit)).otherwise(automatic)


def search_text(terms: Column, projects: Sequence[str] = (), n_terms: int = V.SEARCH_TERMS) -> Column:
    """Search text over the top terms; blank without terms."""
    top = F.slice(terms, 1, n_terms)
    either = F.array_join(F.transform(top, lambda t: F.concat(F.lit('text ~ "'), t, F.lit('"'))), " OR ")
    scope = f"project in ({', '.join(projects)}) AND " if projects else ""
    return F.when(
        F.size(top) > 0, F.concat(F.lit(scope + "("), either, F.lit(") ORDER BY updated DESC"))
    ).otherwise("")


def ticket_tokens(text: Column) -> Column:
    """Distinct lower-case word tokens of a ticket's text."""
    return F.array_distinct(_all(F.lower(text), rf"[{V.WORD}]+"))
