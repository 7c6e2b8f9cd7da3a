"""String operations with pandas semantics, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_text(s: Column, start: int, end: int) -> Column:
    """Characters start to end - 1, counted from 0."""
    return F.substring(s, start + 1, max(end - start, 0))


def contains(s: Column, pattern: str) -> Column:
    """Whether the regular expression is found anywhere."""
    return s.rlike(pattern)


def lower(s: Column) -> Column:
    return F.lower(s)


def same(s: Column, text: str) -> Column:
    return s == F.lit(text)


def is_title(s: Column) -> Column:
    """Every run of letters starts with a capital and goes on without one, and there is a run."""
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"(^|\P{L})\p{Ll}|\p{L}\p{Lu}")


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def join(tokens: Column, by: str = " ") -> Column:
    return F.array_join(tokens, by)


def tokens(s: Column) -> Column:
    """Words, numbers and single punctuation marks; "..." is one mark."""
    return F.regexp_extract_all(s, F.lit(r"(\.\.\.|[\p{L}\p{M}\p{N}_'-]+|[^\s\p{L}\p{M}\p{N}_'-])"), F.lit(1))


def without_space(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"^\s*$"))


# The tokens after which a sentence begins.
STOPS = (".", "!", "?", "...")


def sentence_begins(words: Column) -> Column:
    """For each token whether a sentence begins with it: the first, and from the third on one that follows a stop."""
    return F.transform(words, lambda w, i: (i == 0) | ((i >= 2) & F.coalesce(F.get(words, i - 1).isin(*STOPS), F.lit(False))))
