"""Log level rules (word ranks, ``<n>`` priority, substrings) as Catalyst
column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _severity_map() -> Column:
    pairs = []
    for k, v in K.SEVERITY_LEVELS.items():
        pairs += [F.lit(int(k)), F.lit(v)]
    return F.create_map(*pairs)


def _rank_words(pattern: str) -> list[str]:
    """The alternatives of a rank's word pattern, lower case."""
    return pattern.split("(", 1)[1].split(")", 1)[0].lower().split("|")


def level_from_words(text: Column) -> Column:
    """the first ranked word pattern found anywhere in the text, else NULL.

    A rank's pattern is only run when the lower-cased text contains one of its
    words (a cheap byte search that every match implies)."""
    low = F.lower(text)
    expr = None
    for level, pattern in K.LEVEL_WORD_RANKS:
        guard = None
        for w in _rank_words(pattern):
            c = low.contains(w)
            guard = c if guard is None else (guard | c)
        cond = guard & text.rlike("(?i)" + pattern)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr


def level_from_priority(text: Column) -> Column:
    """``<n>`` anywhere, n mod 8 -> level (5 gives NOTICE here), else NULL.

    n mod 8 only depends on the last three digits (1000 is a multiple of 8),
    so arbitrarily long numbers stay exact without a wide cast.
    """
    digits = F.when(text.contains("<"), F.regexp_extract(text, K.PRIORITY_RE, 1)).otherwise("")
    tail = F.substring(F.concat(F.lit("00"), digits), -3, 3).cast("int")
    return F.when(digits != "", _severity_map()[F.pmod(tail, F.lit(8))])


def level_from_substrings(text: Column) -> Column:
    """F8: keyword contained in the upper-cased text, else NULL."""
    up = F.upper(text)
    expr = None
    for level, words in K.LEVEL_SUBSTRINGS:
        cond = None
        for w in words:
            c = up.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr


def extract_level(text: Column, default: str = K.DEFAULT_LEVEL) -> Column:
    """F6 -> F7 -> F8 -> default, the first rule that gives a level wins."""
    return F.coalesce(level_from_words(text), level_from_priority(text),
                      level_from_substrings(text), F.lit(default))
