"""Six dimensions of a session record's worth, and their weighted sum."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.times import age_days, parsed

# Fixed values of the scoring scheme.
WEIGHTS = {"recency": 0.2, "frequency": 0.2, "relevance": 0.2, "completeness": 0.15, "clarity": 0.15, "actionability": 0.1}
RELEVANCE_WORDS = ["task", "goal", "result", "decision", "conclusion"]
ACTION_WORDS = ["should", "must", "will", "decided", "action", "next step", "todo"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _share(text: Column, words: list[str]) -> Column:
    """Share of the words that occur in the text as substrings."""
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(w.lower())).cast("int") for w in words])
    return F.least(F.lit(1.0), hits / F.lit(float(len(words))))


def recency(ts: Column, as_of: Column) -> Column:
    """1 up to a day of age (or in the future), falling to 0.5 at 7 days and 0.1 at 30; 0.5 if missing or unreadable."""
    d = age_days(parsed(ts), as_of)
    return (
        F.when(d.isNull(), 0.5).when(d <= 1, 1.0).when(d <= 7, 0.5 + 0.5 * (7 - d) / 6)
        .when(d <= 30, 0.1 + 0.4 * (30 - d) / 23).otherwise(0.1)
    )


def frequency(access_count: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(access_count, F.lit(1)) / F.lit(10.0))


def relevance(content: Column, summary: Column, words: list[str] = RELEVANCE_WORDS) -> Column:
    """content and summary are joined without a separator, so a word may match across the joint."""
    return _share(F.lower(F.concat(_text(content), _text(summary))), words)


def completeness(session_id: Column, ts: Column, content: Column) -> Column:
    return reduce(lambda a, b: a + b, [(_text(c) != "").cast("int") for c in (session_id, ts, content)]) / F.lit(3.0)


def clarity(content: Column) -> Column:
    n = F.length(_text(content))
    return F.when(n < 100, n / F.lit(100.0)).when(n <= 1000, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (n - 1000) / F.lit(9000.0)))


def actionability(content: Column, words: list[str] = ACTION_WORDS) -> Column:
    return _share(F.lower(_text(content)), words)


def dimensions(as_of: Column) -> dict[str, Column]:
    """The six dimensions of a table with the columns of a session record."""
    session_id, ts, content, summary, access_count = (F.col(c) for c in ("session_id", "ts", "content", "summary", "access_count"))
    return {
        "recency": recency(ts, as_of), "frequency": frequency(access_count), "relevance": relevance(content, summary),
        "completeness": completeness(session_id, ts, content), "clarity": clarity(content), "actionability": actionability(content),
    }


def score(as_of: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted sum, in the order of the weights, kept within 0 and 1 and rounded to 6 digits; thresholds apply to the rounded value."""
    d = dimensions(as_of)
    total = reduce(lambda a, b: a + b, [d[k] * F.lit(w) for k, w in weights.items()])
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)
