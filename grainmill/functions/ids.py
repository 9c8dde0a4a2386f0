"""Ids, references and canonical values as columns."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_id(c: Column) -> Column:
    """Keep letters, digits and underscore of an id; one of which nothing is left stays as an empty string.

    Most ids are clean, which taking away all that may stay tells much faster than a pattern does.
    """
    return F.when(F.translate(c, ascii_letters + digits + "_", "") == "", c).otherwise(F.regexp_replace(c, "[^A-Za-z0-9_]", ""))


def clean_id(c: Column) -> Column:
    """As sanitize_id, but an id of which nothing is left counts as not supplied (null)."""
    return F.nullif(sanitize_id(c), F.lit(""))


def parent_ids(c: Column) -> Column:
    """The cleaned ids of a raw front-matter list, in its order; brackets, quotes and blanks vanish with the cleaning."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), clean_id), lambda x: x.isNotNull())


def normalise_parents(c: Column) -> Column:
    """Comma list with blank entries dropped and the rest cleaned (an entry may clean to nothing and then stays empty)."""
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(kept, sanitize_id), ",")


def canonical_json(c: Column) -> Column:
    """A JSON text with sorted keys and no spacing; text that isn't JSON is kept as it is, marked as raw."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.concat(F.lit("raw:"), c))


def row_digest(*cols: Column) -> Column:
    """128 bits over named values; null, '' and values that moved to another column all differ."""
    return F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cols)])))
