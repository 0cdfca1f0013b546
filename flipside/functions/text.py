"""Native (JVM-side) text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the word pattern used for tokens, cue counts and set overlap.
TOKEN_PATTERN = "[a-z']+"


def clean_text(c: Column) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased ``[a-z']+`` tokens of the whole text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def once(value: Column, body) -> Column:
    """``body`` of a value that it names several times and that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def listed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds an array column that is worked out once a row, though an ``explode`` of it follows. Added by ``withColumn``, it would
    be worked out again for the filter on empty arrays that the optimizer puts before the ``explode``."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize`` for lower-case words: first letter upper."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two binary bag-of-word vectors given as distinct-token arrays."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    denom = F.sqrt(F.size(a).cast("double") * F.size(b).cast("double"))
    return F.when(denom > 0, inter / denom).otherwise(F.lit(0.0))


def whitespace_words(c: Column) -> Column:
    """Python ``str.split()``: whitespace-separated words, no empties."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 0)
