"""The edge condition language and citation checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import trim_ws


def eval_condition(condition: Column, audience: Column, read_nodes: Column, labels: Column) -> Column:
    """Truth of a condition in a reader's context; unknown forms hold."""
    cond = trim_ws(F.coalesce(condition, F.lit("")))
    read = F.regexp_extract(cond, r"(?s)^!?has_read\((.*)\)$", 1)
    has_read = F.coalesce(F.array_contains(read_nodes, trim_ws(read)), F.lit(False))
    who = F.lower(F.coalesce(audience, F.lit("")))
    eq = F.lower(trim_ws(F.regexp_extract(cond, r"(?s)^audience[=!]=(.*)$", 1)))
    key = F.regexp_extract(cond, r"(?s)^label\.(.*?)==(.*)$", 1)
    val = F.regexp_extract(cond, r"(?s)^label\.(.*?)==(.*)$", 2)
    return (
        F.when(cond == "", F.lit(True))
        .when(cond.rlike(r"(?s)^has_read\(.*\)$"), has_read)
        .when(cond.rlike(r"(?s)^!has_read\(.*\)$"), ~has_read)
        .when(cond.startswith("audience=="), who == eq)
        .when(cond.startswith("audience!="), who != eq)
        .when(
            cond.rlike(r"(?s)^label\..*==") , F.coalesce(F.try_element_at(labels, key), F.lit("")) == val
        )
        .otherwise(F.lit(True))
    )


def excerpt_diverges(text: Column, start: Column, end: Column, content: Column) -> Column:
    """The stored excerpt is not the cited slice; an out-of-range span is held against the whole text."""
    bad = (start < 0) | (end > F.char_length(content)) | (start > end)
    return F.when(bad, text != content).otherwise(
        F.substring(content, start + 1, F.greatest(end - start, F.lit(0))) != text
    )
