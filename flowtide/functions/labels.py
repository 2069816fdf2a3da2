"""Label clean-up and class lookups as plain column expressions.

The dimension tables have 15 and 7 fixed rows, so they are folded into the plan as
map literals: no join, no broadcast, no extra stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtide.functions.values import strip
from flowtide.schema import CLASS_NAMES, LABEL_CLASSES, SEVERITY


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def sanitize_label(label: Column) -> Column:
    """Replacement character, en dash and em dash become ``-``; then trim."""
    return strip(F.translate(label, "\ufffd\u2013\u2014", "---"))


def profile_label(label: Column) -> Column:
    """Sanitised label for reports: an empty or missing label is ``UNKNOWN``."""
    clean = sanitize_label(label)
    return F.when(label.isNull() | (label == ""), F.lit("UNKNOWN")).otherwise(clean)


def label_category(label: Column) -> Column:
    """One of the seven classes; anything unlisted is benign."""
    return F.coalesce(F.try_element_at(literal_map(LABEL_CLASSES), sanitize_label(label)), F.lit(CLASS_NAMES[0]))


def category_index(category: Column) -> Column:
    table = literal_map({name: i for i, name in enumerate(CLASS_NAMES)})
    return F.coalesce(F.try_element_at(table, category), F.lit(0))


def category_name(index: Column) -> Column:
    table = literal_map(dict(enumerate(CLASS_NAMES)))
    return F.coalesce(F.try_element_at(table, index.cast("int")), F.lit("UNKNOWN"))


def severity_rank(category: Column) -> Column:
    """0 is the most severe class."""
    table = literal_map({name: i for i, name in enumerate(SEVERITY)})
    return F.coalesce(F.try_element_at(table, category), F.lit(len(SEVERITY) - 1))


def severity_category(rank: Column) -> Column:
    table = literal_map(dict(enumerate(SEVERITY)))
    return F.coalesce(F.try_element_at(table, rank.cast("int")), F.lit(CLASS_NAMES[0]))
