"""Lenient parsing of text cells: null tokens, numbers, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtide.schema import NULL_TOKENS

# Accepted timestamp layouts.
DAY_FIRST_SECONDS = "d/M/yyyy H:m:s"
DAY_FIRST_MINUTES = "d/M/yyyy H:m"
YEAR_FIRST_SECONDS = "yyyy-M-d H:m:s"
YEAR_FIRST_MINUTES = "yyyy-M-d H:m"


# What Python's strip() takes off both ends of a text.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(cell: Column) -> Column:
    """The cell without white space of any kind at its ends."""
    return F.btrim(cell, F.lit(WHITE))


def null_tokens(cell: Column) -> Column:
    """The cell, or null where it holds one of the no-number tokens.

    Must run before any cast: ``Infinity`` and ``NaN`` cast to valid doubles.
    """
    return F.when(~cell.isin(NULL_TOKENS), cell)


def to_number(cell: Column) -> Column:
    return null_tokens(cell).try_cast("double")


def to_whole(cell: Column, kind: str = "bigint") -> Column:
    """Integer field written as a number: the fraction is cut, bad text is null."""
    return to_number(cell).try_cast(kind)


def parse_timestamp(cell: Column) -> Column:
    """Timestamp in any of the four layouts, or null.

    Separator and number of colons decide the only layout that can match, so a cell is
    parsed once; a failed parse costs an exception inside the parser.
    """
    text = strip(cell)
    slashes = F.contains(text, F.lit("/"))
    seconds = F.substring_index(text, ":", 2) != text
    parse = lambda layout: F.try_to_timestamp(text, F.lit(layout))
    return (
        F.when(slashes & seconds, parse(DAY_FIRST_SECONDS))
        .when(slashes, parse(DAY_FIRST_MINUTES))
        .when(seconds, parse(YEAR_FIRST_SECONDS))
        .when(F.contains(text, F.lit("-")), parse(YEAR_FIRST_MINUTES))
    )


def fix_12h_clock(ts: Column) -> Column:
    """Captures taken in working hours write 13-19 as 1-7: move those to the afternoon."""
    return F.when(F.hour(ts).between(1, 7), ts + F.expr("INTERVAL 12 HOURS")).otherwise(ts)


def has_text(cell: Column) -> Column:
    return cell.isNotNull() & (strip(cell) != "")
