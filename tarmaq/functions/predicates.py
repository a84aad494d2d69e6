"""Filters that are put together from optional parts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.functions.scalars import moment, plus_minutes

def all_of(*conditions: Column | None) -> Column:
    """AND of the given conditions; absent ones (None) do not restrict."""
    present = [c for c in conditions if c is not None]
    return reduce(and_, present) if present else F.lit(True)


def equals(column: Column | str, value) -> Column | None:
    """``column = value``, or no condition when the value is not given."""
    if value is None or value == "":
        return None
    return (F.col(column) if isinstance(column, str) else column) == F.lit(value)


def on_day(ts: str, day: str | None) -> Column | None:
    """The timestamp falls on the day: a range, so it reaches the file scan."""
    if not day:
        return None
    start = moment(f"{day} 00:00:00")
    return (F.col(ts) >= start) & (F.col(ts) < plus_minutes(start, 24 * 60))


def in_tuples(df: DataFrame, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose column tuple is in the list.

    The list is a table of the columns' own types, whatever its length: a value
    that cannot be one of the column's is an error, and NULL matches nothing.
    """
    kinds = [df.schema[c].dataType for c in columns]
    typed = [tuple(None if v is None else str(v) for v in row) for row in tuples]
    texts = ", ".join(f"`{c}` string" for c in columns)
    wanted = df.sparkSession.createDataFrame(typed, texts).select(
        *[F.col(c).cast(kind).alias(c) for c, kind in zip(columns, kinds)]).distinct()
    return df.join(wanted, columns, "left_semi")


def owned_by(guest: str, member: str, email: str) -> Column:
    """Either owner column holds the e-mail; exactly one of the two is set."""
    return F.coalesce(F.col(guest), F.col(member)) == F.lit(email)
