"""Column expressions shared by the operators; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmaq import params as P

PHONE_PATTERN = "^[0-9-]+$"
STAFF_ID_PATTERN = "^[0-9]{9}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -----------------------------------------------------------------

def moment(value: str) -> Column:
    """A literal wall-clock instant, e.g. an ``as_of``."""
    return F.to_timestamp_ntz(F.lit(value))


def takeoff(date: Column | str, time: Column | str) -> Column:
    return F.to_timestamp_ntz(F.concat_ws(" ", _col(date), _col(time)))


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    amount = F.lit(minutes) if isinstance(minutes, int) else minutes
    return _col(ts) + F.make_dt_interval(mins=amount.cast("int"))


def plus_hours(ts: Column | str, hours: int) -> Column:
    return plus_minutes(ts, hours * 60)


def month_start(ts: Column | str) -> Column:
    """First day of the month: a cheap grouping key, made readable afterwards."""
    return F.trunc(F.to_date(_col(ts)), "MM")


def month_text(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyy-MM")


def day_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def clock_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def moment_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def parse_day(text: Column | str) -> Column:
    """ISO date, or NULL when the text is not one."""
    value = F.trim(_col(text))
    return F.when(value.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(value, "yyyy-M-d"))


def day_in_range(day: Column, as_of: Column) -> Column:
    """True when the day lies in 1900-01-01 .. as_of; NULL days fail."""
    earliest = F.lit(P.EARLIEST_DATE).cast("date")
    return F.coalesce(day.between(earliest, as_of.cast("date")), F.lit(False))


# --- numbers --------------------------------------------------------------

def money(c: Column | str) -> Column:
    return _col(c).cast("decimal(18,2)")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded half up; NULL when there is no whole."""
    exact = (part * 100).cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0))
    return F.round(exact, digits)


def hours_of(minutes: Column) -> Column:
    return F.round(minutes.cast("decimal(20,0)") / F.lit(60).cast("decimal(4,0)"), 2)


def flag(condition: Column) -> Column:
    """A predicate as 0/1."""
    return condition.cast("int")


# --- text -----------------------------------------------------------------

def route_label(origin: Column | str, destination: Column | str) -> Column:
    return F.concat(_col(origin), F.lit(" → "), _col(destination))


def route_path(origin: Column | str, destination: Column | str) -> Column:
    return F.concat_ws(" -> ", _col(origin), _col(destination))


def clean_email(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def clean_code(c: Column | str) -> Column:
    return F.upper(F.trim(_col(c)))


def clean_phone(c: Column | str) -> Column:
    return F.replace(F.trim(F.coalesce(_col(c), F.lit(""))), F.lit(" "), F.lit(""))


def is_phone(c: Column | str) -> Column:
    return clean_phone(c).rlike(PHONE_PATTERN)


def is_staff_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(STAFF_ID_PATTERN), F.lit(False))


def is_positive_int(c: Column | str) -> Column:
    return F.coalesce(F.trim(_col(c)).try_cast("int") > 0, F.lit(False))


def name_parts(full: Column | str) -> Column:
    """Array of the tokens of a full name."""
    return F.split(F.trim(_col(full)), "\\s+")


def first_name(full: Column | str) -> Column:
    return F.element_at(name_parts(full), 1)


def last_name(full: Column | str) -> Column:
    parts = name_parts(full)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ")


# --- seats ----------------------------------------------------------------

def seat_code(row: Column | str, column: Column | str) -> Column:
    return F.concat_ws("-", _col(row), _col(column))


def seat_row(code: Column | str) -> Column:
    return F.split(_col(code), "-").getItem(0).cast("int")


def seat_column(code: Column | str) -> Column:
    return F.split(_col(code), "-").getItem(1).cast("int")


def seat_label(row: Column | str, column: Column | str) -> Column:
    """Row and letter for columns 1..26, ``row-column`` beyond."""
    r, c = _col(row), _col(column)
    lettered = F.concat(r.cast("string"), F.char(c.cast("int") + 64))
    return F.when(c.between(1, 26), lettered).otherwise(seat_code(r, c))


def seat_list(row: Column | str, column: Column | str) -> Column:
    """Aggregate: the distinct seats of a group as one text, by row then column.

    The set is folded map-side and can hold no more than the seats of one plane.
    """
    seats = F.sort_array(F.collect_set(F.struct(_col(row).alias("r"), _col(column).alias("c"))))
    return F.array_join(F.transform(seats, lambda s: seat_label(s["r"], s["c"])), ", ")


def class_rank(c: Column | str, ranks: dict[str, int] = P.CLASS_RANK) -> Column:
    """Declared order of the cabin classes; unknown classes come last."""
    rank = F.lit(len(ranks) + 1)
    for name, position in reversed(ranks.items()):
        rank = F.when(_col(c) == name, position).otherwise(rank)
    return rank
