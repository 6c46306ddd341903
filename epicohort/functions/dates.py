"""Date arithmetic of the study: event time, month labels, ages, quarters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_date(d: dt.date | str) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def month_number(d: Column) -> Column:
    """Absolute month count year*12 + month - 1."""
    return F.year(d) * 12 + F.month(d) - 1


def months_since(d: Column, origin: dt.date) -> Column:
    """Whole months from the origin month to the month of d (origin month = 0)."""
    return month_number(d) - (origin.year * 12 + origin.month - 1)


def event_time(ref: Column, event: Column, floor: bool = True, neg_to_zero: bool = False) -> Column:
    """L3: months_between(ref, event) + 1, floored; non-positive values kept or set to 0.

    With ``ref`` and ``event`` both month ends (the panel case) the result is
    whole: event month = 1, month before = 0."""
    diff = F.months_between(ref, event) + F.lit(1)
    if floor:
        diff = F.floor(diff)
    return F.when(diff > 0, diff).otherwise(F.lit(0) if neg_to_zero else diff)


def month_label(ref: Column) -> Column:
    """L4: unpadded 'yyyy-M' label."""
    return F.concat_ws("-", F.year(ref).cast("string"), F.month(ref).cast("string"))


def label_to_month(label: Column) -> Column:
    """'yyyy-M' label -> first day of that month."""
    return F.to_date(F.concat(label, F.lit("-01")), "yyyy-M-dd")


def age_on(day: Column, dob: Column) -> Column:
    """Completed years on ``day``; one less while the birthday (MM-dd) is not reached."""
    return (F.year(day) - F.year(dob)
            - F.when(F.date_format(day, "MM-dd") < F.date_format(dob, "MM-dd"), 1).otherwise(0))


_QUARTER_MONTH = {1: "02-15", 2: "05-15", 3: "08-15", 4: "11-15"}


def dob_from_quarter(q: Column, form: str = "Q") -> Column:
    """Provisional birth date on the 15th of the quarter's middle month.

    ``form='Q'``: 'yyyy-Qn' (a 'Qn' anywhere picks the quarter);
    ``form='0n'``: 'yyyy-0n' (characters 6-7).  Anything else -> NULL."""
    expr = None
    for n, md in _QUARTER_MONTH.items():
        cond = q.contains(f"Q{n}") if form == "Q" else (F.substring(q, 6, 2) == F.lit(f"0{n}"))
        val = F.concat(F.substring(q, 1, 5), F.lit(md))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return F.try_to_date(expr, "yyyy-MM-dd")


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    """Date from numeric year/month/day columns (doubles allowed); invalid -> NULL."""
    return F.try_make_timestamp(y.cast("int"), m.cast("int"), d.cast("int"),
                                F.lit(0), F.lit(0), F.lit(0)).cast("date")


def month_ends(start: dt.date, end: dt.date) -> Column:
    """L1: ARRAY of the last day of every month from start's month up to the
    month before end's month (2014-04-01..2023-01-01 -> 105 month ends)."""
    first = dt.date(start.year, start.month, 1)
    last_idx = end.year * 12 + end.month - 2
    last = dt.date(last_idx // 12, last_idx % 12 + 1, 1)
    return F.transform(
        F.sequence(lit_date(first), lit_date(last), F.expr("INTERVAL 1 MONTH")),
        lambda m: F.last_day(m),
    )


def month_of_number(idx: Column) -> Column:
    """Inverse of ``month_number``: first day of the month."""
    return F.make_date(F.floor(idx / 12).cast("int"),
                       (idx % 12 + 1).cast("int"), F.lit(1))


def calendar_month_num(ref: Column, origin: dt.date) -> Column:
    """1-based month index from the origin month."""
    return months_since(ref, origin) + F.lit(1)


def ceil_div(x: Column, k: int) -> Column:
    return F.ceil(x / F.lit(float(k)))
