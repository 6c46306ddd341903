"""Dense numbers, row numbers and look-ups that split hot keys.

A number over all rows needs no global window: the rows are put in order by a
range partitioning, each partition counts its own, and a running sum over
those counts (one row for each partition) gives every partition its offset.
Ties are split like any other rows, so a key that holds a third of the table
spreads over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicohort.sources.io import stash

#: Keys that hold more than this part of all rows are looked up in a broadcast
#: table: there can never be more such keys than that.
HOT_KEYS = 4_096
#: ``monotonically_increasing_id`` keeps the partition above this bit.
_ID_BITS = 33


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``.

    Rows under a NULL key find nothing.  Keys with more than 1 / ``HOT_KEYS`` of
    the rows, at most ``HOT_KEYS`` of them whatever the input, are answered from a
    broadcast of their table rows, so no task has to take all rows of a hot key;
    all others meet in a shuffle.  ``rows`` is read three times: pass a stored
    table."""
    if how not in ("left", "inner"):
        raise ValueError(f"how is 'left' or 'inner', not {how!r}")
    limit = rows.count() / HOT_KEYS
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = stash(counts.where(F.col("_n") > F.lit(limit)).select(key), "hot")
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi")
    hot_table = stash(table.join(F.broadcast(hot), key, "left_semi"), "hot_rows")
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    out = hot_rows.join(F.broadcast(hot_table), key, how).unionByName(rest.join(table, key, how))
    new = [c for c in table.columns if c != key]
    return out.select(*rows.columns, *new)


def global_order(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` stored with ``out``: each row's place (from 0, gapless) in the given
    order; rows that tie keep one arbitrary order that does not change any more."""
    tie, mark = free_name(df, "_tie"), free_name(df, "_mark")
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
    placed = stash(ranged.withColumn(mark, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col(mark), _ID_BITS).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition of the range exchange
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col(mark) - F.shiftleft(F.shiftright(F.col(mark), _ID_BITS), _ID_BITS)
    joined = placed.withColumn("_part", F.shiftright(F.col(mark), _ID_BITS)).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, (F.col("_offset") + inside).cast("long")).drop("_part", "_offset", mark)


def number_within(df: DataFrame, key: str, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with ``out``: each row's number (from 0) among the rows of its
    ``key``, in the given order.  No group is gathered in one task; rows under a
    NULL key are a group too."""
    at = free_name(df, "_at")
    placed = stash(global_order(df, [F.col(key).asc_nulls_first(), *order], at), "placed")
    starts = placed.groupBy(key).agg(F.min(at).alias("_start"))
    null_start = F.lit(0)  # nulls come first of all
    numbered = lookup_join(placed, starts.where(F.col(key).isNotNull()), key)
    number = F.col(at) - F.when(F.col(key).isNull(), null_start).otherwise(F.col("_start"))
    return numbered.withColumn(out, number.cast("long")).drop("_start", at)


def dense_id(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """``df`` with a dense number of ``key``: 1, 2, ... in the order of the
    keys, without gaps, the same for equal keys.  NULL keys come last, with a
    number of their own."""
    rows = stash(df, "rows")
    keys = rows.select(key).distinct()
    numbers = global_order(keys, [F.col(key).asc_nulls_last()], out).withColumn(out, F.col(out) + 1)
    numbers = stash(numbers, "numbers")
    found = lookup_join(rows, numbers.where(F.col(key).isNotNull()), key)
    of_null = numbers.where(F.col(key).isNull()).select(F.col(out).alias("_of_null"))  # one row at most
    found = found.join(F.broadcast(of_null), F.col(key).isNull(), "left")
    return found.withColumn(out, F.coalesce(out, "_of_null")).drop("_of_null")
