"""Wide numbered slot columns (24 procedure codes, 20 diagnoses, ...).

The reference writes 24-way OR and CASE ladders.  Here each family becomes
one ARRAY inside the expression and higher-order functions do the work, so
the generated code stays small and no row leaves the JVM.

A family is the name of one array column of any length, in slot order, or the
names of its numbered columns (the wide tables' form).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(codes) -> list:
    return sorted(codes) if isinstance(codes, (set, frozenset, dict)) else list(codes)


def family(cols: str | Sequence[str]) -> Column:
    """The ARRAY of a slot family."""
    return F.col(cols) if isinstance(cols, str) else F.array(*[F.col(c) for c in cols])


def any_slot_in(cols: str | Sequence[str], codes) -> Column:
    """1 when any slot holds a listed code, else 0 (NULL slots never match)."""
    hit = F.exists(family(cols), lambda x: x.isin(_codes(codes)))
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def slot_in(slot: str | Column, codes) -> Column:
    """1 when the one slot holds a listed code; NULL -> 0."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.when(slot.isin(_codes(codes)), 1).otherwise(0)


def first_slot(cols: str | Sequence[str]) -> Column:
    """The first slot of a family (NULL where it has none)."""
    return F.get(family(cols), 0)


def secondary_only(cols: str | Sequence[str], codes) -> Column:
    """First slot not listed AND a later slot listed; a NULL first slot gives 0
    (``NOT (NULL IN list)`` is NULL, as in SQL)."""
    slots = family(cols)
    later = F.exists(F.slice(slots, 2, F.greatest(F.size(slots), F.lit(0))), lambda x: x.isin(_codes(codes)))
    return F.when(~first_slot(cols).isin(_codes(codes)) & later, 1).otherwise(0)


def slot_structs(code_cols: str | Sequence[str], value_cols: str | Sequence[str] | None = None) -> Column:
    """ARRAY<STRUCT<slot, code, value>> in slot order."""
    values = family(value_cols) if value_cols else None
    return F.transform(family(code_cols), lambda c, i: F.struct(
        (i + 1).alias("slot"), c.alias("code"), (F.lit(None) if values is None else F.get(values, i)).alias("value")))


def first_match(code_cols: str | Sequence[str], codes, value_cols: str | Sequence[str] | None = None) -> Column:
    """P4 + P5: STRUCT(slot, code, value) of the first slot whose code is listed,
    NULL when none is (``get`` gives NULL where ANSI ``element_at`` would raise)."""
    hits = F.filter(slot_structs(code_cols, value_cols), lambda s: s["code"].isin(_codes(codes)))
    return F.get(hits, 0)


def slots_long(df, key_cols: Sequence[str], code_cols: str | Sequence[str],
               value_cols: str | Sequence[str] | None = None):
    """Wide slots -> one row per filled slot (key..., slot, code, value)."""
    return (df.select(*key_cols, F.inline(slot_structs(code_cols, value_cols)))
              .where(F.col("code").isNotNull()))
