"""Column-set helpers (P24, P25, L14): regex selection, renaming, constants,
and factor reference levels kept as column metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_matching(df: DataFrame, pattern: str, keep: tuple = ()) -> DataFrame:
    """Keep ``keep`` plus every column whose name matches the regex."""
    rx = re.compile(pattern)
    return df.select(*keep, *[c for c in df.columns if rx.search(c) and c not in keep])


def drop_matching(df: DataFrame, substring: str) -> DataFrame:
    """Drop every column whose name contains ``substring``."""
    return df.drop(*[c for c in df.columns if substring in c])


def rename_regex(df: DataFrame, pattern: str, repl: str, prefix: str = "") -> DataFrame:
    """Rename columns starting with ``prefix`` by a regex substitution."""
    rx = re.compile(pattern)
    return df.withColumnsRenamed({c: rx.sub(repl, c) for c in df.columns if c.startswith(prefix) and rx.search(c)})


def with_constants(df: DataFrame, values: dict) -> DataFrame:
    """P25: constant columns (flags, group labels)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def set_reference(df: DataFrame, refs: dict, orders: dict | None = None) -> DataFrame:
    """Record each factor's reference level, and the order of its levels where
    ``orders`` names one, in the column metadata.  Values are unchanged; the metadata
    goes through select, join, rename and stage tables, and ``fe.fit_models`` reads it."""
    out, orders = df, orders or {}
    for col in dict.fromkeys([*refs, *orders]):
        known = dict(out.schema[col].metadata)
        if col in refs:
            known["reference_level"] = str(refs[col])
        if col in orders:
            known["level_order"] = [str(lv) for lv in orders[col]]
        out = out.withMetadata(col, known)
    return out


def reference_of(df: DataFrame, col: str) -> str | None:
    return df.schema[col].metadata.get("reference_level") if col in df.columns else None


def level_order_of(df: DataFrame, col: str) -> list[str]:
    return list(df.schema[col].metadata.get("level_order", [])) if col in df.columns else []


def in_order(levels, reference: str | None = None, order: Sequence[str] = ()) -> list:
    """Levels with the reference first, then those of ``order``, then the others sorted."""
    place = {lv: i for i, lv in enumerate(order)}
    return sorted(levels, key=lambda lv: (str(lv) != reference, place.get(str(lv), len(place)), lv))
