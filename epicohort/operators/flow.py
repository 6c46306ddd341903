"""Sample flow - rows and distinct ids after each of a chain of filters.

The reference counts each stage with two jobs over the full lineage.  Here
nested filters become one integer ``stage_reached`` per row and all counts
come from one aggregate by id (map-side combined, so a hot id or the NULL id
costs one row per task), then one tiny global aggregate.  Distinct-id counts
treat NULL as one id, as counting rows of ``distinct(id)`` does.

Steps that are joins and not filters are counted in the same aggregate, over
one frame that all of them have passed: a step whose rows a later join has
multiplied names the column that says how many of its rows a row of the frame
stands for (1 on the first of them, 0 on the others; or a count).  The frame is
a written stage, so counts are exact after lost executors, where metrics
that tasks report while they write would count a repeated task twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: (label, filter or None), and the column of rows that a row stands for where that is not 1.
Step = tuple[str, Column | None] | tuple[str, Column | None, Column]


def stage_reached(stages: Sequence[Step]) -> Column:
    """Index of the last stage whose cumulative predicate holds (0 = first)."""
    cum = F.lit(True)
    expr = F.lit(0)
    for k, (_, pred, *_) in enumerate(stages):
        if pred is not None:
            cum = cum & F.coalesce(pred, F.lit(False))
        expr = F.when(cum, F.lit(k)).otherwise(expr)
    return expr


def flow_counts(df: DataFrame, id_col: str, stages: Sequence[Step], first_step: int = 1) -> DataFrame:
    """(step, stage, n_rows, n_ids) for nested filters applied in order.
    ``stages[0]`` is usually ``(label, None)`` for the unfiltered frame."""
    held = {i: f"_held{i}" for i, s in enumerate(stages) if len(s) > 2}
    reached = df.select(F.col(id_col).alias("_id"), stage_reached(stages).alias("_r"),
                        *[stages[i][2].cast("long").alias(name) for i, name in held.items()])
    k = len(stages)
    per_id = reached.groupBy("_id").agg(
        F.max("_r").alias("_mx"),
        *[F.sum(F.when(F.col("_r") >= i, F.col(held[i]) if i in held else 1).otherwise(0)).alias(f"_rows{i}")
          for i in range(k)])
    tot = per_id.agg(
        *[F.coalesce(F.sum(f"_rows{i}"), F.lit(0)).cast("long").alias(f"_rows{i}") for i in range(k)],
        *[F.coalesce(F.sum(F.when(F.col("_mx") >= i, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"_ids{i}")
          for i in range(k)])
    rows = ", ".join(
        f"{first_step + i}, '{label.replace(chr(39), chr(39) * 2)}', _rows{i}, _ids{i}"
        for i, (label, *_) in enumerate(stages))
    return tot.selectExpr(f"stack({k}, {rows}) AS (step, stage, n_rows, n_ids)").select(
        F.col("step").cast("int"), "stage", "n_rows", "n_ids")


def frame_counts(df: DataFrame, id_col: str, label: str, step: int) -> DataFrame:
    """One flow row for a frame that is not a filter of the previous one."""
    return flow_counts(df, id_col, [(label, None)], first_step=step)


def concat_flows(*flows: DataFrame) -> DataFrame:
    out = flows[0]
    for f in flows[1:]:
        out = out.unionByName(f)
    return out
