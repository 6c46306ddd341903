"""Exact quantiles (linear interpolation, R type 7 = DuckDB quantile_cont)
without gathering a column or a group into one task.

A quantile needs the values of two neighbouring ranks, k1 and k2.  Rows are
counted into cells that follow each other in value; a cell keeps its number of
rows, its least and its greatest value.  If the ranks fall into two cells, their
values are the end of the one and the start of the other; if they fall into one cell
with one value, it is that; else that cell is the bracket of the next round, so
every round ends with the answer or with a smaller bracket that is known to hold both ranks.

The first round's bracket is a guess by ``percentile_approx``, with a cell for all
rows below it and one for all above: a poor guess costs a round, never the
result.  Inside a bracket cells are ``CELLS`` intervals of equal width, or the
distinct values themselves where at most ``LISTED`` rows can lie strictly inside.
Each round is one scan for all groups and probabilities, counted before anything
is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicohort.sources.io import stash

#: Intervals of a bracket, and most rows between its ends for their distinct values to be cells.
CELLS, LISTED = 1_024, 4_096
_BELOW, _INSIDE, _ABOVE = 0, 1, 2


def _same(by: Sequence[str]) -> Column:
    """NULL-safe match of the group columns of a bracket (``_g0`` ...) with a row's."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 10_000, weight: str | None = None) -> DataFrame:
    """Long result: (*by, p, q).  NULL, NaN and infinite values are ignored; a group
    without any other is absent; a NULL group is a group.  ``df`` is read twice at
    least: pass a stored table where it is costly.  ``weight``: a column that says how many
    rows (1 at least) each row stands for; the first bracket is the whole range then."""
    by, probs = list(by), [float(p) for p in probs]
    whole = not by
    x = F.col(value).cast("double")
    keys = by or ["_all"]
    of_row = (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")
    base = df.select(*(by or [F.lit(0).alias("_all")]), x.alias("_x"), of_row).where((F.abs("_x") < float("inf")))
    delta = 4.0 / accuracy
    guesses = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-delta, delta)]
    if weight:
        guess, inside = F.array(*[F.min("_x"), F.max("_x")] * len(probs)), F.count(F.lit(1))
    else:
        guess, inside = F.percentile_approx("_x", guesses, accuracy), F.count(F.lit(1)) * (10.0 / accuracy)
    groups = base.groupBy(*keys).agg(F.sum("_w").alias("_n"), guess.alias("_guess"), (inside <= LISTED).alias("_few"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)]))
    h = (F.col("_n") - 1) * F.col("_p.p")
    open_ = groups.withColumn("_p", wanted).select(
        *keys, F.col("_p.p").alias("p"), h.alias("_h"), F.floor(h).alias("_k1"), F.least(F.floor(h) + 1, F.col("_n") - 1).alias("_k2"),
        F.element_at("_guess", 2 * F.col("_p.i") + 1).alias("_lo"), F.element_at("_guess", 2 * F.col("_p.i") + 2).alias("_hi"),
        F.lit(0).cast("long").alias("_before"), F.col("_few").alias("_listed"))
    done: list[DataFrame] = []
    first = True
    while True:
        open_ = stash(open_, "quantile_brackets")
        if not first and not open_.limit(1).count():
            break
        resolved, open_ = _round(base, open_, keys, whole, first)
        done.append(resolved)
        first = False
    out = reduce(DataFrame.unionByName, done)
    q = F.col("_v1") + (F.col("_h") - F.col("_k1")) * (F.col("_v2") - F.col("_v1"))
    return out.select(*by, "p", q.alias("q"))


def _round(base: DataFrame, open_: DataFrame, keys: list[str], whole: bool, first: bool) -> tuple[DataFrame, DataFrame]:
    """One scan: the quantiles that are settled now, and the brackets of the others."""
    per_group = open_.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]).agg(
        F.collect_list(F.struct("p", "_lo", "_hi", "_listed")).alias("_brackets"))  # one for each probability at most
    rows = base.join(F.broadcast(per_group) if whole else per_group, _same(keys))
    rows = rows.select(*keys, "_x", "_w", F.explode("_brackets").alias("_b"))
    lo, hi = F.col("_b._lo"), F.col("_b._hi")
    zone = F.when(F.col("_x") < lo, _BELOW).when(F.col("_x") > hi, _ABOVE).otherwise(_INSIDE)
    share = F.try_divide(F.col("_x") / 2 - lo / 2, hi / 2 - lo / 2)  # halves: the width of a bracket can be beyond the greatest double
    cell = F.when(F.col("_b._listed"), F.col("_x")).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)).cast("double"))
    rows = rows.select(*keys, F.col("_b.p").alias("p"), zone.alias("_zone"), F.when(zone == _INSIDE, cell).otherwise(0.0).alias("_cell"), "_x", "_w")
    if not first:
        rows = rows.where(F.col("_zone") == _INSIDE)
    cells = rows.groupBy(*keys, "p", "_zone", "_cell").agg(
        F.sum("_w").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    group = Window.partitionBy(*keys, "p").orderBy("_zone", "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_until", F.sum("_c").over(group))
    targets = open_.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], F.col("p").alias("_gp"), "_h", "_k1", "_k2",
                           F.col("_before").alias("_base"))
    cells = cells.join(F.broadcast(targets) if whole else targets, _same(keys) & (F.col("p") == F.col("_gp")))
    end = F.col("_base") + F.col("_until")
    start = end - F.col("_c")
    holds = lambda k: (start <= F.col(k)) & (F.col(k) < end)
    last = lambda k, v: F.max(F.when(holds(k), v))
    both = holds("_k1") & holds("_k2")
    found = cells.groupBy(*keys, "p").agg(
        F.first("_h").alias("_h"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"), F.max(both.cast("int")).alias("_one"),
        last("_k1", F.col("_min")).alias("_lo"), last("_k1", F.col("_max")).alias("_hi"), last("_k2", F.col("_min")).alias("_lo2"),
        last("_k1", start).alias("_before"), last("_k1", F.col("_c")).alias("_c"))
    found = stash(found, "quantile_cells")
    settled = (F.col("_one") == 0) | (F.col("_lo") == F.col("_hi"))
    values = found.where(settled).select(*keys, "p", "_h", "_k1", F.col("_hi").alias("_v1"),
                                         F.when(F.col("_one") == 1, F.col("_hi")).otherwise(F.col("_lo2")).alias("_v2"))
    rest = found.where(~settled).select(*keys, "p", "_h", "_k1", "_k2", "_lo", "_hi", "_before", (F.col("_c") <= LISTED).alias("_listed"))
    return values, rest


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Whole-column quantiles as driver floats (one number per probability)."""
    rows = exact_quantiles(df, value, probs).collect()
    got = {r["p"]: r["q"] for r in rows}
    return [got.get(float(p)) for p in probs]
