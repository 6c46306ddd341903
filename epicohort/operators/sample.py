"""Event-month distribution, pseudo event dates for the unexposed and the
matched stratified sample (X1-X5, J8, W5-W7, A13, T3)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epicohort.config import StudyConfig
from epicohort.functions.dates import lit_date
from epicohort.functions.draws import uniform_draw

GRID = 4096  # equi-join grid for the range join on cumulative shares


def event_month(date_col: str, origin: dt.date):
    """Month number of a date counted from the origin (floor of months_between)."""
    return F.floor(F.months_between(F.col(date_col), lit_date(origin))).cast("int")


def month_distribution(df: DataFrame, cfg: StudyConfig, date_col: str = "op_date",
                       normalise: bool = False) -> DataFrame:
    """Counts per event month, centred rolling mean of width 3 over the
    existing months (partial at the ends), cumulative smoothed share.

    The cumulative sum of smoothed counts is divided by the raw total (the
    reference's choice, trap 2) unless ``normalise``; the last month's upper
    bound is forced to 1 (W7).  One row per month: at most the window length,
    so the single-partition windows below run on a tiny table."""
    counts = (df.select(event_month(date_col, cfg.origin).alias("op_month"))
                .groupBy("op_month").agg(F.count(F.lit(1)).alias("op_count")))
    w_all = Window.partitionBy(F.lit(1))
    w_ord = w_all.orderBy("op_month")
    out = counts.withColumns({
        "op_count_smooth": F.avg("op_count").over(w_ord.rowsBetween(-1, 1)),
        "_total": F.sum("op_count").over(w_all) if not normalise else F.lit(None),
    })
    if normalise:
        out = out.withColumn("_total", F.sum("op_count_smooth").over(w_all))
    out = out.withColumn("_cum", F.sum("op_count_smooth").over(w_ord.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("max_cum_prop", F.col("_cum") / F.col("_total"))
    out = out.withColumn("min_cum_prop", F.lag("max_cum_prop", 1, 0.0).over(w_ord))
    out = out.withColumn("max_cum_prop", F.when(F.col("op_month") == F.max("op_month").over(w_all), F.lit(1.0))
                         .otherwise(F.col("max_cum_prop")))
    return out.select("op_month", "op_count", "op_count_smooth", "min_cum_prop", "max_cum_prop")


def smoothing_long(dist: DataFrame) -> DataFrame:
    """X1 long form: raw and smoothed counts as (op_month, line, n_op)."""
    return dist.select("op_month", F.col("op_count").cast("double"), "op_count_smooth").unpivot(
        ["op_month"], ["op_count", "op_count_smooth"], "line", "n_op")


def assign_dates(df: DataFrame, dist: DataFrame, cfg: StudyConfig, id_col: str = "census_id_final") -> DataFrame:
    """X2 + J8: uniform draw per person -> month whose (min, max] cumulative
    share holds it -> the 15th of that month.

    The range join is an equi-join on a grid cell of the draw (each month is
    spread over the cells it covers: at most GRID + months rows, broadcast)
    followed by the exact (min, max] test, so each person meets one or two
    candidate months instead of every month."""
    bins = dist.select("op_month", "min_cum_prop", "max_cum_prop").withColumn(
        "_cell", F.explode(F.sequence(
            F.floor(F.col("min_cum_prop") * GRID).cast("int"),
            F.least(F.floor(F.col("max_cum_prop") * GRID).cast("int"), F.lit(GRID - 1)))))
    drawn = df.withColumn("_u", uniform_draw(F.col(id_col), cfg.seed)).withColumn(
        "_cell", F.floor(F.col("_u") * GRID).cast("int"))
    mid = dt.date(cfg.origin.year, cfg.origin.month, 15)
    return (drawn.join(bins, "_cell")
                 .where((F.col("_u") > F.col("min_cum_prop")) & (F.col("_u") <= F.col("max_cum_prop")))
                 .withColumn("op_date", F.add_months(lit_date(mid), F.col("op_month")))
                 .drop("_cell", "_u", "min_cum_prop", "max_cum_prop", "op_count", "op_count_smooth"))


def month_shares(df: DataFrame, cfg: StudyConfig, label: str, date_col: str = "op_date") -> DataFrame:
    """X3 part: share of people per event month, labelled."""
    c = df.select(event_month(date_col, cfg.origin).alias("op_month")).groupBy("op_month").agg(
        F.count(F.lit(1)).alias("n_people"))
    return with_share(c, "n_people", "prop_people").withColumn("dataset", F.lit(label))


def with_share(counts: DataFrame, n_col: str, out: str) -> DataFrame:
    """N / sum(n) over a small aggregated table."""
    return counts.withColumn(out, F.col(n_col) / F.sum(n_col).over(Window.partitionBy(F.lit(1))))


def strata_shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People per stratum and their share of the total."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return with_share(c, "n", "prop")


def stratum_targets(shares: DataFrame, total: int) -> DataFrame:
    """Wanted size per stratum: round(total * share) (Spark round, half up)."""
    return shares.select(*[c for c in shares.columns if c not in ("n", "prop")],
                         F.round(F.lit(total) * F.col("prop")).cast("long").alias("n_wanted"))


def fitting_targets(pop: DataFrame, shares: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Wanted sizes of the largest sample, of ``total`` people at most, that keeps the shares and
    leaves no stratum short.  Strata that nobody of ``pop`` is in carry no share (common
    support).  With S people in all strata, n in one and a available there, round(T * n / S) <= a
    holds up to T = ((2a + 1) * S - 1) div 2n; sizes are whole-number arithmetic throughout."""
    keys = list(keys)
    have = pop.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_available"))
    every = Window.partitionBy(F.lit(1))  # one row per stratum
    s = shares.select(*keys, "n").join(have, keys).withColumn("_s", F.sum("n").over(every))
    s = s.withColumn("_t", F.expr("((2 * n_available + 1) * _s - 1) div (2 * n)"))
    s = s.withColumn("total", F.least(F.lit(total).cast("long"), F.min("_t").over(every)))
    return s.select(*keys, F.expr("(2 * total * n + _s) div (2 * _s)").alias("n_wanted"), "n_available", "total")


def sample_shortfall(pop: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People wanted, available and missing in each stratum (also in strata that nobody is in)."""
    keys = list(keys)
    have = pop.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_available"))
    out = targets.select(*keys, "n_wanted").join(have, keys, "left")
    out = out.withColumn("n_available", F.coalesce("n_available", F.lit(0)))
    return out.withColumn("n_missing", F.greatest(F.col("n_wanted") - F.col("n_available"), F.lit(0)))


def stratified_sample(pop: DataFrame, targets: DataFrame, keys: Sequence[str], seed: str,
                      id_col: str = "census_id_final", buckets: int = 65536,
                      check: bool = True) -> DataFrame:
    """X5 + T3: exactly ``n_wanted`` people per stratum, the ones with the
    smallest deterministic draws (ties broken by id); strata are matched by
    key, not by position (trap 4).

    No stratum is sorted in one task: draws are cut into ``buckets`` cells,
    a per-(stratum, cell) histogram (map-side combined) finds the cell that
    holds the n-th draw, every row in lower cells is taken, and only the
    rows of that one boundary cell are ranked.  ``check`` raises when a
    stratum has fewer people than wanted (one tiny collect of per-stratum sizes)."""
    keys = list(keys)
    d = (pop.join(targets.select(*keys, "n_wanted"), on=keys, how="inner")
            .withColumn("_u", uniform_draw(F.col(id_col), seed))
            .withColumn("_b", F.floor(F.col("_u") * buckets).cast("int")))
    hist = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("n_wanted").alias("n_wanted"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_c").over(w))
    cut = (hist.where(F.col("_cum") >= F.col("n_wanted"))
               .groupBy(*keys).agg(F.min(F.struct("_b", "_cum", "_c")).alias("_m"))
               .select(*keys, F.col("_m._b").alias("_cut"), F.col("_m._cum").alias("_cum_at"),
                       F.col("_m._c").alias("_c_at")))
    if check:
        short = sample_shortfall(pop, targets, keys).where(F.col("n_missing") > 0).collect()
        if short:
            raise ValueError(f"strata smaller than their wanted size: {[r.asDict() for r in short]}")
    # A stratum smaller than wanted has no cut and is taken whole.
    dc = d.join(cut, on=keys, how="left")
    lower = dc.where(F.col("_cut").isNull() | (F.col("_b") < F.col("_cut")))
    edge = dc.where(F.col("_b") == F.col("_cut"))
    need_in_edge = F.col("n_wanted") - (F.col("_cum_at") - F.col("_c_at"))
    we = Window.partitionBy(*keys).orderBy("_u", id_col)
    edge = edge.withColumn("_rn", F.row_number().over(we)).where(F.col("_rn") <= need_in_edge).drop("_rn")
    return lower.unionByName(edge).drop("_u", "_b", "_cut", "_cum_at", "_c_at", "n_wanted")
