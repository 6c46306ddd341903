"""Descriptive aggregates (A1-A22, W5-W10): one grouped pass each, with
conditional (FILTER-style) measures instead of separate jobs plus joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicohort.operators.quantiles import exact_quantiles
from epicohort.sources.io import stash


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """A1."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_with_total(df: DataFrame, key: str, by: str, total_label: str = "total", out: str = "n") -> DataFrame:
    """A2: counts per (key, by) plus one 'total' row per key, from one
    ROLLUP aggregate (the grand-total grouping set is dropped)."""
    g = df.rollup(key, by).agg(F.count(F.lit(1)).alias(out), F.grouping_id().alias("_gid"))
    return g.where(F.col("_gid") < 3).select(
        key, F.when(F.col("_gid") == 1, F.lit(total_label)).otherwise(F.col(by).cast("string")).alias(by), out)


def describe_num(df: DataFrame, col: str) -> DataFrame:
    """A4: min, max, mean, sample sd."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("sd"))


def _keyed(df: DataFrame, keys: Sequence[str]):
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit("overall")), ["_all"]


def medians_wide(df: DataFrame, keys: Sequence[str], measures: dict) -> DataFrame:
    """Exact medians of several measures per key in one quantile job:
    measures {out_name: column expression (NULL rows ignored)}."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("_measure"), expr.cast("double").alias("_v")) for name, expr in measures.items()
    ])).alias("_s")).select(*keys, "_s._measure", "_s._v")
    q = exact_quantiles(long, "_v", [0.5], by=list(keys) + ["_measure"])
    return q.groupBy(*keys).pivot("_measure", list(measures)).agg(F.first("q"))


def pay_summary(df: DataFrame, keys: Sequence[str] = (), pay: str = "pay", deflated: str | None = "pay_deflated",
                in_work: str = "in_work", with_max: bool = True, with_n: bool = False) -> DataFrame:
    """A5 + A7: mean / exact median of pay (and deflated pay), max rounded to
    hundreds, share in work, and the same measures for the in-work rows, in
    one aggregate (a key with no in-work rows gets NULL in-work measures)."""
    df, keys = _keyed(df, keys)
    iw = F.col(in_work) == 1
    cols = {"pay": F.col(pay)}
    if deflated:
        cols["pay_deflated"] = F.col(deflated)
    aggs = []
    med = {}
    for name, c in cols.items():
        aggs.append(F.avg(c).alias(f"average_monthly_{name}"))
        aggs.append(F.avg(F.when(iw, c)).alias(f"average_monthly_{name}_in_work"))
        if with_max:
            aggs.append(F.round(F.max(c), -2).alias(f"max_monthly_{name}"))
            aggs.append(F.round(F.max(F.when(iw, c)), -2).alias(f"max_monthly_{name}_in_work"))
        med[f"median_monthly_{name}"] = c
        med[f"median_monthly_{name}_in_work"] = F.when(iw, c)
    aggs.append((F.sum(F.col(in_work)) / F.count(F.lit(1))).alias("prop_in_work"))
    if with_n:
        aggs.append(F.count(F.lit(1)).alias("n_people"))
    main = df.groupBy(*keys).agg(*aggs)
    meds = medians_wide(df, keys, med)
    if keys == ["_all"]:  # one row each: merge without a join on a constant key
        both = main.unionByName(meds, allowMissingColumns=True)
        return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c != "_all"])
    return main.join(meds, on=keys, how="left")


def pay_summary_pre_post(df: DataFrame, t: str = "t_op", **kw) -> DataFrame:
    """Overall row on top of pre (t < 0) / post groups."""
    overall = pay_summary(df, **kw).withColumn("group", F.lit("overall"))
    grouped = pay_summary(df.withColumn("group", F.when(F.col(t) < 0, "pre-surgery").otherwise("post-surgery")),
                          ["group"], **kw)
    return overall.unionByName(grouped)


def series(df: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Pay summary by event time, calendar month, or age and sex."""
    return pay_summary(df, keys, with_max=False, with_n=True, **kw)


def category_counts(df: DataFrame, cols: Sequence[str], id_col: str = "census_id_final") -> DataFrame:
    """Count and percent (1 dp) per category of each listed column, long
    form, from one unpivot + aggregate instead of one job per column."""
    long = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [id_col], list(cols), "Variable_names", "Category_name")
    g = long.groupBy("Variable_names", "Category_name").agg(F.count(F.lit(1)).alias("Count"))
    return g.withColumn("Percentage", F.round(F.col("Count") / F.sum("Count").over(
        Window.partitionBy("Variable_names")) * 100, 1))


def crosstab_long(df: DataFrame, a: str, b: str, id_col: str = "census_id_final") -> DataFrame:
    """One row per person (smallest a, then b), then counts by (a, b)."""
    from epicohort.operators.panel import first_row_by
    one = first_row_by(df.select(id_col, a, b), id_col, [a, b])
    return (one.groupBy(F.col(a), F.col(b).cast("string").alias("grouping")).agg(F.count(F.lit(1)).alias("Count"))
               .withColumn("characteristic", F.lit(b)))


def std_diff_numeric(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Standardised difference of means with its 95 % interval, per
    variable: d = |m1 - m0| / sqrt((v1 + v0) / 2),
    se = sqrt((n1 + n0) / (n1 n0) + d^2 / (2 (n1 + n0)))."""
    long = df.select(F.col(group).alias("_g"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_s")
    ).select("_g", "_s.variable", "_s._v").where(F.col("_v").isNotNull())
    st = long.groupBy("variable").agg(
        *[f(F.when(F.col("_g") == g, F.col("_v"))).alias(f"{n}{g}") for g in (0, 1)
          for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return _std_diff_finish(st, (F.col("v1") + F.col("v0")) / 2)


def std_diff_binary(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """A15 for 0/1 variables: proportions in place of means,
    d = |p1 - p0| / sqrt((p1 (1 - p1) + p0 (1 - p0)) / 2)."""
    long = df.select(F.col(group).alias("_g"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_s")
    ).select("_g", "_s.variable", "_s._v").where(F.col("_v").isNotNull())
    st = long.groupBy("variable").agg(
        *[f(F.when(F.col("_g") == g, F.col("_v"))).alias(f"{n}{g}") for g in (0, 1)
          for n, f in (("m", F.avg), ("n", F.count))])
    pooled = (F.col("m1") * (1 - F.col("m1")) + F.col("m0") * (1 - F.col("m0"))) / 2
    return _std_diff_finish(st, pooled)


def _std_diff_finish(st: DataFrame, pooled_var: Column) -> DataFrame:
    d = F.try_divide(F.abs(F.col("m1") - F.col("m0")), F.sqrt(pooled_var))  # no spread -> NULL, never an ANSI error
    return _std_diff_interval(st.withColumn("std_diff", d))


def _std_diff_interval(st: DataFrame) -> DataFrame:
    """variable, std_diff and its 95 % interval, from std_diff and the group sizes n1 and n0."""
    se = F.sqrt(F.try_divide(F.col("n1") + F.col("n0"), F.col("n1") * F.col("n0"))
                + F.try_divide(F.col("std_diff") ** 2, 2 * (F.col("n1") + F.col("n0"))))
    return st.select("variable", "std_diff", (F.col("std_diff") - 1.96 * se).alias("std_diff_lcl"),
                     (F.col("std_diff") + 1.96 * se).alias("std_diff_ucl"))


def std_diff_category(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """A15 for factors: the Mahalanobis distance of the two groups' level shares t and
    c, one level left out, for all columns from one unpivoted count.

    The covariance of the shares is diag((t + c) / 2) - (t t' + c c') / 2, a diagonal
    less a matrix of rank two, so its inverse needs six sums over the levels and
    no matrix (Woodbury): any number of columns and levels is two grouped aggregates.
    The level left out is the most frequent one, which keeps the sums well conditioned; the
    distance is the same for any.  NULL levels and groups are left out; a column with
    one level has distance 0; groups that share no level, or an empty one, give NULL."""
    long = df.select(F.col(group).alias("_g"), *[F.col(c).cast("string").alias(c) for c in cols]).where(F.col("_g").isin(0, 1)) \
        .unpivot(["_g"], list(cols), "variable", "_level").where(F.col("_level").isNotNull())
    counts = long.groupBy("variable", "_level").agg(
        *[F.sum((F.col("_g") == g).cast("long")).alias(f"_c{g}") for g in (0, 1)])
    sizes = counts.groupBy("variable").agg(F.sum("_c1").alias("n1"), F.sum("_c0").alias("n0"),
                                           F.max_by("_level", F.struct(F.col("_c0") + F.col("_c1"), "_level")).alias("_out"))
    shares = counts.join(sizes, "variable").withColumns({"_t": F.try_divide("_c1", "n1"), "_c": F.try_divide("_c0", "n0")})
    t, c, kept = F.col("_t"), F.col("_c"), F.col("_level") != F.col("_out")
    over = lambda x: F.coalesce(F.sum(F.when(kept, F.try_divide(2 * x, t + c))), F.lit(0.0))
    sums = shares.groupBy("variable").agg(
        F.first("n1").alias("n1"), F.first("n0").alias("n0"), over((t - c) * (t - c)).alias("a"), over(t * (t - c)).alias("b1"),
        over(c * (t - c)).alias("b0"), over(t * t).alias("g11"), over(t * c).alias("g10"), over(c * c).alias("g00"))
    h1, h0 = 1 - F.col("g11") / 2, 1 - F.col("g00") / 2
    det = h1 * h0 - F.col("g10") * F.col("g10") / 4
    more = (h0 * F.col("b1") * F.col("b1") + F.col("g10") * F.col("b1") * F.col("b0") + h1 * F.col("b0") * F.col("b0")) / 2
    distance = F.sqrt(F.greatest(F.col("a") + F.try_divide(more, F.when(F.abs(det) > 1e-12, det)), F.lit(0.0)))
    empty = (F.col("n1") == 0) | (F.col("n0") == 0)
    return _std_diff_interval(sums.withColumn("std_diff", F.when(~empty & (F.abs(det) > 1e-12), distance)))


def follow_up(df: DataFrame, id_col: str = "census_id_final", t: str = "t_op") -> DataFrame:
    """Months of follow-up per person (max - min + 1), summarised
    overall, after the event (t >= 1) and before it (t < 1): one conditional
    aggregate per person for all three, stored; the median is the distributed exact
    quantile (no group is gathered in one task)."""
    periods = {"overall": F.lit(True), "post": F.col(t) >= 1, "pre": F.col(t) < 1}
    lengths = [(F.max(F.when(cond, F.col(t))) - F.min(F.when(cond, F.col(t))) + 1).alias(label) for label, cond in periods.items()]
    per = df.groupBy(id_col).agg(*lengths).drop(id_col)
    per = per.unpivot([], list(periods), "period", "_len").where(F.col("_len").isNotNull())
    per = stash(per, "follow_up")
    stats = per.groupBy("period").agg(F.avg("_len").alias("mean_months"), F.max("_len").alias("max_months"),
                                      F.min("_len").alias("min_months"))
    med = exact_quantiles(per, "_len", [0.5], by=["period"]).select("period", F.col("q").alias("median_months"))
    return stats.join(med, "period")


def histogram(df: DataFrame, col: str, width: float = 100.0, lo: float = 0.0, hi: float = 10000.0) -> DataFrame:
    """Counts per bin [lo + k w, lo + (k + 1) w) inside [lo, hi); rows below are
    bin -1, which has no start, and rows from hi on a last bin, which has no end.  NULL and
    NaN values are in no bin."""
    last = F.lit(int(-((lo - hi) // width))).cast("long")
    x = F.col(col)
    b = F.when(x < lo, F.lit(-1).cast("long")).when(x >= hi, last).otherwise(F.floor((x - lo) / width))
    start = F.when(F.col("bin") < 0, F.lit(None)).when(F.col("bin") == last, F.lit(float(hi))).otherwise(F.col("bin") * width + lo)
    return (df.where(x.isNotNull() & ~F.isnan(x.cast("double"))).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")).withColumn("bin_start", start))


def rolling_mean(df: DataFrame, order: str, col: str, width: int = 3) -> DataFrame:
    """Centred rolling mean over existing rows, partial at the ends (small tables)."""
    half = width // 2
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(f"{col}_smooth", F.avg(col).over(w))
