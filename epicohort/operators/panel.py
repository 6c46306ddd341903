"""Person x month panel (L1-L9, J6, J13, P16, A18) and analysis variables
(L10-L17, J10, W8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.config import StudyConfig
from epicohort.functions.dates import (age_on, event_time, label_to_month, month_label, month_number,
                                       month_of_number, months_since)
from epicohort.functions.recode import age_bands


def first_row_by(df: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """One whole row per id: the one with the smallest ``order_cols`` (NULLs
    last), ties broken by the remaining columns.  A ``min`` over a struct is
    an ordinary aggregate with map-side combine, so no id's rows are ever
    gathered in one task (unlike ``row_number`` over a window)."""
    rest = [c for c in df.columns if c != id_col and c not in order_cols]
    keyed = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"_o{i}")
                       for i, c in enumerate(order_cols)],
                     *[F.col(c) for c in order_cols + rest])
    return (df.groupBy(id_col).agg(F.min(keyed).alias("_r"))
              .select(id_col, *[F.col(f"_r.{c}").alias(c) for c in order_cols + rest]))


def one_row_per_person(df: DataFrame, id_col: str = "census_id_final", order_col: str = "lsoa_final") -> DataFrame:
    """Collapse crosswalk fan-out deterministically (smallest area code) so the
    panel is unique on (person, month)."""
    return first_row_by(df, id_col, [order_col])


def expand_months(df: DataFrame, cfg: StudyConfig, op: str = "op_date") -> DataFrame:
    """L1 + L2 + L8 (J13): one row per person and month end of the spine.

    Months are bounded by the spine and the event window *inside* the
    sequence, before exploding, so no row outside the window is ever made."""
    s, e = cfg.spine_bounds
    spine_lo = s.year * 12 + s.month - 1
    spine_hi = e.year * 12 + e.month - 2
    lo_t, hi_t = cfg.event_window
    o = month_number(F.col(op))
    first = F.greatest(F.lit(spine_lo), o + F.lit(lo_t - 1))
    last = F.least(F.lit(spine_hi), o + F.lit(hi_t - 1))
    months = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return (df.withColumn("_m", F.explode(months))
              .withColumn("ref_date", F.last_day(month_of_number(F.col("_m")))).drop("_m"))


def panel_variables(df: DataFrame, cfg: StudyConfig, op: str = "op_date") -> DataFrame:
    """Event time, month label, death censoring, monthly age and the
    age / event-window filters."""
    lo_a, hi_a = cfg.panel_age
    lo_t, hi_t = cfg.event_window
    out = df.withColumns({
        "t_op": event_time(F.col("ref_date"), F.last_day(F.col(op))),
        "month_label": month_label(F.col("ref_date")),
        "age_monthly": age_on(F.col("ref_date"), F.col("prov_dob")),
    })
    return out.where((F.col("dod").isNull() | (F.col("dod") > F.col("ref_date")))
                     & F.col("age_monthly").between(lo_a, hi_a)
                     & F.col("t_op").between(lo_t, hi_t))


def build_panel(df: DataFrame, cfg: StudyConfig, op: str = "op_date") -> DataFrame:
    """L1-L7 composed."""
    return panel_variables(expand_months(df, cfg, op), cfg, op)


def identifier_links(routes: dict) -> DataFrame:
    """Person <-> pay identifier pairs of both routes (S3: the multi-person
    flag is a pushed filter), tagged by route."""
    frames = []
    for flag, t in routes.items():
        frames.append(t.where(F.col("nino_contains_multiple_census_id") == 0)
                       .select(F.lit(flag).alias("census_id_flag"),
                               F.col("census_id").alias("census_id_final"),
                               F.col("frameworks_nino").alias("valid_nino")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def combine_ids(pay: DataFrame, links: DataFrame) -> DataFrame:
    """A18 + P16: per person and month, pay summed over the person's
    identifiers after clamping each identifier's negative pay to 0 (trap 18),
    days summed, paye flag = any identifier present."""
    p = pay.select("valid_nino", F.col("month").alias("month_label"),
                   F.greatest(F.coalesce(F.col("pay"), F.lit(0.0)), F.lit(0.0)).alias("pay"),
                   F.coalesce(F.col("days_worked"), F.lit(0.0)).alias("days_worked"))
    return (links.join(p, "valid_nino")
                 .groupBy("census_id_flag", "census_id_final", "month_label")
                 .agg(F.sum("pay").alias("pay"), F.sum("days_worked").alias("days_worked"),
                      F.lit(1).alias("paye_flag")))


def attach_measures(panel: DataFrame, measures: DataFrame) -> DataFrame:
    """J6 + P16: composite-key left join; missing months get 0 pay, 0 days, flag 0."""
    return (panel.join(measures, on=["census_id_flag", "census_id_final", "month_label"], how="left")
                 .fillna({"pay": 0.0, "days_worked": 0.0, "paye_flag": 0}))


def recent_event_flags(df: DataFrame, dates: Column | str = "baby_dobs", ref: str = "ref_date",
                       spans=(("birth_in_1yr", 0, 12), ("birth_in_5yr", 12, 60))) -> DataFrame:
    """1 when any date lies lo <= months_between(ref, d) < hi.  ``dates`` is an
    array column of all dates; wide date columns go in as ``F.array(*cols)``."""
    arr = F.col(dates) if isinstance(dates, str) else dates
    out = df
    for name, lo, hi in spans:
        hit = F.exists(arr, lambda d: d.isNotNull()
                       & (F.months_between(F.col(ref), d) >= lo) & (F.months_between(F.col(ref), d) < hi))
        out = out.withColumn(name, F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))
    return out.drop(dates) if isinstance(dates, str) else out


def monthly_panel(linked: DataFrame, id_routes: dict, pay: DataFrame, births: DataFrame,
                  cfg: StudyConfig) -> DataFrame:
    """Stage 1e: persons with a pay identifier -> months -> pay -> recent births."""
    persons = one_row_per_person(linked)
    links = identifier_links(id_routes)
    persons = persons.join(links.select("census_id_flag", "census_id_final").distinct(),
                           on=["census_id_flag", "census_id_final"], how="left_semi")
    persons = persons.withColumn("age_bands", age_bands(F.col("age_at_operation")))
    persons = persons.join(births.withColumnRenamed("baby_dob_census_id_final", "census_id_final"),
                           on="census_id_final", how="left")
    panel = build_panel(persons, cfg)
    study_links = links.join(persons.select("census_id_flag", "census_id_final"),
                             on=["census_id_flag", "census_id_final"], how="left_semi")
    panel = attach_measures(panel, combine_ids(pay, study_links))
    return recent_event_flags(panel)


# --------------------------------------------------------------- analysis variables

def event_bins(df: DataFrame, t: str = "t_op") -> DataFrame:
    """Yearly and six-month event-time bins, and their 'baseline' forms
    with every pre-event bin set to 0."""
    tc = F.col(t)
    year = F.ceil(tc / 12.0)
    six = (F.when(tc <= 0, F.ceil(tc / 6.0)).when(tc <= 6, tc).otherwise(F.ceil(tc / 6.0) + 5)).cast("long")
    return df.withColumns({
        "t_treatment_year": year,
        "t_treatment_6_month": six,
    }).withColumns({
        "t_treatment_year_baseline": F.greatest(F.col("t_treatment_year"), F.lit(0)),
        "t_treatment_6_month_baseline": F.greatest(F.col("t_treatment_6_month"), F.lit(0)),
    })


def bin_bounds(b: str = "t_treatment_6_month") -> dict:
    """Left, right and mid month of a six-month bin (post bins 1..6 are
    single months; later bins span six months)."""
    t = F.col(b)
    left = F.when(t <= 0, t * 6 - 6).when(t <= 6, t - 1).otherwise(t * 6 - 36)
    right = F.when(t <= 0, t * 6).when(t <= 6, t).otherwise(t * 6 - 30)
    return {"month_left": left, "month_right": right, "month_mid": (left + right) / 2.0}


def calendar_index(df: DataFrame, cfg: StudyConfig, label: str = "month_label") -> DataFrame:
    """1-based calendar month from the origin and its six-month index."""
    m = label_to_month(F.col(label))
    return df.withColumns({
        "month": m,
        "cal_month": F.month(m),
        "month_num": (months_since(m, cfg.origin) + 1).cast("int"),
    }).withColumn("six_month_num", F.ceil(F.col("month_num") / 6.0))


def outcomes(df: DataFrame, winsor_hi: float, deflator: DataFrame) -> DataFrame:
    """In work, upper-winsorised pay, deflated pay, log and log1p (log of
    a non-positive value is NULL in Spark: trap 7)."""
    from epicohort.operators.link import deflate
    out = df.withColumns({
        "in_work": F.when(F.col("pay") > 0, 1).otherwise(0),
        "pay_winsor": F.when(F.col("pay") > F.lit(winsor_hi), F.lit(winsor_hi)).otherwise(F.col("pay")),
    })
    out = deflate(out, deflator, "pay_winsor")
    return out.withColumns({
        "log_pay": F.log(F.col("pay_deflated")),
        "log_pay_plus_1": F.log(F.col("pay_deflated") + 1),
    })


def value_where(df: DataFrame, id_col: str, value: str, cond, out: str) -> DataFrame:
    """The value on the row meeting ``cond``, on every row of the id (NULL
    if none): grouped aggregate joined back."""
    stats = df.groupBy(id_col).agg(F.max(F.when(cond, F.col(value))).alias(out))
    return df.join(stats, on=id_col, how="left")


def rebase(df: DataFrame, merge_bins=(-1,), unexposed_bin: int | None = None, col: str = "t_treatment_6_month",
           treat_col: str = "treat") -> DataFrame:
    """Merge pre-event bins into 0 and optionally move the unexposed to
    another bin (baseline sensitivity)."""
    c = F.col(col)
    out = df.withColumn(col, F.when(c.isin(list(merge_bins)), F.lit(0)).otherwise(c))
    if unexposed_bin is not None:
        out = out.withColumn(col, F.when(F.col(treat_col) == 0, F.lit(unexposed_bin)).otherwise(F.col(col)))
    return out
