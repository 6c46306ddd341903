"""Registered model fits (M1-M14) and their DuckDB oracles.

Variants of a model (baselines, subsets, strata) are stacked into one frame,
one label per variant, and fitted in the same passes; the stack is made by
``explode``, so the analysis stage is read once.  Rows are rounded to as many
places as two solvers agree on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.functions.columns import set_reference
from epicohort.operators.absorb import fit_absorbed
from epicohort.operators.fe import FEResult, fit_models, lr_test, natural_spline_change, with_natural_spline
from epicohort.operators.quantiles import exact_quantiles
from epicohort.operators.report import compare_models, compare_significance, significance_table
from epicohort.plans import fitsql as Q
from epicohort.plans.queries import FULL, oracle, register, study
from epicohort.sources.io import stash

BIN, SPLINE = "t_treatment_6_month", [f"age_ns{i}" for i in range(1, 6)]
#: Probabilities of the spline's knots: the boundary's of all ages, the inner ones of the ages between.
KNOTS = (0.1, 0.2, 0.4, 0.6, 0.8, 0.9)
#: The reference level of every variant, as a bin that no row has.
REFERENCE = -999
FACTORS = ("census_sex", "region", "age_bands", "imd_quintile", "ethnic_group_tb", "rural_urban")

TIDY = ("estimate", "std_error", "conf_low", "conf_high")
PLACES = {**dict.fromkeys(TIDY, 2), "statistic": 3, "p_value": 4, "value": 2, "aic": 2, "bic": 2, "lr": 2}


def settled(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES[c]).alias(c) if c in PLACES else F.col(c) for c in df.columns])


def settled_sql(cols: Sequence[str], source: str) -> str:
    return "SELECT " + ", ".join(f"round({c}, {PLACES[c]:+d}) AS {c}" if c in PLACES else c for c in cols) + f" FROM ({source}) t"


# ----------------------------------------------------------------- variants
class Variant:
    """A labelled subset of the combined rows with its treatment bins, both as SQL expressions."""

    def __init__(self, label: str, where: str = "TRUE", bins: str = BIN, reference: int = 0):
        self.label, self.where, self.bins, self.reference = label, where, bins, reference

    def struct(self) -> Column:
        own = F.expr(self.bins).cast("int")
        return F.struct(F.lit(self.label).alias("model"), F.expr(self.where).alias("_ok"),
                        F.when(own == self.reference, REFERENCE).otherwise(own).alias("_bin"))

    def sql(self, y: str, extra: str = "") -> str:
        return (f"SELECT '{self.label}|{y}' AS s, '{self.label}' AS model, census_id_final AS pid, CAST({y} AS DOUBLE) AS y, "
                f"CAST(NULLIF({self.bins}, {self.reference}) AS INTEGER) AS bin, month_label AS mon, age_monthly{extra} "
                f"FROM combined WHERE {self.where}")


MAIN = Variant("main")
IN_WORK = Variant("in_work", "in_work = 1")


def stack(df: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Rows of all variants with ``model``, the variant's bins, and its spline terms (M2)."""
    out = df.withColumn("_v", F.explode(F.array(*[v.struct() for v in variants]))).where("_v._ok")
    out = out.withColumn("model", F.col("_v.model")).withColumn(BIN, F.col("_v._bin")).drop("_v")
    # knots and spline are a matter of variant and age: each pair that occurs, with its number of rows
    ages = stash(out.where(F.col("age_monthly").isNotNull()).groupBy("model", "age_monthly").agg(F.count(F.lit(1)).alias("_rows")), "spline_ages")
    ends = {}
    for r in exact_quantiles(ages, "age_monthly", [0.1, 0.9], by=["model"], weight="_rows").collect():
        ends.setdefault(r["model"], {})[r["p"]] = r["q"]
    pick = lambda p: F.create_map(*[F.lit(x) for m, e in ends.items() for x in (m, float(e[p]))])[F.col("model")]
    inner = ages.where((F.col("age_monthly") >= pick(0.1)) & (F.col("age_monthly") <= pick(0.9)))
    for r in exact_quantiles(inner, "age_monthly", [0.2, 0.4, 0.6, 0.8], by=["model"], weight="_rows").collect():
        ends[r["model"]][r["p"]] = r["q"]
    # one row for each variant: its knots and the change of basis
    own = [(m, k, natural_spline_change(k).ravel().tolist()) for m, k in ((m, [e[p] for p in KNOTS]) for m, e in ends.items())]
    table = out.sparkSession.createDataFrame(own, "model string, _knots array<double>, _change array<double>")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    n = len(KNOTS) - 1
    change = [[at("_change", i * n + j) for j in range(n)] for i in range(n)]
    ages = ages.drop("_rows").join(F.broadcast(table), "model")
    terms = with_natural_spline(ages, "age_monthly", [at("_knots", i) for i in range(n + 1)], change, "age_ns").drop("_knots", "_change")
    return out.join(stash(terms, "spline_terms"), ["model", "age_monthly"], "left")


def fits(spark, sf_dir, variants: Sequence[Variant], outcomes: Sequence[str], controls: Sequence[str] = (),
         interact: str | None = None, spline: bool = True, month: str = "month_label", extra: dict | None = None,
         labels: dict | None = None) -> dict:
    """{(variant label, outcome): FEResult}, all in one set of passes; ``extra``
    columns are controls, ``labels`` recode factors or make month effects."""
    df = study(spark, sf_dir).combined
    cols = ["census_id_final", "month_label", "age_monthly", "in_work", "month_num", "treat", BIN, *outcomes, *controls, *FACTORS]
    df = stack(df.select(*dict.fromkeys(cols)), variants).withColumns((extra or {}) | (labels or {}))
    numeric = [*(SPLINE if spline else []), *controls, *(extra or {})]
    return fit_models(df, outcomes, {BIN: REFERENCE}, numeric, month=month, by="model",
                      interact=(BIN, interact) if interact else None)


def source_ctes(f: str, pairs: Sequence[tuple[Variant, str]], extra: str = "", more: Sequence[str] = ()) -> str:
    """CTE ``{f}`` of the rows of (variant, outcome) pairs, with the spline's columns over each pair's own knots."""
    rows = " UNION ALL ".join(v.sql(y, extra) for v, y in pairs)
    return spline_ctes(f, rows, more)


def spline_ctes(f: str, rows: str, more: Sequence[str] = ()) -> str:
    """CTE ``{f}``: ``rows`` with the spline's columns over the knots of each fit, and ``more`` columns of those."""
    cols = ", ".join([*Q.spline_sql(), *more])
    return (f"{f}_0 AS MATERIALIZED ({rows}),{Q.knots_sql(f + '_k', f + '_0')},\n"
            f"{f}_b4 AS (SELECT b.*, {', '.join(Q.b_spline_sql())} FROM {f}_0 b JOIN {f}_k k ON k.s = b.s),\n{f} AS (SELECT *, {cols} FROM {f}_b4)")


# ----------------------------------------------------------------- M1-M6, M10
def tidy_oracle(pairs, scale: str = "NULL", **kw) -> str:
    """Oracle of the tidy rows of fits: model, outcome, and the tidy columns."""
    numeric = [*SPLINE, *kw.pop("controls", ())]
    extra = kw.pop("extra", "")
    body = [source_ctes("src", pairs, extra), Q.fit_ctes("f", "src", numeric, **kw), Q.critical_ctes("f")]
    rows = f"""SELECT split_part(s, '|', 1) AS model, split_part(s, '|', 2) AS outcome, term, estimate, std_error, statistic, p_value, conf_low, conf_high
FROM ({Q.tidy_sql('f', scale)}) x"""
    return recursive(oracle(settled_sql(["model", "outcome", "term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"], rows),
                            *FULL, *body))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def tidy_rows(spark, results: dict, scales: dict | None = None) -> DataFrame:
    """model, outcome and the tidy columns of all results."""
    rows = [{"model": m, "outcome": y, **r} for (m, y), res in results.items() for r in res.rows((scales or {}).get(y))]
    return settled(spark.createDataFrame(rows, "model string, outcome string, " + FEResult.TIDY))


@register("fe_event_study", tidy_oracle([(MAIN, "pay_deflated")]))
def q_fe_event_study(spark, sf_dir):
    """M1-M4: tidy coefficients of the main event study (pay, deflated)."""
    return tidy_rows(spark, fits(spark, sf_dir, [MAIN], ["pay_deflated"]))


BIRTHS = ("birth_in_1yr", "birth_in_5yr")


@register("fe_with_births", tidy_oracle([(MAIN, "pay_deflated"), (MAIN, "in_work"), (IN_WORK, "pay_deflated")],
                                        scale="CASE WHEN c.s = 'main|in_work' THEN 'percent' END", controls=BIRTHS, extra=", birth_in_1yr, birth_in_5yr"))
def q_fe_with_births(spark, sf_dir):
    """The three main models with recent-birth controls."""
    return tidy_rows(spark, three(fits(spark, sf_dir, [MAIN, IN_WORK], ["pay_deflated", "in_work"], BIRTHS)), PERCENT)


def three(results: dict) -> dict:
    """Pay, employment, and pay in work (employment among those in work is no model)."""
    return {k: v for k, v in results.items() if not (k[0].startswith("in_work") and k[1] == "in_work")}


PERCENT = {"in_work": "percent", "log_pay": "log"}

SUITE = [(MAIN, "pay_deflated"), (MAIN, "in_work"), (IN_WORK, "pay_deflated"), (IN_WORK, "log_pay")]
SUITE_SCALE = "CASE WHEN c.s = 'main|in_work' THEN 'percent' WHEN c.s = 'in_work|log_pay' THEN 'log' END"


def suite(spark, sf_dir) -> dict:
    return study(spark, sf_dir).kept("suite", lambda: fits(spark, sf_dir, [MAIN], ["pay_deflated", "in_work"])
                                     | fits(spark, sf_dir, [IN_WORK], ["pay_deflated", "log_pay"]))


@register("fe_suite", tidy_oracle(SUITE, SUITE_SCALE))
def q_fe_suite(spark, sf_dir):
    """Pay, employment (x100), pay in work and log pay in work
    (exp(b) - 1, percent) with intervals and p-values."""
    return tidy_rows(spark, suite(spark, sf_dir), PERCENT)


STAT_COLS = ["model", "outcome", "n_obs", "n_clusters", "aic", "bic"]


def stats_rows(spark, results: dict) -> DataFrame:
    rows = [(m, y, r.n, r.n_clusters, r.aic(), r.bic()) for (m, y), r in results.items()]
    return settled(spark.createDataFrame(rows, "model string, outcome string, n_obs long, n_clusters long, aic double, bic double"))


def stats_oracle(pairs, **kw) -> str:
    rows = """SELECT split_part(s, '|', 1) AS model, split_part(s, '|', 2) AS outcome, CAST(n AS BIGINT) AS n_obs, CAST(g AS BIGINT) AS n_clusters, aic, bic FROM f_stat"""
    return recursive(oracle(settled_sql(STAT_COLS, rows), *FULL, source_ctes("src", pairs), Q.fit_ctes("f", "src", SPLINE, **kw)))


@register("fe_suite_stats", stats_oracle(SUITE))
def q_fe_suite_stats(spark, sf_dir):
    """M5: observations, clusters, AIC and BIC of the suite."""
    return stats_rows(spark, suite(spark, sf_dir))


def _significance_sql() -> str:
    stars = "CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END"
    text = f"printf('%.1f', estimate) || {stars} || ' (' || printf('%.1f', conf_low) || ', ' || printf('%.1f', conf_high) || ')'"
    return f"""SELECT term, {text} AS value FROM ({Q.tidy_sql('f')}) x
UNION ALL SELECT 'AIC', printf('%.1f', aic) FROM f_stat UNION ALL SELECT 'BIC', printf('%.1f', bic) FROM f_stat"""


@register("significance_table", recursive(oracle(_significance_sql(), *FULL, source_ctes("src", [(MAIN, "pay_deflated")]),
                                                 Q.fit_ctes("f", "src", SPLINE), Q.critical_ctes("f"))))
def q_significance_table(spark, sf_dir):
    """Estimate, stars and interval text per term, AIC/BIC rows."""
    res = fits(spark, sf_dir, [MAIN], ["pay_deflated"])["main", "pay_deflated"]
    return significance_table(res.tidy(spark), res.fit_stats())


# ----------------------------------------------------------------- M5 likelihood ratio
def _chi2_sql(x: str, dof: str) -> str:
    """Upper chi-square probability for whole degrees of freedom (finite series)."""
    terms = (f"list_sum(list_transform(range(0, CAST(({dof} + 1) // 2 AS BIGINT)), lambda j: CASE WHEN j + ({dof} % 2) / 2.0 < {dof} / 2.0 "
             f"THEN exp((j + ({dof} % 2) / 2.0) * ln({x} / 2) - {x} / 2 - lgamma(j + ({dof} % 2) / 2.0 + 1)) ELSE 0 END))")
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, CASE WHEN {dof} % 2 = 1 THEN {Q.normal_tail_sql(f'sqrt({x})')} ELSE 0 END + {terms}) END"


def _lr_sql() -> str:
    return f"""
SELECT round(lr, 2) AS lr, CAST(df AS BIGINT) AS df, round({_chi2_sql('lr', 'df')}, 4) AS p_value, round(aic_full, 2) AS aic_full,
       round(aic_restricted, 2) AS aic_restricted, round(bic_full, 2) AS bic_full, round(bic_restricted, 2) AS bic_restricted
FROM (SELECT r.deviance - f.deviance AS lr, CAST(greatest(f.kk - r.kk, 1) AS BIGINT) AS df, f.aic AS aic_full, r.aic AS aic_restricted,
             f.bic AS bic_full, r.bic AS bic_restricted FROM f_stat f, r_stat r) t"""


@register("fe_lr_test", recursive(oracle(_lr_sql(), *FULL, source_ctes("src", [(MAIN, "pay_deflated")]),
                                         Q.fit_ctes("f", "src", SPLINE), Q.fit_ctes("r", "src", []))))
def q_fe_lr_test(spark, sf_dir):
    """M5: likelihood-ratio test of the age spline (bins only vs bins + spline), with AIC/BIC."""
    full = fits(spark, sf_dir, [MAIN], ["pay_deflated"])["main", "pay_deflated"]
    less = fits(spark, sf_dir, [MAIN], ["pay_deflated"], spline=False)["main", "pay_deflated"]
    t = lr_test(less, full)
    row = [(float(t["statistic"]), int(t["df"]), float(t["p_value"]), full.aic(), less.aic(), full.bic(), less.bic())]
    out = spark.createDataFrame(row, "lr double, df long, p_value double, aic_full double, aic_restricted double, bic_full double, bic_restricted double")
    return out.select(F.round("lr", 2).alias("lr"), "df", F.round("p_value", 4).alias("p_value"),
                      *[F.round(c, 2).alias(c) for c in out.columns[3:]])


# ----------------------------------------------------------------- M9 strata
def _strata(values: Sequence[str], column: str) -> list[Variant]:
    return [Variant(v, f"{column} = '{v}'") for v in values]


def _by_stratum_sql() -> str:
    rows = (f"SELECT census_sex || '|pay_deflated' AS s, census_sex AS model, census_id_final AS pid, pay_deflated AS y, "
            f"CAST(NULLIF({BIN}, 0) AS INTEGER) AS bin, month_label AS mon, age_monthly FROM combined WHERE census_sex IS NOT NULL")
    src = spline_ctes("src", rows)
    sel = f"SELECT split_part(s, '|', 1) AS stratum, term, estimate, std_error, statistic, p_value, conf_low, conf_high FROM ({Q.tidy_sql('f')}) x"
    cols = ["stratum", "term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    return recursive(oracle(settled_sql(cols, sel), *FULL, src, Q.fit_ctes("f", "src", SPLINE), Q.critical_ctes("f")))


@register("fe_by_stratum", _by_stratum_sql())
def q_fe_by_stratum(spark, sf_dir):
    """M9: one model for each sex that occurs, in one set of passes."""
    levels = sorted(r[0] for r in study(spark, sf_dir).combined.select("census_sex").distinct().collect() if r[0] is not None)
    out = tidy_rows(spark, fits(spark, sf_dir, _strata(levels, "census_sex"), ["pay_deflated"]))
    return out.withColumnRenamed("model", "stratum").drop("outcome")


# ----------------------------------------------------------------- M7 interactions
LEVEL_COLS = ["model", "outcome", "term", "level", "estimate", "std_error", "p_value", "conf_low", "conf_high"]
THREE = [(MAIN, "pay_deflated"), (MAIN, "in_work"), (IN_WORK, "pay_deflated")]


def _interaction_oracle(by: str) -> str:
    levels = """
lv AS (SELECT DISTINCT g FROM i_r),
eff AS (
  SELECT split_part(m.s, '|', 1) AS model, split_part(m.s, '|', 2) AS outcome, m.s, m.term, lv.g AS level,
         m.estimate + CASE WHEN lv.g = (SELECT min(g) FROM lv) THEN 0 ELSE x.estimate END AS estimate,
         sqrt(v.v + CASE WHEN lv.g = (SELECT min(g) FROM lv) THEN 0 ELSE vx.v + 2 * cx.v END) AS std_error,
         lv.g = (SELECT min(g) FROM lv) AS base, x.term AS xterm
  FROM i_coef m CROSS JOIN lv
  LEFT JOIN i_coef x ON x.s = m.s AND x.kind = 'interaction' AND x.term = m.term || ':g' || lv.g
  LEFT JOIN i_cov v ON v.s = m.s AND v.i = m.ord AND v.j = m.ord
  LEFT JOIN i_cov vx ON vx.s = m.s AND vx.i = x.ord AND vx.j = x.ord
  LEFT JOIN i_cov cx ON cx.s = m.s AND cx.i = m.ord AND cx.j = x.ord
  WHERE m.kind = 'bin')"""
    scale = "CASE WHEN outcome = 'in_work' THEN 100 ELSE 1 END"
    z = "1.959963984540054"
    rows = f"""SELECT model, outcome, term, level, estimate * {scale} AS estimate, std_error * {scale} AS std_error,
       CASE WHEN estimate IS NOT NULL THEN {Q.normal_tail_sql('least(estimate / std_error, 40)')} END AS p_value,
       (estimate - {z} * std_error) * {scale} AS conf_low, (estimate + {z} * std_error) * {scale} AS conf_high
FROM eff WHERE base OR xterm IS NOT NULL"""
    body = [source_ctes("src", THREE, f", CAST({by} AS VARCHAR) AS g"), Q.fit_ctes("i", "src", SPLINE, interact="g"), levels]
    return recursive(oracle(settled_sql(LEVEL_COLS, rows), *FULL, *body))


def _interaction_lr_oracle() -> str:
    parts, body = [], []
    for by in FACTORS:
        body += [source_ctes(f"s_{by}", THREE, f", CAST({by} AS VARCHAR) AS g"), Q.fit_ctes(f"i_{by}", f"s_{by}", SPLINE, interact="g"),
                 Q.fit_ctes(f"m_{by}", f"s_{by}", SPLINE)]
        parts.append(f"SELECT '{by}' AS factor, i.s, m.deviance - i.deviance AS lr, CAST(greatest(i.kk - m.kk, 1) AS BIGINT) AS df, i.aic, i.bic "
                     f"FROM i_{by}_stat i JOIN m_{by}_stat m ON m.s = i.s")
    return recursive(oracle(f"""SELECT factor, split_part(s, '|', 1) AS model, split_part(s, '|', 2) AS outcome, round(lr, 2) AS lr, df,
  round({_chi2_sql('lr', 'df')}, 4) AS p_value, round(aic, 2) AS aic, round(bic, 2) AS bic FROM ({' UNION ALL '.join(parts)}) t""", *FULL, *body))


def interaction_fits(spark, sf_dir, by: str) -> dict:
    extra = {by: F.col(by).cast("string")}
    return study(spark, sf_dir).kept(("interaction", by), lambda: three(
        fits(spark, sf_dir, [MAIN, IN_WORK], ["pay_deflated", "in_work"], interact=by, labels=extra)))


def effects(spark, results: dict, by: str) -> DataFrame:
    rows = []
    for (m, y), res in results.items():
        unit = 100.0 if y == "in_work" else 1.0
        have = set(res.terms)
        for r in res.effects_by_level(BIN, by, res.by_levels, res.by_levels[0]):
            if r["level"] == res.by_levels[0] or f"{r['term']}:{by}{r['level']}" in have:
                rows.append({"model": m, "outcome": y, **{k: v * unit if k in TIDY and v is not None else v for k, v in r.items()}})
    return settled(spark.createDataFrame(rows, "model string, outcome string, term string, level string, estimate double, "
                                               "std_error double, p_value double, conf_low double, conf_high double").select(*LEVEL_COLS))


def _register_interaction(by: str) -> None:
    @register(f"fe_interaction_{by}", _interaction_oracle(by))
    def query(spark, sf_dir, by=by):
        return effects(spark, interaction_fits(spark, sf_dir, by), by)
    query.__doc__ = f"M7: bins interacted with {by} for pay, employment and pay in work; effect per level by the delta rule, z-based."


for _by in FACTORS:
    _register_interaction(_by)


@register("fe_interaction_lr", _interaction_lr_oracle())
def q_fe_interaction_lr(spark, sf_dir):
    """M7 M5: likelihood-ratio test of each factor's interaction against the main model on the same rows, three outcomes."""
    less, rows = main_fits_by_factor(spark, sf_dir), []
    for by in FACTORS:
        for (model, y), res in interaction_fits(spark, sf_dir, by).items():
            t = lr_test(less[f"{model}/{by}", y], res)
            rows.append((by, model, y, float(t["statistic"]), int(t["df"]), float(t["p_value"]), res.aic(), res.bic()))
    return settled(spark.createDataFrame(rows, "factor string, model string, outcome string, lr double, df long, p_value double, aic double, bic double"))


# ----------------------------------------------------------------- L14 reference levels
def _reference_oracle() -> str:
    src = source_ctes("src", [(MAIN, "pay_deflated")], ", CASE WHEN rural_urban = 'Urban' THEN '0' ELSE '1' || rural_urban END AS g")
    rows = f"""SELECT replace(term, ':g1', ':rural_urban') AS term, estimate, std_error, statistic, p_value, conf_low, conf_high
FROM ({Q.tidy_sql('f')}) x"""
    cols = ["term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    return recursive(oracle(settled_sql(cols, rows), *FULL, src, Q.fit_ctes("f", "src", SPLINE, interact="g"), Q.critical_ctes("f")))


@register("fe_reference_level", _reference_oracle())
def q_fe_reference_level(spark, sf_dir):
    """Interaction contrasts against a reference level that the column's metadata names."""
    df = set_reference(study(spark, sf_dir).combined, {"rural_urban": "Urban"})
    cols = ["census_id_final", "month_label", "age_monthly", "in_work", BIN, "pay_deflated", "rural_urban"]
    res = fit_models(stack(df.select(*cols), [MAIN]), ["pay_deflated"], {BIN: REFERENCE}, SPLINE, by="model", interact=(BIN, "rural_urban"))
    return tidy_rows(spark, res).drop("model", "outcome")


# ----------------------------------------------------------------- M8 fuller interactions
def sex_month() -> dict:
    return {"sex_month": F.concat(F.col("census_sex"), F.lit("|"), F.col("month_label"))}


def _sex_month_oracle(spline_too: bool) -> str:
    male = "CASE WHEN census_sex = 'Males' THEN 1.0 ELSE 0.0 END"
    extra = ", census_sex"
    more = []
    if spline_too:
        more = [f"({x.rsplit(' AS ', 1)[0]}) * {male} AS {x.rsplit(' AS ', 1)[1]}_x_male" for x in Q.spline_sql()]
    numeric = [*SPLINE, *[f"{c}_x_male" for c in SPLINE if spline_too]]
    src = source_ctes("src", [(MAIN, "pay_deflated")], extra, more).replace("month_label AS mon", "census_sex || '|' || month_label AS mon")
    rows = f"SELECT term, estimate, std_error, statistic, p_value, conf_low, conf_high FROM ({Q.tidy_sql('f')}) x"
    cols = ["term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    return recursive(oracle(settled_sql(cols, rows), *FULL, src, Q.fit_ctes("f", "src", numeric, interact="census_sex", month="sex_month"),
                            Q.critical_ctes("f")))


@register("fe_factor_month", _sex_month_oracle(False))
def q_fe_factor_month(spark, sf_dir):
    """M8: bins x sex interaction with sex-specific month effects absorbed."""
    res = fits(spark, sf_dir, [MAIN], ["pay_deflated"], interact="census_sex", month="sex_month", labels=sex_month())
    return tidy_rows(spark, res).drop("model", "outcome")


@register("fe_spline_interaction", _sex_month_oracle(True))
def q_fe_spline_interaction(spark, sf_dir):
    """M8: age spline interacted with sex (spline terms times the male dummy) plus
    bins x sex, with sex-specific month effects absorbed."""
    male = F.when(F.col("census_sex") == "Males", 1.0).otherwise(0.0)
    extra = {f"{c}_x_male": F.col(c) * male for c in SPLINE}
    res = fits(spark, sf_dir, [MAIN], ["pay_deflated"], interact="census_sex", month="sex_month", extra=extra, labels=sex_month())
    return tidy_rows(spark, res).drop("model", "outcome")


#: Terms of the fuller models: bins, the age spline, and the spline in each level of the factor but the first.
ALL_COLS = ["factor", "model", "outcome", "term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]


def all_interaction_fits(spark, sf_dir, by: str) -> dict:
    """Three outcomes ~ bins + spline x factor | person + factor x month, the last absorbed as cells (M8)."""
    def run():
        df = study(spark, sf_dir).combined.where(F.col(by).isNotNull()).withColumn(by, F.col(by).cast("string"))
        cols = ["census_id_final", "month_label", "age_monthly", "in_work", BIN, "pay_deflated", by]
        df = stack(df.select(*dict.fromkeys(cols)), [MAIN, IN_WORK])
        return three(fit_absorbed(df, ["pay_deflated", "in_work"], {BIN: REFERENCE}, SPLINE, [by, "month_label"], by="model", within=(SPLINE, by)))
    return study(spark, sf_dir).kept(("all_interactions", by), run)


def known_alike(spark, sf_dir) -> dict:
    """{factor: the first factor that is known on exactly the same rows}, from one aggregate."""
    differ = {(a, b): F.max((F.col(a).isNull() != F.col(b).isNull()).cast("int")) for i, b in enumerate(FACTORS) for a in FACTORS[:i]}
    row = study(spark, sf_dir).combined.agg(*[x.alias(f"{a}|{b}") for (a, b), x in differ.items()]).first()
    return {b: next((a for a in FACTORS[:i] if not row[f"{a}|{b}"]), b) for i, b in enumerate(FACTORS)}


def main_fits_by_factor(spark, sf_dir) -> dict:
    """The main model on the rows where each factor is known, three outcomes: what the interactions are tested against.
    Factors that are known on the same rows share the fit of those rows."""
    def run():
        alike = known_alike(spark, sf_dir)
        main = [v for by in dict.fromkeys(alike.values()) for v in (Variant(f"main/{by}", f"{by} IS NOT NULL"), Variant(f"in_work/{by}", f"in_work = 1 AND {by} IS NOT NULL"))]
        done = three(fits(spark, sf_dir, main, ["pay_deflated", "in_work"]))
        return {(label.replace(f"/{first}", f"/{by}"), y): res for by, first in alike.items() for (label, y), res in done.items() if label.endswith(f"/{first}")}
    return study(spark, sf_dir).kept("main_by_factor", run)


#: Every level that a factor can have; the first of those that a table holds is the reference.
ALL_LEVELS = {"census_sex": ("Females", "Males"), "rural_urban": ("Error", "Rural", "Urban"), "imd_quintile": ("1", "2", "3", "4", "5"),
              "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
              "age_bands": ("25-34", "35-44", "45-54", "55-64", "Missing or not stated"),
              "ethnic_group_tb": ("Asian", "Black", "Missing or not stated", "Mixed", "Other", "White")}


def _all_source(f: str, by: str, pairs=THREE) -> tuple[str, list[str]]:
    """CTE of the fuller model's rows (months as factor|month), and its numeric columns: the spline in each level but
    the least, zero where a table lacks the level."""
    more, names = [], []
    for i, lv in enumerate(ALL_LEVELS[by]):
        for x in Q.spline_sql():
            expr, name = x.rsplit(" AS ", 1)
            names.append(f"{name}_x{i}")
            more.append(f"({expr}) * CASE WHEN g = '{lv}' AND g <> (SELECT min(g) FROM {f}_0) THEN 1.0 ELSE 0.0 END AS {names[-1]}")
    src = source_ctes(f, pairs, f", CAST({by} AS VARCHAR) AS g", more)
    return src.replace("month_label AS mon", f"CAST({by} AS VARCHAR) || '|' || month_label AS mon").replace(
        "FROM combined WHERE TRUE", f"FROM combined WHERE {by} IS NOT NULL").replace("FROM combined WHERE in_work = 1", f"FROM combined WHERE in_work = 1 AND {by} IS NOT NULL"), names


def _all_oracle(by: str) -> str:
    levels = ALL_LEVELS[by]
    src, names = _all_source("src", by)
    named = [(n, n.rsplit("_x", 1)[0], levels[int(n.rsplit("_x", 1)[1])]) for n in names]
    terms = "CASE term " + " ".join(f"WHEN '{n}' THEN '{c}:{by}{lv}'" for n, c, lv in named) + " ELSE term END"
    absent = " OR ".join(f"(term IN ({', '.join(repr(n) for n, _, own in named if own == lv)}) AND ('{lv}' NOT IN (SELECT g FROM src_0) "
                         f"OR '{lv}' = (SELECT min(g) FROM src_0)))" for lv in levels)
    rows = f"""SELECT '{by}' AS factor, split_part(s, '|', 1) AS model, split_part(s, '|', 2) AS outcome, {terms} AS term, estimate, std_error,
       statistic, p_value, conf_low, conf_high FROM ({Q.tidy_sql('f')}) x WHERE NOT ({absent})"""
    return recursive(oracle(settled_sql(ALL_COLS, rows), *FULL, src, Q.fit_ctes("f", "src", [*SPLINE, *names], month="cell", month_first=True), Q.critical_ctes("f")))


#: In the models by age band a spline term within a band is collinear up to rounding, and the two solvers
#: decide differently on it: no SQL there.
ALL_IN_SQL = tuple(by for by in FACTORS if by != "age_bands")


def _all_lr_oracle() -> str:
    parts, body = [], []
    for by in ALL_IN_SQL:
        src, names = _all_source(f"s_{by}", by)
        main = source_ctes(f"r_{by}", THREE, f", CAST({by} AS VARCHAR) AS g").replace("WHERE TRUE", f"WHERE {by} IS NOT NULL").replace(
            "WHERE in_work = 1", f"WHERE in_work = 1 AND {by} IS NOT NULL")
        body += [src, Q.fit_ctes(f"i_{by}", f"s_{by}", [*SPLINE, *names], month="cell", month_first=True), main, Q.fit_ctes(f"m_{by}", f"r_{by}", SPLINE)]
        parts.append(f"SELECT '{by}' AS factor, i.s, m.deviance - i.deviance AS lr, CAST(greatest(i.kk - m.kk, 1) AS BIGINT) AS df, i.aic, i.bic "
                     f"FROM i_{by}_stat i JOIN m_{by}_stat m ON m.s = i.s")
    return recursive(oracle(f"""SELECT factor, split_part(s, '|', 1) AS model, split_part(s, '|', 2) AS outcome, round(lr, 2) AS lr, df,
  round({_chi2_sql('lr', 'df')}, 4) AS p_value, round(aic, 2) AS aic, round(bic, 2) AS bic FROM ({' UNION ALL '.join(parts)}) t""", *FULL, *body))


def _register_all_interactions(by: str) -> None:
    @register(f"fe_all_interactions_{by}", _all_oracle(by) if by in ALL_IN_SQL else None)
    def query(spark, sf_dir, by=by):
        rows = [{"factor": by, "model": m, "outcome": y, **r} for (m, y), res in all_interaction_fits(spark, sf_dir, by).items() for r in res.rows()]
        return settled(spark.createDataFrame(rows, "factor string, model string, outcome string, " + FEResult.TIDY))
    query.__doc__ = f"M8: age spline interacted with {by} and {by}-specific month effects absorbed, for pay, employment and pay in work."


for _by in FACTORS:
    _register_all_interactions(_by)


def _all_lr(spark, sf_dir, factors: Sequence[str]) -> DataFrame:
    less, rows = main_fits_by_factor(spark, sf_dir), []
    for by in factors:
        for (model, y), res in all_interaction_fits(spark, sf_dir, by).items():
            t = lr_test(less[f"{model}/{by}", y], res)
            rows.append((by, model, y, float(t["statistic"]), int(t["df"]), float(t["p_value"]), res.aic(), res.bic()))
    return settled(spark.createDataFrame(rows, "factor string, model string, outcome string, lr double, df long, p_value double, aic double, bic double"))


@register("fe_all_interactions_lr", _all_lr_oracle())
def q_fe_all_interactions_lr(spark, sf_dir):
    """M8 M5: likelihood-ratio test of each factor's fuller model against the main model on the same rows, three outcomes."""
    return _all_lr(spark, sf_dir, ALL_IN_SQL)


@register("fe_all_interactions_lr_age_bands")
def q_fe_all_interactions_lr_age_bands(spark, sf_dir):
    """M8 M5: the same test for the models by age band."""
    return _all_lr(spark, sf_dir, ["age_bands"])


# ----------------------------------------------------------------- M14 sensitivity
def _merged(bins: Sequence[int]) -> dict:
    return {"bins": f"CASE WHEN {BIN} IN ({', '.join(map(str, bins))}) THEN 0 ELSE {BIN} END"}


def _moved(b: int) -> dict:
    return {"bins": f"CASE WHEN treat = 0 THEN {b} ELSE {BIN} END", "reference": b}


def sensitivity_variants() -> list[Variant]:
    """Baselines of 12 and 24 months, baselines 6, 12 and 24 months earlier,
    and the months before index 72; each over all rows and over those in work."""
    kinds = {"baseline_12m": _merged((-1,)), "baseline_24m": _merged((-1, -2, -3)), "timing_6m": _moved(-1), "timing_12m": _moved(-2),
             "timing_24m": _moved(-4), "before_month_72": {"where": "month_num < 72"}}
    out = []
    for name, kind in kinds.items():
        out.append(Variant(name, **kind))
        out.append(Variant("in_work_" + name, **kind | {"where": kind.get("where", "TRUE") + " AND in_work = 1"}))
    return out


SENSITIVITY = [(v, y) for v in sensitivity_variants() for y in ("pay_deflated", "in_work")
               if not (v.label.startswith("in_work") and y == "in_work")]


def sensitivity_fits(spark, sf_dir) -> dict:
    """All 18 fits in one set of passes."""
    return study(spark, sf_dir).kept("sensitivity", lambda: three(fits(spark, sf_dir, sensitivity_variants(), ["pay_deflated", "in_work"])))


@register("sensitivity", tidy_oracle(SENSITIVITY, "CASE WHEN c.s LIKE '%|in_work' THEN 'percent' END"))
def q_sensitivity(spark, sf_dir):
    """The 18 sensitivity fits, tidy."""
    return tidy_rows(spark, sensitivity_fits(spark, sf_dir), PERCENT)


@register("sensitivity_stats", stats_oracle(SENSITIVITY))
def q_sensitivity_stats(spark, sf_dir):
    """Observations, clusters, AIC and BIC of the 18 sensitivity fits."""
    return stats_rows(spark, sensitivity_fits(spark, sf_dir))


COMPARED = [(MAIN, "pay_deflated"), *[(v, "pay_deflated") for v in sensitivity_variants() if not v.label.startswith("in_work")]]


def _comparison_sql() -> str:
    cols = ", ".join(f"round(max(CASE WHEN s = '{v.label}|{y}' THEN estimate END), 2) AS {v.label}" for v, y in COMPARED)
    return recursive(oracle(f"SELECT term, {cols} FROM f_coef GROUP BY term", *FULL, source_ctes("src", COMPARED), Q.fit_ctes("f", "src", SPLINE)))


@register("model_comparison", _comparison_sql())
def q_model_comparison(spark, sf_dir):
    """Pay estimates of the main model and its sensitivity variants side by side."""
    results = fits(spark, sf_dir, [v for v, _ in COMPARED], ["pay_deflated"])
    out = compare_models({m: res.tidy(spark) for (m, _), res in results.items()})
    return out.select("term", *[F.round(v.label, 2).alias(v.label) for v, _ in COMPARED])


def _text_sql(scale: str) -> str:
    """Rows (s, term, value) of the text tables of all fits of ``f``."""
    stars = "CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END"
    text = f"printf('%.1f', estimate) || {stars} || ' (' || printf('%.1f', conf_low) || ', ' || printf('%.1f', conf_high) || ')'"
    return f"""SELECT s, term, {text} AS value FROM ({Q.tidy_sql('f', scale)}) x
UNION ALL SELECT s, 'AIC', printf('%.1f', aic) FROM f_stat UNION ALL SELECT s, 'BIC', printf('%.1f', bic) FROM f_stat"""


PERCENT_SCALE = "CASE WHEN c.s LIKE '%|in_work' THEN 'percent' END"
SIDE_BY_SIDE = [*THREE, *SENSITIVITY]


def _side_by_side_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN s = '{v.label}|{y}' THEN value END) AS {v.label}_{y}" for v, y in SIDE_BY_SIDE)
    return recursive(oracle(f"SELECT term, {cols} FROM ({_text_sql(PERCENT_SCALE)}) t GROUP BY term", *FULL, source_ctes("src", SIDE_BY_SIDE),
                            Q.fit_ctes("f", "src", SPLINE), Q.critical_ctes("f")))


@register("model_comparison_text", _side_by_side_sql())
def q_model_comparison_text(spark, sf_dir):
    """The main models and all sensitivity variants side by side, as text with stars and intervals, and AIC and BIC rows."""
    results = three(fits(spark, sf_dir, [MAIN, IN_WORK], ["pay_deflated", "in_work"])) | sensitivity_fits(spark, sf_dir)
    models = {f"{v.label}_{y}": (results[v.label, y].tidy(spark, PERCENT.get(y)), results[v.label, y].fit_stats()) for v, y in SIDE_BY_SIDE}
    return compare_significance(models)
