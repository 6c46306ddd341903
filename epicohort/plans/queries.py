"""Registered queries: each is (spark, sf_dir) -> DataFrame plus, where SQL
can express it, the DuckDB oracle text over the same parquet tables.

Every query reads the driver's tables through the fixture derivations and
runs the library's operators over the whole tables.  Doubles are rounded to
4 places and counts are BIGINT on both sides so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epicohort.config import FIXTURE_CONFIG as CFG
from epicohort.functions.recode import age_bands, five_year_bands
from epicohort.operators import cohort as C
from epicohort.operators import link as L
from epicohort.operators import panel as P
from epicohort.operators import sample as S
from epicohort.plans import sqlgen as G
from epicohort.plans.study import STRATA, Study
from epicohort.sources.fixtures import DRIVER_TABLES, FixtureTables, oracle_ctes
from epicohort.sources.io import input_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_STUDIES: dict = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """One study per (session, input folder) and state of the input's files; its finished stages
    are tables in the session's checkpoint folder, reused by every query of the same study.  Where
    files have changed a new study begins; frames of the old one stay readable."""
    key, state = (spark.sparkContext.applicationId, sf_dir), input_state(spark, [f"{sf_dir}/{t}.parquet" for t in DRIVER_TABLES])
    if key not in _STUDIES or _STUDIES[key][0] != state:
        _STUDIES[key] = (state, Study(FixtureTables(spark, sf_dir), CFG, allow_short=True))
    return _STUDIES[key][1]


# Averages of cent amounts over a few rows often end exactly on a rounding
# tie, where the last bit of a floating sum decides the digit.  Both engines
# scale by (1 + 1e-12) before rounding, which settles true ties upwards and
# moves no other value across a 4-place boundary.
NUDGE = 1e-12


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double column (oracle convention, tie-safe)."""
    return df.select(*[F.round(F.col(f.name) * F.lit(1 + NUDGE), places).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _nudge_rounds(sql: str) -> str:
    """Rewrite ``round(x, 4)`` as ``round((x) * (1 + 1e-12), 4)`` (balanced parentheses)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth, comma = j + 6, 1, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, arg = sql[j + 6:comma], sql[comma + 1:k - 1].strip()
        if arg in ("1", "4"):
            out.append(sql[i:j] + f"round(({_nudge_rounds(inner)}) * (1 + {NUDGE}), {arg})")
        else:
            out.append(sql[i:k])
        i = k


def oracle(select_sql: str, *parts: str) -> str:
    body = ",\n".join([oracle_ctes()] + [p.strip().rstrip(",") for p in parts if p])
    return _nudge_rounds(f"WITH {body}\n{select_sql}")


FLAGGED = G.flagged_ctes(CFG)
DIST = G.distribution_ctes(CFG)
REG = G.registry_ctes()
LINK_E = G.linked_ctes("exposed", CFG)
LINK_U = G.linked_ctes("unexposed_dated", CFG)
PANEL_E = G.panel_ctes("exposed", CFG)
ALL = [FLAGGED, DIST, REG, LINK_E, LINK_U, PANEL_E]


# ------------------------------------------------------------------ stage 1a
@register("code_flags", oracle("""
SELECT epikey, census_id_final, census_id_flag, primary_obesity_flag, secondary_obesity_flag,
       associated_cond_flag, metabolic_op_flag FROM flagged""", FLAGGED))
def q_code_flags(spark, sf_dir):
    """Episode flags over every episode."""
    return study(spark, sf_dir).flagged.select(
        "epikey", "census_id_final", "census_id_flag", "primary_obesity_flag", "secondary_obesity_flag",
        "associated_cond_flag", "metabolic_op_flag")


@register("first_code_and_date", oracle(f"""
SELECT epikey, {G.listed_slots(CFG)}[1][1] AS op_code, {G.listed_slots(CFG)}[1][2] AS op_date, lk.Name AS operation_type
FROM flagged f LEFT JOIN proc_lookup lk ON lk.Code = {G.listed_slots(CFG)}[1][1]
WHERE metabolic_op_flag = 1""", FLAGGED))
def q_first_code(spark, sf_dir):
    """First listed procedure code, its date and type, for every procedure episode."""
    s = study(spark, sf_dir)
    return C.procedure_type(s.flagged.where(F.col("metabolic_op_flag") == 1), CFG).select(
        "epikey", "op_code", "op_date", "operation_type")


@register("slot_columns", oracle(f"""
SELECT epikey, primary_obesity_flag, secondary_obesity_flag, associated_cond_flag, metabolic_op_flag,
       {G.listed_slots(CFG)}[1][1] AS op_code, {G.listed_slots(CFG)}[1][2] AS op_date FROM flagged""", FLAGGED))
def q_slot_columns(spark, sf_dir):
    """P1-P5 on the wide form: flags, first listed code and its date from numbered slot columns."""
    wide = C.with_first_procedure(C.flag_episodes(study(spark, sf_dir).t.table("episodes"), CFG), CFG)
    return wide.select("epikey", "primary_obesity_flag", "secondary_obesity_flag", "associated_cond_flag", "metabolic_op_flag", "op_code", "op_date")


@register("person_any_flag", oracle("""
SELECT epikey, census_id_final, previous_surgery, surgery_in_follow_up, any_prev_metab_surgery_flag,
       any_metabolic_op_flag_in_dates FROM flagged""", FLAGGED))
def q_person_any_flag(spark, sf_dir):
    """Before-window / in-window flags per episode and per person."""
    return study(spark, sf_dir).flagged.select(
        "epikey", "census_id_final", "previous_surgery", "surgery_in_follow_up",
        "any_prev_metab_surgery_flag", "any_metabolic_op_flag_in_dates")


def _flow_sql() -> str:
    s, e = G.d(CFG.follow_up_start), G.d(CFG.follow_up_end)
    conds = [
        "TRUE",
        "census_id_final IS NOT NULL",
        f"epistart >= {s} AND {CFG.in_window_end_col} < {e} AND epiend > {G.d(CFG.episode_end_guard)}",
        "metabolic_op_flag = 1",
        "any_prev_metab_surgery_flag = 0",
        "(primary_obesity_flag = 1 OR (secondary_obesity_flag = 1 AND associated_cond_flag = 1))",
    ]
    labels = ["all episodes", "episodes with a person id", "episodes in follow-up",
              "procedure episodes in follow-up", "without earlier procedure", "with qualifying diagnosis"]
    parts = []
    for k in range(len(conds)):
        where = " AND ".join(f"({c})" for c in conds[:k + 1])
        parts.append(
            f"SELECT CAST({k + 1} AS INTEGER) AS step, '{labels[k]}' AS stage, CAST(count(*) AS BIGINT) AS n_rows, "
            f"CAST(count(DISTINCT census_id_final) + max(CASE WHEN census_id_final IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
            f" AS n_ids FROM flagged WHERE {where}")
    parts.append("SELECT CAST(7 AS INTEGER), 'index episode per person', CAST(count(*) AS BIGINT), "
                 "CAST(count(DISTINCT census_id_final) AS BIGINT) FROM exposed")
    return "\nUNION ALL\n".join(parts)


@register("sample_flow", oracle(_flow_sql(), FLAGGED))
def q_sample_flow(spark, sf_dir):
    """Rows and people after each exposure filter, one aggregate for the nested filters."""
    return study(spark, sf_dir).exposure_flow()


@register("index_event", oracle("""
SELECT census_id_final, census_id_flag, epikey, epistart, epiend, op_code, operation_type, op_date FROM exposed""",
                                FLAGGED))
def q_index_event(spark, sf_dir):
    """One index episode per exposed person."""
    return study(spark, sf_dir).exposed.select(
        "census_id_final", "census_id_flag", "epikey", "epistart", "epiend", "op_code", "operation_type", "op_date")


@register("cohort_exclusion", oracle("SELECT census_id_final, census_id_flag FROM unexposed", FLAGGED))
def q_cohort_exclusion(spark, sf_dir):
    """Registry people with no procedure before or inside the window (anti join)."""
    return study(spark, sf_dir).unexposed


@register("unexposed_flow", oracle("""
SELECT CAST(1 AS INTEGER) AS step, 'registry people' AS stage, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT r.il4_person_id) AS BIGINT) AS n_ids FROM registry_2011 r
UNION ALL
SELECT 2, 'no procedure in follow-up', count(*), count(DISTINCT r.il4_person_id)
FROM registry_2011 r LEFT JOIN psurg s ON s.census_id_final = r.il4_person_id WHERE coalesce(s.ai, 0) = 0
UNION ALL
SELECT 3, 'no earlier procedure', count(*), count(DISTINCT r.il4_person_id)
FROM registry_2011 r LEFT JOIN psurg s ON s.census_id_final = r.il4_person_id
WHERE coalesce(s.ai, 0) = 0 AND coalesce(s.ap, 0) = 0""", FLAGGED))
def q_unexposed_flow(spark, sf_dir):
    """Flow of the never-exposed population."""
    return study(spark, sf_dir).unexposed_flow()


@register("sentinel_impute", oracle(f"""
SELECT epikey, op_date0 AS op_date_raw, op_date,
       CASE WHEN op_date0 < {G.d(CFG.sentinel_cutoff)} THEN 1 ELSE 0 END AS imputed FROM proc2""", FLAGGED))
def q_sentinel_impute(spark, sf_dir):
    """Procedure dates before the cutoff take the episode start."""
    s = study(spark, sf_dir)
    pe = s.procedure_episodes
    return pe.select("epikey", F.col("op_date").alias("op_date_raw"),
                     C.impute_sentinel("op_date", CFG.sentinel_cutoff, "epistart").alias("op_date"),
                     F.when(F.col("op_date") < F.lit(CFG.sentinel_cutoff), 1).otherwise(0).alias("imputed"))


@register("day_gap_distribution", oracle("""
SELECT CAST(datediff('day', epistart, op_date0) AS INTEGER) AS diff_op_epistart, CAST(count(*) AS BIGINT) AS n
FROM proc2 GROUP BY datediff('day', epistart, op_date0)""", FLAGGED))
def q_day_gap(spark, sf_dir):
    """A22 + A1: days from episode start to the raw procedure date, counted."""
    pe = study(spark, sf_dir).procedure_episodes
    return (pe.groupBy(F.datediff(F.col("op_date"), F.col("epistart")).alias("diff_op_epistart"))
              .agg(F.count(F.lit(1)).alias("n")))


@register("date_ranges", oracle(f"""
SELECT min(epiend) AS min_epiend, max(epiend) AS max_epiend, min(epistart) AS min_epistart, max(epistart) AS max_epistart
FROM flagged WHERE census_id_final IS NOT NULL AND epistart >= {G.d(CFG.follow_up_start)}
  AND {CFG.in_window_end_col} < {G.d(CFG.follow_up_end)} AND epiend > {G.d(CFG.episode_end_guard)}""", FLAGGED))
def q_date_ranges(spark, sf_dir):
    """Global date range of the in-window episodes."""
    s = study(spark, sf_dir)
    w = C.in_window(s.flagged.where(F.col("census_id_final").isNotNull()), CFG)
    return w.agg(F.min("epiend").alias("min_epiend"), F.max("epiend").alias("max_epiend"),
                 F.min("epistart").alias("min_epistart"), F.max("epistart").alias("max_epistart"))


# ------------------------------------------------------------------ stage 1b
@register("month_distribution", oracle("""
SELECT CAST(op_month AS INTEGER) AS op_month, CAST(op_count AS BIGINT) AS op_count, round(op_count_smooth, 4) AS op_count_smooth,
       round(min_cum_prop, 4) AS min_cum_prop, round(max_cum_prop, 4) AS max_cum_prop FROM dist""", FLAGGED, DIST))
def q_month_distribution(spark, sf_dir):
    """Event-month counts, rolling mean, cumulative shares."""
    return rounded(study(spark, sf_dir).distribution)


@register("smoothing_long", oracle("""
SELECT CAST(op_month AS INTEGER) AS op_month, 'op_count' AS line, round(CAST(op_count AS DOUBLE), 4) AS n_op FROM dist
UNION ALL SELECT CAST(op_month AS INTEGER), 'op_count_smooth', round(op_count_smooth, 4) FROM dist""", FLAGGED, DIST))
def q_smoothing_long(spark, sf_dir):
    """X1 long form (raw and smoothed counts) via unpivot."""
    return rounded(S.smoothing_long(study(spark, sf_dir).distribution))


@register("assigned_dates", oracle("""
SELECT census_id_final, CAST(op_month AS INTEGER) AS op_month, op_date FROM unexposed_dated""", FLAGGED, DIST))
def q_assigned_dates(spark, sf_dir):
    """Deterministic draw -> month bin (range join on cumulative shares) -> the 15th."""
    return study(spark, sf_dir).unexposed_dated.select("census_id_final", "op_month", "op_date")


@register("distribution_check", oracle(f"""
SELECT dataset, CAST(op_month AS INTEGER) AS op_month, CAST(n_people AS BIGINT) AS n_people,
       round(n_people / sum(n_people) OVER (PARTITION BY dataset), 4) AS prop_people
FROM (SELECT dataset, m AS op_month, count(*) AS n_people
      FROM (SELECT 'exposed' AS dataset, {G.month_no('op_date')} - {G.month_no(G.d(CFG.origin))} AS m FROM exposed
            UNION ALL
            SELECT 'unexposed', {G.month_no('op_date')} - {G.month_no(G.d(CFG.origin))} FROM unexposed_dated) a
      GROUP BY dataset, m) t""", FLAGGED, DIST))
def q_distribution_check(spark, sf_dir):
    """Share of people per event month in both cohorts, labelled and stacked."""
    s = study(spark, sf_dir)
    return rounded(S.month_shares(s.exposed, CFG, "exposed").unionByName(
        S.month_shares(s.unexposed_dated, CFG, "unexposed")))


# ------------------------------------------------------------------ stage 1c
@register("code_recode", oracle(f"""
SELECT census_id_final, census_id_flag, {", ".join(G.REG_ATTRS)} FROM regs""", REG))
def q_code_recode(spark, sf_dir):
    """Quality filters, both waves' recodes and quarter birth dates, whole registries."""
    routes = study(spark, sf_dir).registry_routes
    return L.tag_routes(routes).select("census_id_final", "census_id_flag", *G.REG_ATTRS)


@register("two_route_link", oracle(f"""
SELECT census_id_final, census_id_flag, epikey, {", ".join(G.REG_ATTRS)}, dod FROM exposed_l2""",
                                   FLAGGED, REG, LINK_E))
def q_two_route_link(spark, sf_dir):
    """Exposed people linked to the registry of their id's
    route (inner) and to the earliest death of that route (left)."""
    s = study(spark, sf_dir)
    df = L.link_two_route(s.exposed, s.registry_routes, "inner")
    df = L.link_two_route(df, L.death_routes(s.deaths), "left")
    return df.select("census_id_final", "census_id_flag", "epikey", *G.REG_ATTRS, "dod")


@register("earliest_event", oracle("SELECT census_id_final, census_id_flag, dod FROM dth", REG))
def q_earliest_event(spark, sf_dir):
    """Union of death sources, earliest death per id and route."""
    routes = L.death_routes(study(spark, sf_dir).deaths)
    return L.tag_routes(routes).select("census_id_final", "census_id_flag", "dod")


_GEO_COLS = ["census_id_final", "census_id_flag", "lsoa_final", "imd_decile", "imd_quintile", "ruc11cd", "ruc11",
             "rural_urban", "region"]


@register("geo_enrich", oracle(f"SELECT {', '.join(_GEO_COLS)} FROM exposed_l5", FLAGGED, REG, LINK_E))
def q_geo_enrich(spark, sf_dir):
    """Area crosswalk (fan-out), England filter, area lookups and regex class."""
    return study(spark, sf_dir).linked_areas(study(spark, sf_dir).exposed).select(*_GEO_COLS)


@register("crosswalk_fanout", oracle("""
SELECT CAST(census_id_flag AS INTEGER) AS census_id_flag, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT census_id_final) AS BIGINT) AS n_ids
FROM exposed_l3 GROUP BY census_id_flag""", FLAGGED, REG, LINK_E))
def q_crosswalk_fanout(spark, sf_dir):
    """Rows against people after the one-to-many crosswalk, per route."""
    s = study(spark, sf_dir)
    df = L.link_two_route(s.exposed, s.registry_routes, "inner")
    df = L.crosswalk(L.link_two_route(df, L.death_routes(s.deaths), "left"), s.t.crosswalk)
    return df.groupBy(F.col("census_id_flag").cast("int").alias("census_id_flag")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("census_id_final").alias("n_ids"))


def _bands_sql(x: str) -> str:
    from epicohort.functions import recode as R
    return f"""
SELECT census_id_final, census_id_flag, op_date, prov_dob, age_at_operation, age_on_last_day_op_month,
       {G.ranges_sql('age_at_operation', R.TEN_YEAR_BANDS, R.TEN_YEAR_DEFAULT, half_open=True)} AS age_bands,
       {G.ranges_sql('age_at_operation', R.FIVE_YEAR_BANDS, None, half_open=True)} AS five_year_bands,
       {G.ranges_sql('age_at_operation', R.FIVE_YEAR_LOW_TAIL + R.FIVE_YEAR_BANDS + R.FIVE_YEAR_HIGH_TAIL, None,
                     half_open=True)} AS five_year_bands_tails
FROM {x}"""


@register("age_bands", oracle(_bands_sql("unexposed_dated_l6"), FLAGGED, DIST, REG, LINK_U))
def q_age_bands(spark, sf_dir):
    """Ages on the index date and month end, ten- and five-year bands (before the age filter)."""
    s = study(spark, sf_dir)
    df = L.add_index_ages(s.linked_areas(s.unexposed_dated))
    a = F.col("age_at_operation")
    return df.select("census_id_final", "census_id_flag", "op_date", "prov_dob", "age_at_operation",
                     "age_on_last_day_op_month", age_bands(a).alias("age_bands"),
                     five_year_bands(a).alias("five_year_bands"),
                     five_year_bands(a, tails=True).alias("five_year_bands_tails"))


_LINK_COLS = ["census_id_final", "census_id_flag", "op_date", "age_at_operation", "age_on_last_day_op_month",
              "dod", "lsoa_final", "region", "rural_urban", "imd_quintile", "census_sex"]


OWN_AREA = """
own_area AS (
  SELECT *, CASE WHEN epikey % 3 = 0 THEN 'E0' || lpad(CAST(epikey % 25 AS VARCHAR), 3, '0') WHEN epikey % 3 = 1 THEN 'W0001' END AS lsoa11 FROM exposed)"""


@register("area_precedence", oracle("""
SELECT epikey, census_id_final, lsoa11, lsoa_census, lsoa_final, imd_decile, rural_urban, region FROM own_area_l5""",
                                    FLAGGED, REG, OWN_AREA, G.linked_ctes("own_area", CFG, own_area=True)))
def q_area_precedence(spark, sf_dir):
    """The episode's own area code, where it has one, goes before the registry's."""
    s = study(spark, sf_dir)
    own = F.when(F.col("epikey") % 3 == 0, F.concat(F.lit("E0"), F.lpad((F.col("epikey") % 25).cast("string"), 3, "0"))) \
        .when(F.col("epikey") % 3 == 1, F.lit("W0001"))
    return s.linked_areas(s.exposed.withColumn("lsoa11", own)).select(
        "epikey", "census_id_final", "lsoa11", "lsoa_census", "lsoa_final", "imd_decile", "rural_urban", "region")


@register("linked_exposed", oracle(f"SELECT {', '.join(_LINK_COLS)} FROM exposed_linked", FLAGGED, REG, LINK_E))
def q_linked_exposed(spark, sf_dir):
    """Stage 1c for the exposed: linkage, P14 working age on two dates, P15 alive after the index month."""
    return study(spark, sf_dir).exposed_linked.select(*_LINK_COLS)


@register("linked_unexposed", oracle(f"SELECT {', '.join(_LINK_COLS)} FROM unexposed_dated_linked",
                                     FLAGGED, DIST, REG, LINK_U))
def q_linked_unexposed(spark, sf_dir):
    """Stage 1c for the unexposed with drawn dates."""
    return study(spark, sf_dir).unexposed_linked.select(*_LINK_COLS)


# ------------------------------------------------------------------ stage 1d
def _strata_sql() -> str:
    from epicohort.functions import recode as R
    b5 = G.ranges_sql("age_at_operation", R.FIVE_YEAR_BANDS, None, half_open=True)
    return f"""
shares AS (
  SELECT census_sex, five_year_bands, n, n / sum(n) OVER () AS prop
  FROM (SELECT census_sex, {b5} AS five_year_bands, count(*) AS n FROM exposed_linked
        GROUP BY census_sex, {b5}) t)"""


SHARES = _strata_sql()


@register("strata_shares", oracle("""
SELECT census_sex, five_year_bands, CAST(n AS BIGINT) AS n, round(prop, 4) AS prop FROM shares""",
                                  FLAGGED, REG, LINK_E, SHARES))
def q_strata_shares(spark, sf_dir):
    """Exposed people per sex x five-year band and their share."""
    return rounded(study(spark, sf_dir).shares)


SAMPLE_TOTAL = CFG.sample_total


def _sample_sql(total: int) -> str:
    from epicohort.functions import recode as R
    from epicohort.functions.draws import duckdb_draw
    b5t = G.ranges_sql("age_at_operation", R.FIVE_YEAR_LOW_TAIL + R.FIVE_YEAR_BANDS + R.FIVE_YEAR_HIGH_TAIL, None,
                       half_open=True)
    return f"""
SELECT census_id_final, census_sex, five_year_bands, op_date
FROM (SELECT u.*, {b5t} AS five_year_bands, {duckdb_draw('census_id_final', CFG.seed)} AS u_draw
      FROM unexposed_dated_linked u) p
JOIN (SELECT census_sex, five_year_bands, CAST(round({total} * prop) AS BIGINT) AS n_wanted FROM shares) s
  USING (census_sex, five_year_bands)
QUALIFY row_number() OVER (PARTITION BY census_sex, five_year_bands ORDER BY u_draw, census_id_final) <= n_wanted"""


@register("stratified_sample", oracle(_sample_sql(SAMPLE_TOTAL), FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES))
def q_stratified_sample(spark, sf_dir):
    """Exact-size matched sample of the unexposed by sex x band (strata joined by key)."""
    s = study(spark, sf_dir)
    pop = s.unexposed_linked.withColumn("five_year_bands", five_year_bands(F.col("age_at_operation"), tails=True))
    targets = S.stratum_targets(s.shares, SAMPLE_TOTAL)
    return S.stratified_sample(pop, targets, STRATA, CFG.seed, check=False).select(
        "census_id_final", "census_sex", "five_year_bands", "op_date")


def _shortfall_sql(total: int) -> str:
    from epicohort.functions import recode as R
    b5t = G.ranges_sql("age_at_operation", R.FIVE_YEAR_LOW_TAIL + R.FIVE_YEAR_BANDS + R.FIVE_YEAR_HIGH_TAIL, None,
                       half_open=True)
    return f"""
SELECT s.census_sex, s.five_year_bands, s.n_wanted, coalesce(p.n, 0) AS n_available, greatest(s.n_wanted - coalesce(p.n, 0), 0) AS n_missing
FROM (SELECT census_sex, five_year_bands, CAST(round({total} * prop) AS BIGINT) AS n_wanted FROM shares) s
LEFT JOIN (SELECT census_sex, {b5t} AS five_year_bands, count(*) AS n FROM unexposed_dated_linked GROUP BY ALL) p
  ON p.census_sex = s.census_sex AND p.five_year_bands = s.five_year_bands"""


@register("sample_shortfall", oracle(_shortfall_sql(SAMPLE_TOTAL), FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES))
def q_sample_shortfall(spark, sf_dir):
    """People wanted, available and missing per stratum; a ``Study`` raises on any missing unless told not to."""
    return study(spark, sf_dir).shortfall()


def _fitting_sql(total: int) -> str:
    from epicohort.functions import recode as R
    b5t = G.ranges_sql("age_at_operation", R.FIVE_YEAR_LOW_TAIL + R.FIVE_YEAR_BANDS + R.FIVE_YEAR_HIGH_TAIL, None,
                       half_open=True)
    return f"""
u_banded AS (SELECT u.*, {b5t} AS five_year_bands FROM unexposed_dated_linked u),
support AS (
  SELECT s.census_sex, s.five_year_bands, CAST(s.n AS BIGINT) AS n, p.a, CAST(sum(s.n) OVER () AS BIGINT) AS s_all
  FROM shares s JOIN (SELECT census_sex, five_year_bands, count(*) AS a FROM u_banded GROUP BY ALL) p
    ON p.census_sex = s.census_sex AND p.five_year_bands = s.five_year_bands),
fitting AS (
  SELECT census_sex, five_year_bands, a AS n_available, total, (2 * total * n + s_all) // (2 * s_all) AS n_wanted
  FROM (SELECT *, least({total}, min(((2 * a + 1) * s_all - 1) // (2 * n)) OVER ()) AS total FROM support) t)"""


FITTING = _fitting_sql(SAMPLE_TOTAL)


def _banded_pool(s: Study) -> DataFrame:
    return s.unexposed_linked.withColumn("five_year_bands", five_year_bands(F.col("age_at_operation"), tails=True))


@register("sample_fitting_targets", oracle("""
SELECT census_sex, five_year_bands, CAST(n_wanted AS BIGINT) AS n_wanted, CAST(n_available AS BIGINT) AS n_available,
       CAST(total AS BIGINT) AS total FROM fitting""", FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES, FITTING))
def q_sample_fitting_targets(spark, sf_dir):
    """Sizes of the largest sample with the exposed people's shares that leaves no stratum short."""
    s = study(spark, sf_dir)
    return S.fitting_targets(_banded_pool(s), s.shares, STRATA, SAMPLE_TOTAL)


def _strict_sql() -> str:
    from epicohort.functions.draws import duckdb_draw
    return f"""
SELECT census_id_final, census_sex, five_year_bands, op_date
FROM (SELECT *, {duckdb_draw('census_id_final', CFG.seed)} AS u_draw FROM u_banded) p
JOIN fitting USING (census_sex, five_year_bands)
QUALIFY row_number() OVER (PARTITION BY census_sex, five_year_bands ORDER BY u_draw, census_id_final) <= n_wanted"""


@register("stratified_sample_strict", oracle(_strict_sql(), FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES, FITTING))
def q_stratified_sample_strict(spark, sf_dir):
    """Matched sample in which every stratum has its full share; raises if one were short."""
    s = study(spark, sf_dir)
    pop = _banded_pool(s)
    targets = S.fitting_targets(pop, s.shares, STRATA, SAMPLE_TOTAL).select(*STRATA, "n_wanted")
    return S.stratified_sample(pop, targets, STRATA, CFG.seed).select(
        "census_id_final", "census_sex", "five_year_bands", "op_date")


# ------------------------------------------------------------------ stage 1e
_PANEL_COLS = ["census_id_final", "ref_date", "t_op", "month_label", "age_monthly", "pay", "days_worked", "paye_flag",
               "birth_in_1yr", "birth_in_5yr", "age_bands"]


@register("month_panel", oracle(f"""
SELECT census_id_final, ref_date, CAST(t_op AS BIGINT) AS t_op, month_label, age_monthly, round(pay, 4) AS pay,
       round(days_worked, 4) AS days_worked, paye_flag, birth_in_1yr, birth_in_5yr, age_bands
FROM exposed_panel""", FLAGGED, REG, LINK_E, PANEL_E))
def q_month_panel(spark, sf_dir):
    """Person x month panel of the exposed with pay and recent births."""
    return rounded(study(spark, sf_dir).exposed_panel.select(*_PANEL_COLS))


@register("combined_ids", oracle("""
SELECT CAST(census_id_flag AS INTEGER) AS census_id_flag, census_id_final, month_label, round(pay, 4) AS pay,
       round(days_worked, 4) AS days_worked FROM pm""", REG))
def q_combined_ids(spark, sf_dir):
    """Pay per person-month over all of a person's identifiers, negative pay clamped per identifier."""
    s = study(spark, sf_dir)
    return rounded(P.combine_ids(s.t.monthly_pay, P.identifier_links(s.id_routes)).select(
        F.col("census_id_flag").cast("int").alias("census_id_flag"), "census_id_final", "month_label",
        "pay", "days_worked"))


# ------------------------------------------------------------------ descriptives
def _series_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(count(*) AS BIGINT) AS n_people,
       round(avg(pay), 4) AS average_monthly_pay, round(quantile_cont(pay, 0.5), 4) AS median_monthly_pay,
       round(avg(pay_deflated), 4) AS average_monthly_pay_deflated,
       round(quantile_cont(pay_deflated, 0.5), 4) AS median_monthly_pay_deflated,
       round(avg(pay) FILTER (WHERE in_work = 1), 4) AS average_monthly_pay_in_work,
       round(quantile_cont(pay, 0.5) FILTER (WHERE in_work = 1), 4) AS median_monthly_pay_in_work,
       round(avg(pay_deflated) FILTER (WHERE in_work = 1), 4) AS average_monthly_pay_deflated_in_work,
       round(quantile_cont(pay_deflated, 0.5) FILTER (WHERE in_work = 1), 4) AS median_monthly_pay_deflated_in_work,
       round(sum(in_work) / count(*), 4) AS prop_in_work
FROM {src} GROUP BY {keys}"""


DESCR_E = """
exposed_desc AS (
  SELECT p.*, CASE WHEN pay > 0 THEN 1 ELSE 0 END AS in_work, pay / f.cpih_deflator_2023 AS pay_deflated
  FROM exposed_panel p LEFT JOIN deflator f ON f.month = CAST(month_label || '-01' AS DATE))"""


def described(spark, sf_dir, cohort: str = "exposed") -> DataFrame:
    """A cohort's panel with in-work flag and deflated pay (02 descriptives input)."""
    from epicohort.operators.link import deflate
    s = study(spark, sf_dir)
    panel = s.exposed_panel if cohort == "exposed" else s.unexposed_panel
    p = panel.withColumn("in_work", F.when(F.col("pay") > 0, 1).otherwise(0))
    return deflate(p, s.t.deflator, "pay")


def person_level(spark, sf_dir, cohort: str = "exposed") -> DataFrame:
    """One row per person: the panel row of the event month (t_op = 1)."""
    return described(spark, sf_dir, cohort).where(F.col("t_op") == 1)


@register("event_series", oracle(_series_sql("exposed_desc", "t_op"), FLAGGED, REG, LINK_E, PANEL_E, DESCR_E))
def q_event_series(spark, sf_dir):
    """Pay and employment by months since the index event, all and in-work rows."""
    from epicohort.operators.describe import series
    return rounded(series(described(spark, sf_dir), ["t_op"]))


# ------------------------------------------------------------------ stage 4a
def _sample_linked_cte() -> str:
    from epicohort.functions import recode as R
    from epicohort.functions.draws import duckdb_draw
    b5t = G.ranges_sql("age_at_operation", R.FIVE_YEAR_LOW_TAIL + R.FIVE_YEAR_BANDS + R.FIVE_YEAR_HIGH_TAIL, None,
                       half_open=True)
    return f"""
unexposed_sample_linked AS (
  SELECT p.* EXCLUDE (u_draw, five_year_bands), 'None' AS operation_type
  FROM (SELECT u.*, {b5t} AS five_year_bands, {duckdb_draw('census_id_final', CFG.seed)} AS u_draw
        FROM unexposed_dated_linked u) p
  JOIN (SELECT census_sex, five_year_bands, CAST(round({SAMPLE_TOTAL} * prop) AS BIGINT) AS n_wanted FROM shares) s
    USING (census_sex, five_year_bands)
  QUALIFY row_number() OVER (PARTITION BY census_sex, five_year_bands ORDER BY u_draw, census_id_final) <= n_wanted)"""


def _analysis_ctes(x: str, treated: bool) -> str:
    o = CFG.origin
    o_no = o.year * 12 + o.month - 1
    tail = (f"max(CASE WHEN t_op = 1 THEN six_month_num END) OVER (PARTITION BY census_id_final) AS treatment_group, "
            f"1 AS treat") if treated else "CAST(0 AS BIGINT) AS treatment_group, 0 AS treat"
    where = f"WHERE t_op <= {CFG.event_window[1]}" if treated else ""
    cols = ", ".join(Study.ANALYSIS_COLS)
    return f"""
{x}_an0 AS (
  SELECT {cols},
         CAST(ceil(t_op / 12.0) AS BIGINT) AS t_treatment_year,
         CAST(CASE WHEN t_op <= 0 THEN ceil(t_op / 6.0) WHEN t_op <= 6 THEN t_op ELSE ceil(t_op / 6.0) + 5 END AS BIGINT)
           AS t_treatment_6_month,
         CAST(month_label || '-01' AS DATE) AS month,
         CAST({G.month_no("CAST(month_label || '-01' AS DATE)")} - {o_no} + 1 AS INTEGER) AS month_num
  FROM {x}_panel),
{x}_an1 AS (
  SELECT a.*, greatest(t_treatment_year, 0) AS t_treatment_year_baseline,
         greatest(t_treatment_6_month, 0) AS t_treatment_6_month_baseline,
         CAST(month(month) AS INTEGER) AS cal_month, CAST(ceil(month_num / 6.0) AS BIGINT) AS six_month_num,
         CASE WHEN pay > 0 THEN 1 ELSE 0 END AS in_work,
         CASE WHEN pay > q.q THEN q.q ELSE pay END AS pay_winsor
  FROM {x}_an0 a, (SELECT quantile_cont(pay, 0.9999) AS q FROM {x}_an0) q),
{x}_an AS (
  SELECT a.*, pay_winsor / f.cpih_deflator_2023 AS pay_deflated,
         CASE WHEN pay_winsor / f.cpih_deflator_2023 > 0 THEN ln(pay_winsor / f.cpih_deflator_2023) END AS log_pay,
         ln(pay_winsor / f.cpih_deflator_2023 + 1) AS log_pay_plus_1, {tail}
  FROM {x}_an1 a LEFT JOIN deflator f ON f.month = a.month {where})"""


PANEL_U = G.panel_ctes("unexposed_sample", CFG)
AN_E = _analysis_ctes("exposed", True)
AN_U = _analysis_ctes("unexposed_sample", False)
COMBINED = """
combined AS (
  SELECT * FROM exposed_an
  UNION ALL BY NAME
  SELECT * REPLACE (CAST(0 AS BIGINT) AS t_treatment_6_month, CAST(0 AS BIGINT) AS t_treatment_6_month_baseline)
  FROM unexposed_sample_an)"""
FULL = [FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES, _sample_linked_cte(), PANEL_E, PANEL_U, AN_E, AN_U, COMBINED]


@register("event_bins", oracle("""
SELECT census_id_final, CAST(t_op AS BIGINT) AS t_op, t_treatment_year, t_treatment_6_month,
       t_treatment_year_baseline, t_treatment_6_month_baseline FROM exposed_an""", FLAGGED, REG, LINK_E, PANEL_E, AN_E))
def q_event_bins(spark, sf_dir):
    """Yearly and six-month event bins and baseline forms."""
    return study(spark, sf_dir).exposed_analysis.select(
        "census_id_final", "t_op", "t_treatment_year", "t_treatment_6_month", "t_treatment_year_baseline",
        "t_treatment_6_month_baseline")


@register("bin_bounds", oracle("""
SELECT t_treatment_6_month,
       CAST(CASE WHEN t_treatment_6_month <= 0 THEN t_treatment_6_month * 6 - 6 WHEN t_treatment_6_month <= 6
            THEN t_treatment_6_month - 1 ELSE t_treatment_6_month * 6 - 36 END AS BIGINT) AS month_left,
       CAST(CASE WHEN t_treatment_6_month <= 0 THEN t_treatment_6_month * 6 WHEN t_treatment_6_month <= 6
            THEN t_treatment_6_month ELSE t_treatment_6_month * 6 - 30 END AS BIGINT) AS month_right,
       round(CASE WHEN t_treatment_6_month <= 0 THEN t_treatment_6_month * 6 - 3 WHEN t_treatment_6_month <= 6
            THEN t_treatment_6_month - 0.5 ELSE t_treatment_6_month * 6 - 33 END, 4) AS month_mid
FROM (SELECT DISTINCT t_treatment_6_month FROM exposed_an) b""", FLAGGED, REG, LINK_E, PANEL_E, AN_E))
def q_bin_bounds(spark, sf_dir):
    """Left, right and mid month of every six-month bin present."""
    b = study(spark, sf_dir).exposed_analysis.select("t_treatment_6_month").distinct()
    return rounded(b.select("t_treatment_6_month", *[v.alias(k) for k, v in P.bin_bounds().items()]))


@register("calendar_index", oracle("""
SELECT census_id_final, month_label, month_num, cal_month, six_month_num, treatment_group FROM exposed_an""",
                                   FLAGGED, REG, LINK_E, PANEL_E, AN_E))
def q_calendar_index(spark, sf_dir):
    """Calendar month and six-month index; treatment group = six-month index at event month."""
    return study(spark, sf_dir).exposed_analysis.select(
        "census_id_final", "month_label", "month_num", "cal_month", "six_month_num", "treatment_group")


@register("outcomes", oracle("""
SELECT census_id_final, month_label, in_work, round(pay_winsor, 4) AS pay_winsor, round(pay_deflated, 4) AS pay_deflated,
       round(log_pay, 4) AS log_pay, round(log_pay_plus_1, 4) AS log_pay_plus_1 FROM exposed_an""",
                             FLAGGED, REG, LINK_E, PANEL_E, AN_E))
def q_outcomes(spark, sf_dir):
    """In-work flag, winsorised (exact 99.99 % quantile), deflated and log pay."""
    return rounded(study(spark, sf_dir).exposed_analysis.select(
        "census_id_final", "month_label", "in_work", "pay_winsor", "pay_deflated", "log_pay", "log_pay_plus_1"))


@register("combine_cohorts", oracle("""
SELECT treat, operation_type, t_treatment_6_month, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT census_id_final) AS BIGINT) AS n_people, round(avg(pay_deflated), 4) AS mean_pay_deflated
FROM combined GROUP BY treat, operation_type, t_treatment_6_month""", *FULL))
def q_combine_cohorts(spark, sf_dir):
    """L15 X5 stage 1e for the sample: exposed and matched unexposed panels stacked."""
    c = study(spark, sf_dir).combined
    return rounded(c.groupBy("treat", "operation_type", "t_treatment_6_month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("census_id_final").alias("n_people"),
        F.avg("pay_deflated").alias("mean_pay_deflated")))


@register("rebased_bins", oracle("""
SELECT treat, CASE WHEN treat = 0 THEN -4 WHEN t_treatment_6_month IN (-1, -2, -3) THEN 0
                   ELSE t_treatment_6_month END AS bin,
       CAST(count(*) AS BIGINT) AS n_rows
FROM combined GROUP BY treat, CASE WHEN treat = 0 THEN -4 WHEN t_treatment_6_month IN (-1, -2, -3) THEN 0
                   ELSE t_treatment_6_month END""", *FULL))
def q_rebased_bins(spark, sf_dir):
    """Baseline merged over bins -3..-1, unexposed moved to bin -4."""
    r = P.rebase(study(spark, sf_dir).combined, merge_bins=(-1, -2, -3), unexposed_bin=-4)
    return r.groupBy("treat", F.col("t_treatment_6_month").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


SIX = """
six AS (
  SELECT census_id_final, six_month_num, treat, treatment_group, census_sex,
         avg(pay_deflated) AS pay_deflated_six_month, min(age_monthly) AS age_monthly_six_month
  FROM combined GROUP BY census_id_final, six_month_num, treat, treatment_group, census_sex),
six2 AS (
  SELECT *, CASE WHEN pay_deflated_six_month > 0 THEN 1 ELSE 0 END AS in_work_six_month,
         CAST(CASE WHEN treat = 1 THEN six_month_num - treatment_group + 1 ELSE 0 END AS BIGINT) AS event_time
  FROM six)"""


@register("six_month_panel", oracle("""
SELECT census_id_final, six_month_num, treat, treatment_group, round(pay_deflated_six_month, 4) AS pay_deflated_six_month,
       age_monthly_six_month, in_work_six_month, event_time FROM six2""", *FULL, SIX))
def q_six_month_panel(spark, sf_dir):
    """Person x six-month panel with event time for group-time effects."""
    from epicohort.operators.att import six_month_panel
    return rounded(six_month_panel(study(spark, sf_dir).combined).select(
        "census_id_final", "six_month_num", "treat", "treatment_group", "pay_deflated_six_month",
        "age_monthly_six_month", "in_work_six_month", "event_time"))


ATT = """
cells AS (SELECT treatment_group AS G, six_month_num AS T, sum(pay_deflated_six_month) AS sy, count(*) AS n
          FROM six2 WHERE pay_deflated_six_month IS NOT NULL GROUP BY treatment_group, six_month_num),
tt AS (
  SELECT a.G AS grp, a.T AS tm, a.sy / a.n AS m_t, b.sy / b.n AS m_b, a.n AS n_treated, b.n AS n_base
  FROM cells a JOIN cells b ON b.G = a.G AND b.T = a.G - 1 WHERE a.G > 0),
att0 AS (
  SELECT tt.*, tm - grp AS event_time,
         (SELECT sum(sy) / sum(n) FROM cells c WHERE c.T = tm AND (c.G = 0 OR (c.G > greatest(tm, grp - 1) AND c.G <> grp))) AS c_t,
         (SELECT sum(sy) / sum(n) FROM cells c WHERE c.T = grp - 1 AND (c.G = 0 OR (c.G > greatest(tm, grp - 1) AND c.G <> grp))) AS c_b,
         (SELECT sum(n) FROM cells c WHERE c.T = tm AND (c.G = 0 OR (c.G > greatest(tm, grp - 1) AND c.G <> grp))) AS n_control,
         (SELECT sum(n) FROM cells c WHERE c.T = grp - 1 AND (c.G = 0 OR (c.G > greatest(tm, grp - 1) AND c.G <> grp))) AS n_control_base
  FROM tt),
att AS (SELECT *, (m_t - m_b) - (c_t - c_b) AS att FROM att0),
pp AS (
  SELECT census_id_final AS pid, treatment_group AS G, six_month_num AS T, sum(pay_deflated_six_month) AS S,
         count(*) AS n
  FROM six2 WHERE pay_deflated_six_month IS NOT NULL GROUP BY census_id_final, treatment_group, six_month_num),
psi AS (
  SELECT a.grp, a.tm, p.pid,
         sum(CASE WHEN p.G = a.grp AND p.T = a.tm THEN (p.S - p.n * a.m_t) / a.n_treated ELSE 0 END)
       - sum(CASE WHEN p.G = a.grp AND p.T = a.grp - 1 THEN (p.S - p.n * a.m_b) / a.n_base ELSE 0 END)
       - sum(CASE WHEN (p.G = 0 OR (p.G > greatest(a.tm, a.grp - 1) AND p.G <> a.grp)) AND p.T = a.tm
                  THEN (p.S - p.n * a.c_t) / a.n_control ELSE 0 END)
       + sum(CASE WHEN (p.G = 0 OR (p.G > greatest(a.tm, a.grp - 1) AND p.G <> a.grp)) AND p.T = a.grp - 1
                  THEN (p.S - p.n * a.c_b) / a.n_control_base ELSE 0 END) AS psi
  FROM att a JOIN pp p ON p.T = a.tm OR p.T = a.grp - 1
  GROUP BY a.grp, a.tm, p.pid),
att_se AS (SELECT grp, tm, sqrt(sum(psi * psi)) AS se FROM psi GROUP BY grp, tm)"""


def _effects(spark, sf_dir, covariates=()):
    """The group-time effects of the study's pay, kept with the study."""
    from epicohort.operators.att import group_time_effects, six_month_panel
    s = study(spark, sf_dir)
    return s.kept(("att", *covariates), lambda: group_time_effects(
        s.kept("six_month", lambda: s.stage("six_month", six_month_panel(s.combined))), "pay_deflated_six_month", covariates=covariates))


ATT_COLUMNS = """CAST(a.grp AS BIGINT) AS "group", CAST(a.tm AS BIGINT) AS time, CAST(a.event_time AS BIGINT) AS event_time,
       round(a.att, 4) AS att, round(s.se, 4) AS se, round(a.att - 1.959963984540054 * s.se, 4) AS conf_low,
       round(a.att + 1.959963984540054 * s.se, 4) AS conf_high, CAST(a.n_treated AS BIGINT) AS n_treated,
       CAST(a.n_control AS BIGINT) AS n_control"""


@register("att_gt", oracle(f"""
SELECT {ATT_COLUMNS}
FROM att a JOIN att_se s ON s.grp = a.grp AND s.tm = a.tm WHERE a.att IS NOT NULL""", *FULL, SIX, ATT))
def q_att_gt(spark, sf_dir):
    """Group-time ATT with not-yet-treated controls (own cohort excluded),
    universal base period g-1, person-clustered influence-function SE."""
    return rounded(_effects(spark, sf_dir).table(spark))


ATT_COVARIATE = """
obs AS (
  SELECT census_id_final AS pid, treatment_group AS G, six_month_num AS T, pay_deflated_six_month AS y,
         CAST(age_monthly_six_month AS DOUBLE) AS x
  FROM six2 WHERE pay_deflated_six_month IS NOT NULL AND age_monthly_six_month IS NOT NULL),
ocells AS (SELECT G, T, avg(y) AS m, count(*) AS n FROM obs GROUP BY G, T),
opairs AS (
  SELECT a.G AS grp, a.T AS tm, a.m AS m_t, b.m AS m_b, a.n AS n_treated, b.n AS n_base
  FROM ocells a JOIN ocells b ON b.G = a.G AND b.T = a.G - 1 WHERE a.G > 0),
sides AS (SELECT *, 1 AS side, tm AS at FROM opairs UNION ALL SELECT *, -1 AS side, grp - 1 AS at FROM opairs),
octl AS (
  SELECT s.grp, s.tm, s.side, o.pid, o.x, o.y FROM sides s JOIN obs o
    ON o.T = s.at AND (o.G = 0 OR (o.G > greatest(s.tm, s.grp - 1) AND o.G <> s.grp))),
ofit AS (
  SELECT grp, tm, side, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx
  FROM octl GROUP BY grp, tm, side),
otrt AS (SELECT s.grp, s.tm, s.side, o.pid, o.x, o.y FROM sides s JOIN obs o ON o.T = s.at AND o.G = s.grp),
oprofile AS (SELECT grp, tm, avg(x) AS px, count(*) AS n FROM otrt GROUP BY grp, tm),
ochange AS (
  SELECT a.*, a.tm - a.grp AS event_time, t.n AS n_control, p.px, p.n AS n_profile, t.b0 - b.b0 AS d0, t.b1 - b.b1 AS d1
  FROM opairs a JOIN ofit t ON t.grp = a.grp AND t.tm = a.tm AND t.side = 1
  JOIN ofit b ON b.grp = a.grp AND b.tm = a.tm AND b.side = -1 JOIN oprofile p ON p.grp = a.grp AND p.tm = a.tm),
att AS (SELECT *, (m_t - m_b) - (d0 + d1 * px) AS att FROM ochange),
opsi AS (
  SELECT a.grp, a.tm, o.pid, CASE WHEN o.side = 1 THEN (o.y - a.m_t) / a.n_treated ELSE -(o.y - a.m_b) / a.n_base END
         - (o.x - a.px) * a.d1 / a.n_profile AS psi
  FROM att a JOIN otrt o ON o.grp = a.grp AND o.tm = a.tm
  UNION ALL
  SELECT a.grp, a.tm, o.pid, -o.side * (1.0 / f.n + (a.px - f.mx) * (o.x - f.mx) / f.sxx) * (o.y - f.b0 - f.b1 * o.x) AS psi
  FROM att a JOIN octl o ON o.grp = a.grp AND o.tm = a.tm JOIN ofit f ON f.grp = o.grp AND f.tm = o.tm AND f.side = o.side),
psi AS (SELECT grp, tm, pid, sum(psi) AS psi FROM opsi GROUP BY grp, tm, pid),
att_se AS (SELECT grp, tm, sqrt(sum(psi * psi)) AS se FROM psi GROUP BY grp, tm)"""


@register("att_gt_covariate", oracle(f"""
SELECT {ATT_COLUMNS}
FROM att a JOIN att_se s ON s.grp = a.grp AND s.tm = a.tm WHERE a.att IS NOT NULL""", *FULL, SIX, ATT_COVARIATE))
def q_att_gt_covariate(spark, sf_dir):
    """M15 with a covariate: outcome regression on age within each pair's controls."""
    return rounded(_effects(spark, sf_dir, ("age_monthly_six_month",)).table(spark))


DYNAMIC = """
sizes AS (
  SELECT treatment_group AS grp, count(DISTINCT census_id_final) AS w FROM six2 WHERE treatment_group > 0 GROUP BY treatment_group),
dyn AS (
  SELECT a.event_time, sum(a.att * z.w) / sum(z.w) AS att, sum(z.w) AS total, count(*) AS n_groups
  FROM att a JOIN sizes z USING (grp) WHERE a.att IS NOT NULL GROUP BY a.event_time),
moves AS (
  SELECT a.event_time, p.pid, p.psi * z.w / d.total AS phi
  FROM psi p JOIN att a ON a.grp = p.grp AND a.tm = p.tm JOIN sizes z ON z.grp = a.grp JOIN dyn d ON d.event_time = a.event_time
  WHERE a.att IS NOT NULL
  UNION ALL
  SELECT a.event_time, m.pid, (a.att - d.att) / d.total AS phi
  FROM (SELECT DISTINCT census_id_final AS pid, treatment_group AS grp FROM six2 WHERE treatment_group > 0) m
  JOIN att a ON a.grp = m.grp JOIN dyn d ON d.event_time = a.event_time WHERE a.att IS NOT NULL),
dyn_se AS (
  SELECT event_time, sqrt(sum(phi * phi)) AS se
  FROM (SELECT event_time, pid, sum(phi) AS phi FROM moves GROUP BY event_time, pid) GROUP BY event_time)"""

DYNAMIC_SELECT = """
SELECT CAST(d.event_time AS BIGINT) AS event_time, round(d.att, 4) AS att, round(s.se, 4) AS se,
       round(d.att - 1.959963984540054 * s.se, 4) AS conf_low, round(d.att + 1.959963984540054 * s.se, 4) AS conf_high,
       CAST(d.n_groups AS BIGINT) AS n_groups
FROM dyn d JOIN dyn_se s USING (event_time)"""


@register("att_dynamic", oracle(DYNAMIC_SELECT, *FULL, SIX, ATT, DYNAMIC))
def q_att_dynamic(spark, sf_dir):
    """ATT(g, t) by event time, weighted by group size, with its standard error from the joint covariance."""
    return rounded(_effects(spark, sf_dir).dynamic(spark))


@register("att_dynamic_covariate", oracle(DYNAMIC_SELECT, *FULL, SIX, ATT_COVARIATE, DYNAMIC))
def q_att_dynamic_covariate(spark, sf_dir):
    """M16 over the effects with a covariate."""
    return rounded(_effects(spark, sf_dir, ("age_monthly_six_month",)).dynamic(spark))


# ------------------------------------------------------------------ models
BAL_MONTHS = (CFG.follow_up_start, CFG.follow_up_end)


def balanced_panel(spark, sf_dir) -> DataFrame:
    """Every linked identifier owner x every month of the follow-up window
    (J13 explode of a bounded month sequence), pay and days from A18, 0 when absent."""
    from epicohort.functions.dates import month_label as mlabel
    from epicohort.functions.dates import month_of_number
    s = study(spark, sf_dir)
    links = P.identifier_links(s.id_routes)
    people = links.select("census_id_flag", "census_id_final").distinct()
    lo = BAL_MONTHS[0].year * 12 + BAL_MONTHS[0].month - 1
    hi = BAL_MONTHS[1].year * 12 + BAL_MONTHS[1].month - 2
    grid = people.withColumn("_m", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
        "month_label", mlabel(month_of_number(F.col("_m")))).drop("_m")
    pay = P.combine_ids(s.t.monthly_pay, links)
    return P.attach_measures(grid, pay)


def _balanced_sql() -> str:
    lo = BAL_MONTHS[0]
    hi_idx = BAL_MONTHS[1].year * 12 + BAL_MONTHS[1].month - 2
    import datetime as dt
    hi = dt.date(hi_idx // 12, hi_idx % 12 + 1, 1)
    return f"""
SELECT 'days_worked' AS term, round(b, 4) AS estimate,
       round(sqrt(sum(s * s) / (sxx * sxx) * g / (g - 1.0) * (n - 1.0) / (n - k)), 4) AS std_error
FROM (SELECT pid, sum(xd * (yd - b * xd)) AS s FROM dm, beta GROUP BY pid) sc, beta
GROUP BY b, sxx, g, n, k"""


BALANCED = f"""
bp AS (
  SELECT k.census_id_final AS pid, m.month_label, coalesce(pm.pay, 0.0) AS y, coalesce(pm.days_worked, 0.0) AS x
  FROM (SELECT DISTINCT census_id_flag, census_id_final FROM links) k
  CROSS JOIN (SELECT {G.label('CAST(g.m AS DATE)')} AS month_label
              FROM generate_series({G.d(BAL_MONTHS[0])}, {G.d(BAL_MONTHS[1])} - INTERVAL 1 MONTH, INTERVAL 1 MONTH) g(m)) m
  LEFT JOIN pm ON pm.census_id_flag = k.census_id_flag AND pm.census_id_final = k.census_id_final
              AND pm.month_label = m.month_label),
dm AS (
  SELECT pid, x - avg(x) OVER (PARTITION BY pid) - avg(x) OVER (PARTITION BY month_label) + avg(x) OVER () AS xd,
         y - avg(y) OVER (PARTITION BY pid) - avg(y) OVER (PARTITION BY month_label) + avg(y) OVER () AS yd
  FROM bp),
beta AS (
  SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(DISTINCT pid) AS DOUBLE) AS g,
         CAST((SELECT count(DISTINCT month_label) FROM bp) AS DOUBLE) AS k
  FROM dm)"""


@register("fe_one_regressor_balanced", oracle(_balanced_sql(), REG, BALANCED))
def q_fe_balanced(spark, sf_dir):
    """Two-way fixed effects (person absorbed by demeaning, month
    dummies) of pay on days worked, person-clustered SE, on a balanced panel."""
    from epicohort.operators.fe import fe_event_study
    res = fe_event_study(balanced_panel(spark, sf_dir), "pay", {}, ["days_worked"])
    rows = [r for r in res.rows() if r["term"] == "days_worked"]
    df = spark.createDataFrame([(r["term"], r["estimate"], r["std_error"]) for r in rows],
                               "term string, estimate double, std_error double")
    return rounded(df)


# ------------------------------------------------------------------ descriptives (02)
def _measures_sql(where: str = "TRUE") -> str:
    parts = []
    for name in ("pay", "pay_deflated"):
        parts += [f"round(avg({name}) FILTER (WHERE {where}), 4) AS average_monthly_{name}",
                  f"round(quantile_cont({name}, 0.5) FILTER (WHERE {where}), 4) AS median_monthly_{name}",
                  f"round(round(max({name}) FILTER (WHERE {where}), -2), 4) AS max_monthly_{name}",
                  f"round(avg({name}) FILTER (WHERE {where} AND in_work = 1), 4) AS average_monthly_{name}_in_work",
                  f"round(quantile_cont({name}, 0.5) FILTER (WHERE {where} AND in_work = 1), 4) "
                  f"AS median_monthly_{name}_in_work",
                  f"round(round(max({name}) FILTER (WHERE {where} AND in_work = 1), -2), 4) "
                  f"AS max_monthly_{name}_in_work"]
    parts.append(f"round(sum(in_work) FILTER (WHERE {where}) / count(*) FILTER (WHERE {where}), 4) AS prop_in_work")
    return ", ".join(parts)


@register("pay_summary", oracle(f"""
SELECT 'overall' AS "group", {_measures_sql()} FROM exposed_desc
UNION ALL
SELECT CASE WHEN t_op < 0 THEN 'pre-surgery' ELSE 'post-surgery' END, {_measures_sql()} FROM exposed_desc
GROUP BY CASE WHEN t_op < 0 THEN 'pre-surgery' ELSE 'post-surgery' END""", FLAGGED, REG, LINK_E, PANEL_E, DESCR_E))
def q_pay_summary(spark, sf_dir):
    """Pay summary overall and pre/post the event (t = 0 is post, trap 10)."""
    from epicohort.operators.describe import pay_summary_pre_post
    return rounded(pay_summary_pre_post(described(spark, sf_dir)))


def _series_keys_sql(src: str, keys: str, where: str = "TRUE") -> str:
    return _series_sql(f"(SELECT * FROM {src} WHERE {where}) s", keys)


CAL = f"CAST({G.month_no('ref_date')} - {G.month_no(G.d(CFG.origin))} AS INTEGER)"


@register("calendar_series", oracle(f"""
SELECT 'all' AS series, * FROM ({_series_sql(f"(SELECT *, {CAL} AS cal_month_index FROM exposed_desc) s", "cal_month_index")}) a
UNION ALL
SELECT 'before event', * FROM ({_series_sql(f"(SELECT *, {CAL} AS cal_month_index FROM exposed_desc WHERE t_op < 0) s",
                                         "cal_month_index")}) b""", FLAGGED, REG, LINK_E, PANEL_E, DESCR_E))
def q_calendar_series(spark, sf_dir):
    """Series by calendar month, plus the series censored at the event, labelled and stacked."""
    from epicohort.functions.dates import months_since
    from epicohort.operators.describe import series
    d = described(spark, sf_dir).withColumn("cal_month_index", months_since(F.col("ref_date"), CFG.origin))
    a = series(d, ["cal_month_index"]).withColumn("series", F.lit("all"))
    b = series(d.where(F.col("t_op") < 0), ["cal_month_index"]).withColumn("series", F.lit("before event"))
    return rounded(a.unionByName(b))


@register("age_series", oracle(_series_sql("exposed_desc", "age_monthly, census_sex"),
                               FLAGGED, REG, LINK_E, PANEL_E, DESCR_E))
def q_age_series(spark, sf_dir):
    """A10: series by monthly age and sex."""
    from epicohort.operators.describe import series
    return rounded(series(described(spark, sf_dir), ["age_monthly", "census_sex"]))


@register("type_month_totals", oracle(f"""
SELECT CAST(op_month AS INTEGER) AS op_month, coalesce(operation_type, 'total') AS operation_type,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT {G.month_no('op_date')} - {G.month_no(G.d(CFG.origin))} AS op_month, operation_type FROM exposed) t
GROUP BY GROUPING SETS ((op_month, operation_type), (op_month))""", FLAGGED))
def q_type_month_totals(spark, sf_dir):
    """A2: index events by month and type plus a 'total' row per month (one grouping-sets aggregate)."""
    from epicohort.operators.describe import count_with_total
    e = study(spark, sf_dir).exposed.withColumn("op_month", S.event_month("op_date", CFG.origin))
    return count_with_total(e, "op_month", "operation_type")


_CAT_COLS = ["census_sex", "ethnic_group_tb", "disability_category", "ns_sec", "religion_tb", "highest_qualification",
             "legal_partnership_status", "region", "rural_urban", "imd_quintile", "age_bands", "disability_binary", "imd_decile"]


def _cat_sql(src: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS Variable_names, CAST({c} AS VARCHAR) AS Category_name, CAST(count(*) AS DOUBLE) AS Count, "
        f"round(count(*) * 100.0 / (SELECT count(*) FROM {src}), 1) AS Percentage "
        f"FROM {src} GROUP BY {c}" for c in _CAT_COLS) + (
        f"\nUNION ALL SELECT 'age_at_operation', '', round(avg(age_at_operation), 4), round(stddev_samp(age_at_operation), 4) FROM {src}")


def _category_counts(frame: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    from epicohort.operators.describe import category_counts
    cc = category_counts(frame, _CAT_COLS)
    cc = cc.withColumn("Percentage", F.round(F.col("Count") / F.sum("Count").over(
        Window.partitionBy("Variable_names")) * 100 * (1 + NUDGE), 1)).withColumn("Count", F.col("Count").cast("double"))
    age = rounded(frame.agg(F.avg("age_at_operation").alias("Count"), F.stddev_samp("age_at_operation").alias("Percentage")))
    return cc.unionByName(age.select(F.lit("age_at_operation").alias("Variable_names"), F.lit("").alias("Category_name"), "Count", "Percentage"))


PL_E = "exposed_pl AS (SELECT * FROM exposed_desc WHERE t_op = 1)"
PL_U = "unexposed_pl AS (SELECT * FROM unexposed_desc WHERE t_op = 1)"


@register("category_counts", oracle(_cat_sql("exposed_pl"), FLAGGED, REG, LINK_E, PANEL_E, DESCR_E, PL_E))
def q_category_counts(spark, sf_dir):
    """Counts and percent (1 dp) of each category of 13 person attributes, and mean and sd of age
    (person level = event-month panel row), one unpivot + aggregate."""
    return _category_counts(person_level(spark, sf_dir))


@register("crosstab", oracle("""
SELECT operation_type, CAST(census_sex AS VARCHAR) AS grouping, CAST(count(*) AS BIGINT) AS Count,
       'census_sex' AS characteristic
FROM (SELECT * FROM exposed_pl
      QUALIFY row_number() OVER (PARTITION BY census_id_final ORDER BY operation_type NULLS LAST,
                                 census_sex NULLS LAST) = 1) t
GROUP BY operation_type, census_sex""", FLAGGED, REG, LINK_E, PANEL_E, DESCR_E, PL_E))
def q_crosstab(spark, sf_dir):
    """One row per person, then counts by procedure type and sex."""
    from epicohort.operators.describe import crosstab_long
    return crosstab_long(person_level(spark, sf_dir), "operation_type", "census_sex")


STD_SRC = """
std_src AS (
  SELECT 1 AS treat, age_at_operation, imd_decile, disability_binary, CASE WHEN census_sex = 'Females' THEN 1 ELSE 0 END AS female
  FROM exposed_linked
  UNION ALL
  SELECT 0, age_at_operation, imd_decile, disability_binary, CASE WHEN census_sex = 'Females' THEN 1 ELSE 0 END
  FROM unexposed_sample_linked)"""


def _std_sql(kind: str) -> str:
    cols = ["age_at_operation", "imd_decile"] if kind == "numeric" else ["disability_binary", "female"]
    parts = []
    for c in cols:
        m = {g: f"avg(CAST({c} AS DOUBLE)) FILTER (WHERE treat = {g})" for g in (0, 1)}
        n = {g: f"count({c}) FILTER (WHERE treat = {g})" for g in (0, 1)}
        if kind == "numeric":
            pooled = f"(var_samp(CAST({c} AS DOUBLE)) FILTER (WHERE treat = 1) + var_samp(CAST({c} AS DOUBLE)) FILTER (WHERE treat = 0)) / 2"
        else:
            pooled = f"({m[1]} * (1 - {m[1]}) + {m[0]} * (1 - {m[0]})) / 2"
        d = f"abs({m[1]} - {m[0]}) / sqrt({pooled})"
        se = f"sqrt(({n[1]} + {n[0]}) / ({n[1]} * {n[0]}) + ({d}) * ({d}) / (2 * ({n[1]} + {n[0]})))"
        parts.append(f"SELECT '{c}' AS variable, round({d}, 4) AS std_diff, round({d} - 1.96 * {se}, 4) AS std_diff_lcl, "
                     f"round({d} + 1.96 * {se}, 4) AS std_diff_ucl FROM std_src")
    return "\nUNION ALL\n".join(parts)


def _std_frame(spark, sf_dir) -> DataFrame:
    s = study(spark, sf_dir)
    cols = ["age_at_operation", "imd_decile", "disability_binary", "female"]

    def prep(df, treat):
        return df.select(F.lit(treat).alias("treat"), "age_at_operation", "imd_decile", "disability_binary",
                         F.when(F.col("census_sex") == "Females", 1).otherwise(0).alias("female"))
    return prep(s.exposed_linked, 1).unionByName(prep(s.unexposed_sample, 0)).select("treat", *cols)


STD_PARTS = [FLAGGED, DIST, REG, LINK_E, LINK_U, SHARES, _sample_linked_cte(), STD_SRC]


@register("std_diff_numeric", oracle(_std_sql("numeric"), *STD_PARTS))
def q_std_diff_numeric(spark, sf_dir):
    """Standardised mean differences (with CI) exposed vs matched sample."""
    from epicohort.operators.describe import std_diff_numeric
    return rounded(std_diff_numeric(_std_frame(spark, sf_dir), "treat", ["age_at_operation", "imd_decile"]))


@register("std_diff_binary", oracle(_std_sql("binary"), *STD_PARTS))
def q_std_diff_binary(spark, sf_dir):
    """A15 (binary case): standardised differences of proportions."""
    from epicohort.operators.describe import std_diff_binary
    return rounded(std_diff_binary(_std_frame(spark, sf_dir), "treat", ["disability_binary", "female"]))


@register("follow_up", oracle("""
SELECT period, round(avg(len), 4) AS mean_months, round(quantile_cont(len, 0.5), 4) AS median_months,
       CAST(max(len) AS BIGINT) AS max_months, CAST(min(len) AS BIGINT) AS min_months
FROM (SELECT 'overall' AS period, census_id_final, max(t_op) - min(t_op) + 1 AS len FROM exposed_an GROUP BY census_id_final
      UNION ALL
      SELECT 'post', census_id_final, max(t_op) - min(t_op) + 1 FROM exposed_an WHERE t_op >= 1 GROUP BY census_id_final
      UNION ALL
      SELECT 'pre', census_id_final, max(t_op) - min(t_op) + 1 FROM exposed_an WHERE t_op < 1 GROUP BY census_id_final) t
GROUP BY period""", FLAGGED, REG, LINK_E, PANEL_E, AN_E))
def q_follow_up(spark, sf_dir):
    """Follow-up months per person, summarised overall / post / pre (exact median)."""
    from epicohort.operators.describe import follow_up
    f = follow_up(study(spark, sf_dir).exposed_analysis)
    return rounded(f.select("period", "mean_months", F.col("median_months").cast("double"),
                            F.col("max_months").cast("long"), F.col("min_months").cast("long")))


HIST = (10000.0, 0.0, 1000000.0)


_BIN = f"CASE WHEN pay < {HIST[1]} THEN -1 WHEN pay >= {HIST[2]} THEN {int(-((HIST[1] - HIST[2]) // HIST[0]))} ELSE floor((pay - {HIST[1]}) / {HIST[0]}) END"


@register("histogram", oracle(f"""
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN bin >= 0 THEN least(bin * {HIST[0]} + {HIST[1]}, {HIST[2]}) END AS bin_start
FROM (SELECT {_BIN} AS bin FROM exposed_desc WHERE pay IS NOT NULL) GROUP BY bin""",
                            FLAGGED, REG, LINK_E, PANEL_E, DESCR_E))
def q_histogram(spark, sf_dir):
    """Histogram of monthly pay (fixed-width bins) computed on the cluster."""
    from epicohort.operators.describe import histogram
    return rounded(histogram(described(spark, sf_dir), "pay", *HIST))


@register("describe_age", oracle("""
SELECT min(age_monthly) AS min, max(age_monthly) AS max, round(avg(age_monthly), 4) AS mean,
       round(stddev_samp(age_monthly), 4) AS sd FROM exposed_pl""", FLAGGED, REG, LINK_E, PANEL_E, DESCR_E, PL_E))
def q_describe_age(spark, sf_dir):
    """A4: min, max, mean and sample sd of age in the event month (person level)."""
    from epicohort.operators.describe import describe_num
    return rounded(describe_num(person_level(spark, sf_dir), "age_monthly"))


@register("procedure_type_counts", oracle("""
SELECT operation_type, CAST(count(*) AS BIGINT) AS n FROM exposed GROUP BY operation_type""", FLAGGED))
def q_procedure_type_counts(spark, sf_dir):
    """Index events per procedure type, largest first."""
    from epicohort.operators.describe import count_by
    return count_by(study(spark, sf_dir).exposed, ["operation_type"]).orderBy(F.desc("n"), "operation_type")


DESCR_U = """
unexposed_desc AS (
  SELECT p.*, CASE WHEN pay > 0 THEN 1 ELSE 0 END AS in_work, pay / f.cpih_deflator_2023 AS pay_deflated
  FROM unexposed_sample_panel p LEFT JOIN deflator f ON f.month = CAST(month_label || '-01' AS DATE))"""


def _cohort_side(src: str, tag: str) -> str:
    return (f"SELECT CASE WHEN t_op < 0 THEN 'pre' ELSE 'post' END AS period, avg(pay_deflated) AS {tag}_mean_pay, "
            f"avg(in_work) AS {tag}_prop_in_work, count(*) AS {tag}_n FROM {src} "
            f"GROUP BY CASE WHEN t_op < 0 THEN 'pre' ELSE 'post' END")


@register("cohort_compare", oracle(f"""
SELECT coalesce(e.period, u.period) AS period, round(e.exposed_mean_pay, 4) AS exposed_mean_pay,
       round(e.exposed_prop_in_work, 4) AS exposed_prop_in_work, CAST(e.exposed_n AS BIGINT) AS exposed_n,
       round(u.unexposed_mean_pay, 4) AS unexposed_mean_pay, round(u.unexposed_prop_in_work, 4) AS unexposed_prop_in_work,
       CAST(u.unexposed_n AS BIGINT) AS unexposed_n
FROM ({_cohort_side('exposed_desc', 'exposed')}) e
FULL OUTER JOIN ({_cohort_side('unexposed_desc', 'unexposed')}) u ON e.period = u.period""",
                                    *FULL, DESCR_E, DESCR_U))
def q_cohort_compare(spark, sf_dir):
    """Exposed and matched unexposed pay before/after the (pseudo) event, full outer join by period."""
    from epicohort.operators.link import deflate
    from epicohort.operators.report import compare_tables
    s = study(spark, sf_dir)

    def side(panel, tag):
        d = deflate(panel.withColumn("in_work", F.when(F.col("pay") > 0, 1).otherwise(0)), s.t.deflator, "pay")
        return d.groupBy(F.when(F.col("t_op") < 0, "pre").otherwise("post").alias("period")).agg(
            F.avg("pay_deflated").alias(f"{tag}_mean_pay"), F.avg("in_work").alias(f"{tag}_prop_in_work"),
            F.count(F.lit(1)).alias(f"{tag}_n"))
    return rounded(compare_tables(side(s.exposed_panel, "exposed"), side(s.unexposed_panel, "unexposed"), ["period"]))


def _steps_sql(steps) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS step, '{lab}' AS stage, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST(count(DISTINCT census_id_final) AS BIGINT) AS n_ids FROM {src}" for i, (lab, src) in enumerate(steps))


def _link_steps(x: str, start: str) -> list:
    lo, hi = CFG.working_age
    aged = f"{x}_l6 WHERE age_at_operation BETWEEN {lo} AND {hi} AND age_on_last_day_op_month BETWEEN {lo} AND {hi}"
    return [(start, x), *zip(Study.LINK_STEPS, [f"{x}_l1", f"{x}_l2", f"{x}_l3", f"{x}_l4", aged, f"{x}_linked"])]


@register("linkage_flow", oracle(_steps_sql(_link_steps("exposed", "index events")), FLAGGED, REG, LINK_E))
def q_linkage_flow(spark, sf_dir):
    """A16 for stage 1c: rows and people after each linkage step of the exposed."""
    s = study(spark, sf_dir)
    return s.linkage_flow(s.exposed, s.exposed_matched, "index events")


@register("linkage_flow_unexposed", oracle(_steps_sql(_link_steps("unexposed_dated", "pseudo event dates")),
                                           FLAGGED, DIST, REG, LINK_U))
def q_linkage_flow_unexposed(spark, sf_dir):
    """A16 for stage 1c: rows and people after each linkage step of the never exposed."""
    s = study(spark, sf_dir)
    return s.linkage_flow(s.unexposed_dated, s.matched(s.unexposed_dated), "pseudo event dates")


_PANEL_STEPS = [("linked people", "exposed_linked"), ("one area per person", "exposed_p0"),
                ("with a pay identifier", "exposed_p1"), ("person-months in the panel", "exposed_panel"),
                ("person-months with pay records", "exposed_panel WHERE paye_flag = 1")]


@register("panel_flow", oracle(_steps_sql(_PANEL_STEPS), FLAGGED, REG, LINK_E, PANEL_E))
def q_panel_flow(spark, sf_dir):
    """A16 for stage 1e: people and person-months through the panel build."""
    return study(spark, sf_dir).panel_flow([lab for lab, _ in _PANEL_STEPS])


# ------------------------------------------------------------------ descriptives of the matched unexposed
@register("event_series_unexposed", oracle(_series_sql("unexposed_desc", "t_op"), *FULL, DESCR_U))
def q_event_series_unexposed(spark, sf_dir):
    """A8 for the matched unexposed cohort (pseudo event dates)."""
    from epicohort.operators.describe import series
    return rounded(series(described(spark, sf_dir, "unexposed"), ["t_op"]))


@register("pay_summary_unexposed", oracle(f"""
SELECT 'overall' AS "group", {_measures_sql()} FROM unexposed_desc
UNION ALL
SELECT CASE WHEN t_op < 0 THEN 'pre-surgery' ELSE 'post-surgery' END, {_measures_sql()} FROM unexposed_desc
GROUP BY CASE WHEN t_op < 0 THEN 'pre-surgery' ELSE 'post-surgery' END""", *FULL, DESCR_U))
def q_pay_summary_unexposed(spark, sf_dir):
    """A5 A6 A7 for the matched unexposed cohort."""
    from epicohort.operators.describe import pay_summary_pre_post
    return rounded(pay_summary_pre_post(described(spark, sf_dir, "unexposed")))


BALANCE_COLS = ("census_sex", "disability_category", "ethnic_group_tb", "age_bands", "ns_sec", "rural_urban", "imd_decile",
                "disability_binary", "religion_tb", "region", "highest_qualification", "legal_partnership_status")

BALANCE = f"""
bal_long AS ({" UNION ALL ".join(f"SELECT treat, '{c}' AS variable, CAST({c} AS VARCHAR) AS level FROM (SELECT 1 AS treat, {c} FROM exposed_pl UNION ALL SELECT 0, {c} FROM unexposed_pl)" for c in BALANCE_COLS)}),
bal_n AS (
  SELECT variable, count(*) FILTER (WHERE treat = 1) AS n1, count(*) FILTER (WHERE treat = 0) AS n0
  FROM bal_long WHERE level IS NOT NULL GROUP BY variable),
bal_share AS (
  SELECT l.variable, level, row_number() OVER (PARTITION BY l.variable ORDER BY level) AS k,
         count(*) FILTER (WHERE treat = 1) / any_value(n1) AS t, count(*) FILTER (WHERE treat = 0) / any_value(n0) AS c
  FROM bal_long l JOIN bal_n n ON l.variable = n.variable WHERE level IS NOT NULL GROUP BY l.variable, level),
bal_rows AS (
  SELECT a.variable, a.k, list_append(list(CASE WHEN a.k = b.k THEN (a.t * (1 - a.t) + a.c * (1 - a.c)) / 2
           ELSE -(a.t * b.t + a.c * b.c) / 2 END ORDER BY b.k), any_value(a.t - a.c)) AS cells
  FROM bal_share a JOIN bal_share b ON a.variable = b.variable AND b.k > 1 WHERE a.k > 1 GROUP BY a.variable, a.k),
bal_sweep AS (
  SELECT variable, 1 AS j, list(cells ORDER BY k) AS m FROM bal_rows GROUP BY variable
  UNION ALL
  SELECT variable, j + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = j THEN m[i]
           ELSE list_transform(range(1, len(m) + 2), lambda c: m[i][c] - m[i][j] / m[j][j] * m[j][c]) END)
  FROM bal_sweep WHERE j <= len(m)),
bal_d AS (
  SELECT s.variable, sqrt(greatest(sum((h.t - h.c) * s.m[h.k - 1][len(s.m) + 1] / s.m[h.k - 1][h.k - 1]), 0)) AS d
  FROM bal_sweep s JOIN bal_share h ON h.variable = s.variable AND h.k > 1 WHERE s.j = len(s.m) + 1 GROUP BY s.variable),
bal_age AS (
  SELECT count(age_at_operation) FILTER (WHERE treat = 1) AS n1, count(age_at_operation) FILTER (WHERE treat = 0) AS n0,
         abs(avg(age_at_operation) FILTER (WHERE treat = 1) - avg(age_at_operation) FILTER (WHERE treat = 0))
         / sqrt((var_samp(age_at_operation) FILTER (WHERE treat = 1) + var_samp(age_at_operation) FILTER (WHERE treat = 0)) / 2) AS d
  FROM (SELECT 1 AS treat, CAST(age_at_operation AS DOUBLE) AS age_at_operation FROM exposed_pl
        UNION ALL SELECT 0, CAST(age_at_operation AS DOUBLE) FROM unexposed_pl)),
bal_all AS (
  SELECT n.variable, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN coalesce(d, 0) END AS d FROM bal_n n LEFT JOIN bal_d b ON b.variable = n.variable
  UNION ALL SELECT 'age_at_operation', n1, n0, d FROM bal_age),
balance AS (
  SELECT variable, round(d, 4) AS std_diff, round(d - 1.96 * se, 4) AS std_diff_lcl, round(d + 1.96 * se, 4) AS std_diff_ucl
  FROM (SELECT *, sqrt((n1 + n0) / (n1 * n0) + d * d / (2 * (n1 + n0))) AS se FROM bal_all))"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql[len("WITH"):]


def _balance(spark, sf_dir) -> DataFrame:
    """Standardised differences of the 12 factors and age at the event between the cohorts."""
    from epicohort.operators.describe import std_diff_category, std_diff_numeric
    cols = [*BALANCE_COLS, "age_at_operation"]
    people = person_level(spark, sf_dir).select(F.lit(1).alias("treat"), *cols).unionByName(
        person_level(spark, sf_dir, "unexposed").select(F.lit(0).alias("treat"), *cols))
    return rounded(std_diff_category(people, "treat", BALANCE_COLS).unionByName(std_diff_numeric(people, "treat", ["age_at_operation"])))


@register("std_diff_category", _recursive(oracle("SELECT * FROM balance", *FULL, DESCR_E, DESCR_U, PL_E, PL_U, BALANCE)))
def q_std_diff_category(spark, sf_dir):
    """A15 for 12 factors, and A14 for age: exposed against matched unexposed people at the event month."""
    return _balance(spark, sf_dir)


@register("category_balance", _recursive(oracle(
    f"SELECT c.*, b.std_diff, b.std_diff_lcl, b.std_diff_ucl FROM ({_cat_sql('unexposed_pl')}) c FULL JOIN balance b ON b.variable = c.Variable_names",
    *FULL, DESCR_E, DESCR_U, PL_E, PL_U, BALANCE)))
def q_category_balance(spark, sf_dir):
    """A11 with A15: the unexposed cohort's category counts beside the standardised difference of their attribute."""
    counts = _category_counts(person_level(spark, sf_dir, "unexposed"))
    return counts.join(_balance(spark, sf_dir).withColumnRenamed("variable", "Variable_names"), "Variable_names", "full")


@register("category_counts_unexposed", oracle(_cat_sql("unexposed_pl"), *FULL, DESCR_U, PL_U))
def q_category_counts_unexposed(spark, sf_dir):
    """A11 for the matched unexposed cohort."""
    return _category_counts(person_level(spark, sf_dir, "unexposed"))


# ------------------------------------------------------------------ numbering, sources and sinks, column helpers
@register("dense_id", oracle("""
SELECT census_id_final, six_month_num, treat, CAST(dense_rank() OVER (ORDER BY census_id_final NULLS LAST) AS BIGINT) AS id FROM six2""",
                             *FULL, SIX))
def q_dense_id(spark, sf_dir):
    """A dense number for each person of the six-month panel, without a global window."""
    from epicohort.operators.att import six_month_panel
    from epicohort.operators.numbering import dense_id
    s = study(spark, sf_dir)
    rows = s.kept("six_month", lambda: s.stage("six_month", six_month_panel(s.combined)))
    return dense_id(rows.select("census_id_final", "six_month_num", "treat"), "census_id_final")


@register("pruned_scan", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS epistart, year(o_orderdate) AS epi_year
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT'""")
def q_pruned_scan(spark, sf_dir):
    """Columns, a pushed predicate and computed columns of one scan."""
    from epicohort.sources.io import scan
    where = (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderpriority") == "1-URGENT")
    return scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"], where,
                {"epistart": F.col("o_orderdate").cast("date"), "epi_year": F.year("o_orderdate").cast("long")})


@register("view_sql", """
SELECT r_name, CAST(count(*) AS BIGINT) AS n_customers FROM customer
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def q_view_sql(spark, sf_dir):
    """SQL over tables registered as views."""
    from epicohort.sources.io import register_view, scan
    for name in ("customer", "nation", "region"):
        register_view(scan(spark, f"{sf_dir}/{name}.parquet"), f"view_sql_{name}")
    return spark.sql("""SELECT r_name, count(*) AS n_customers FROM view_sql_customer
        JOIN view_sql_nation ON n_nationkey = c_nationkey JOIN view_sql_region ON r_regionkey = n_regionkey GROUP BY r_name""")


@register("results_round_trip", oracle(f"SELECT c.*, 'exposed' AS cohort FROM ({_cat_sql('exposed_pl')}) c", FLAGGED, REG, LINK_E, PANEL_E, DESCR_E, PL_E))
def q_results_round_trip(spark, sf_dir):
    """A result table published as CSV in parallel files, read back by its manifest and types."""
    import os

    from epicohort.sources.io import read_results, scratch_root, write_results
    folder = os.path.join(scratch_root(spark), "results")
    write_results({"category_counts": _category_counts(person_level(spark, sf_dir))}, folder)
    back = read_results(spark, folder, "category_counts", schema="Variable_names string, Category_name string, Count double, Percentage double")
    return back.withColumn("Category_name", F.when(F.col("Variable_names") == "age_at_operation", F.lit("")).otherwise(F.col("Category_name"))) \
        .withColumn("cohort", F.lit("exposed"))


@register("code_lookup", """
SELECT p_partkey, p_brand, p_type, CASE p_type[1] WHEN 'E' THEN 'Economy' WHEN 'L' THEN 'Large' WHEN 'M' THEN 'Medium' WHEN 'P' THEN 'Promo'
       WHEN 'S' THEN 'Small or standard' END AS Name FROM part""")
def q_code_lookup(spark, sf_dir):
    """Codes of a table named by a CSV list that begins with a byte order mark."""
    import os

    from epicohort.sources.io import open_store, read_lookup, scratch_root
    listed = [("Economy", "E"), ("Large", "L"), ("Medium", "M"), ("Promo", "P"), ("Small or standard", "S")]
    store, root = open_store(scratch_root(spark))
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/codes.csv") as out:
        out.write(("\ufeffName,Code\n" + "".join(f"{n},{c}\n" for n, c in listed)).encode())
    codes = read_lookup(spark, os.path.join(scratch_root(spark), "codes.csv"), "Name string, Code string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("Code", F.left("p_type", F.lit(1)))
    return part.join(codes, "Code", "left").select("p_partkey", "p_brand", "p_type", "Name")


@register("column_sets", """
SELECT o_orderkey AS epikey, o_custkey AS census_id, CAST(o_orderdate AS DATE) AS start, o_totalprice AS pay, 1 AS treat FROM orders""")
def q_column_sets(spark, sf_dir):
    """Columns chosen, dropped and renamed by pattern, and constants."""
    from epicohort.functions.columns import drop_matching, rename_regex, select_matching, with_constants
    wide = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnsRenamed({
        "o_orderkey": "epi_key_x", "o_custkey": "census_id_x", "o_totalprice": "pay_x", "o_orderdate": "epi_start_x"})
    kept = drop_matching(select_matching(wide, r"_x$", keep=("o_orderstatus",)), "status")
    named = rename_regex(rename_regex(kept, "_x$", ""), "^epi_", "epi", prefix="epi").withColumnsRenamed({"epistart": "start"})
    return with_constants(named.withColumn("start", F.col("start").cast("date")), {"treat": 1}).select("epikey", "census_id", "start", "pay", "treat")


# the model fits register themselves over the names above
from epicohort.plans import models  # noqa: E402,F401
