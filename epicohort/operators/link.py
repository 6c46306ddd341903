"""Linkage of registries, deaths, identifiers and area lookups
(S4, P11, P12, P15, J1-J6, J9, J10, W4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicohort.config import StudyConfig
from epicohort.functions.dates import age_on, date_from_parts, dob_from_quarter
from epicohort.functions.recode import between_both, classify_regex, recode_2011, recode_2021

# Area lookups (crosswalk, deprivation, rural/urban, region) have one row per
# small area: their size is fixed by geography, not by the data volume, so
# they are broadcast.


def scan_union(frames: Sequence[DataFrame], cols: Sequence[str] | None = None) -> DataFrame:
    """UNION ALL of same-shaped sources (e.g. yearly tables) by name."""
    if cols:
        frames = [f.select(*cols) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def quality_filter(df: DataFrame, allowed: dict) -> DataFrame:
    """Keep rows whose provenance columns hold allowed values, then drop those columns."""
    cond = F.lit(True)
    for col, values in allowed.items():
        cond = cond & F.col(col).isin(list(values))
    return df.where(cond).drop(*allowed)


_RAW_2011 = ["ethpuk11", "nssec", "HLQPUK11", "MARSTAT", "RELPUK11", "disability", "sex",
             "carer", "HHCHUK11", "DPCFAMUK11"]
_RAW_2021 = ["disability", "is_carer", "sex"]


def prepare_registry_2011(reg: DataFrame) -> DataFrame:
    reg = quality_filter(reg, {"present_in_cenmortlink": [1], "cen_pr_flag": [1]})
    reg = recode_2011(reg.withColumn("prov_dob", dob_from_quarter(F.col("dob_quarter"), "0n")))
    return (reg.withColumnsRenamed({"il4_person_id": "census_id_final", "lsoa_code": "lsoa_census"})
               .drop(*[c for c in _RAW_2011 if c in reg.columns]))


def prepare_registry_2021(reg: DataFrame) -> DataFrame:
    reg = quality_filter(reg, {"proxy_answer": [1, 2],
                               "linked_to_pds_flag": ["linked to one nhs number",
                                                      "linked to multiple nhs numbers"]})
    reg = recode_2021(reg.withColumn("prov_dob", dob_from_quarter(F.col("dob_quarter"), "Q")))
    return (reg.withColumnsRenamed({"resident_id": "census_id_final", "dwelling_address_lsoa": "lsoa_census"})
               .drop(*[c for c in _RAW_2021 if c in reg.columns]))


def tag_routes(routes: dict, flag_col: str = "census_id_flag") -> DataFrame:
    """Union of per-route tables, each tagged with its route value."""
    return scan_union([t.withColumn(flag_col, F.lit(v)) for v, t in routes.items()])


def link_two_route(df: DataFrame, routes: dict, how: str = "inner", flag_col: str = "census_id_flag",
                   id_col: str = "census_id_final") -> DataFrame:
    """Link each row through the table of its route.  One join on
    (route, id) against the tagged union replaces split + two joins + union."""
    return df.join(tag_routes(routes, flag_col), on=[flag_col, id_col], how=how)


def deaths_with_dates(sources: Sequence[DataFrame]) -> DataFrame:
    cols = ["doddy", "dodmt", "dodyr", "census2021_person_id", "census2011_person_id"]
    d = scan_union(sources, cols)
    return d.withColumn("dod", date_from_parts(F.col("dodyr"), F.col("dodmt"), F.col("doddy"))).drop(
        "doddy", "dodmt", "dodyr")


def earliest_by(df: DataFrame, id_col: str, date_col: str) -> DataFrame:
    """Earliest date per id (ties collapse to one row)."""
    return df.groupBy(id_col).agg(F.min(date_col).alias(date_col)).where(F.col(date_col).isNotNull())


def death_routes(deaths: DataFrame) -> dict:
    """Earliest death per person id for both routes: wave-A id when present,
    else wave-B id."""
    a = earliest_by(deaths.where(F.col("census2011_person_id").isNotNull())
                    .select(F.col("census2011_person_id").alias("census_id_final"), "dod"),
                    "census_id_final", "dod")
    b = earliest_by(deaths.where(F.col("census2011_person_id").isNull() & F.col("census2021_person_id").isNotNull())
                    .select(F.col("census2021_person_id").alias("census_id_final"), "dod"),
                    "census_id_final", "dod")
    return {1: a, 0: b}


def crosswalk(df: DataFrame, xwalk: DataFrame, col: str = "lsoa_census", from_col: str = "LSOA21CD",
              to_col: str = "LSOA11CD", when=None, first: str | None = None) -> DataFrame:
    """Map codes of one route through a one-to-many crosswalk (rows fan out).
    ``first`` names a column to add that is 1 on one of the rows a row has become and
    0 on the others, so that rows before the step can still be counted."""
    when = when if when is not None else (F.col("census_id_flag") == 0)
    x = xwalk.select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to"))
    if first is not None:  # the lookup has one row per small area, and few of one code
        nth = F.row_number().over(Window.partitionBy("_from").orderBy("_to"))
        x = x.withColumn("_first", F.when(nth == 1, 1).otherwise(0))
    joined = df.join(x, when & (F.col(col) == F.col("_from")), "left")
    if first is not None:
        joined = joined.withColumn(first, F.coalesce("_first", F.lit(1))).drop("_first")
    return joined.withColumn(col, F.when(when, F.col("_to")).otherwise(F.col(col))).drop("_from", "_to")


def final_area(df: DataFrame, own: str = "lsoa11", registry: str = "lsoa_census", out: str = "lsoa_final") -> DataFrame:
    """The episode's own area code where there is one, else the registry's; without
    such a column, the registry's."""
    return df.withColumn(out, F.coalesce(own, registry) if own in df.columns else F.col(registry))


def enrich_areas(df: DataFrame, imd: DataFrame, ruc: DataFrame, region: DataFrame,
                 area_col: str = "lsoa_final") -> DataFrame:
    """J2 + P13: deprivation, rural/urban class (regex, 'Error' default) and region."""
    imd = imd.select(F.col("LSOA11CD").alias("_a1"), F.col("IMD_DECILE").alias("imd_decile"),
                     F.col("IMD_QUINTILE").alias("imd_quintile"))
    ruc = ruc.select(F.col("LSOA11CD").alias("_a2"), F.col("RUC11CD").alias("ruc11cd"), F.col("RUC11").alias("ruc11"),
                     classify_regex(F.col("RUC11"), [("Urban", "Urban"), ("Rural", "Rural")]).alias("rural_urban"))
    reg = region.select(F.col("LSOA11CD").alias("_a3"), F.col("RGN20NM").alias("region"))
    out = df
    for t, k in ((imd, "_a1"), (ruc, "_a2"), (reg, "_a3")):
        out = out.join(t, F.col(area_col) == F.col(k), "left").drop(k)
    return out


def add_index_ages(df: DataFrame, op: str = "op_date", dob: str = "prov_dob") -> DataFrame:
    """L6 twice: age on the index date and on the last day of its month."""
    return df.withColumns({
        "age_at_operation": age_on(F.col(op), F.col(dob)),
        "age_on_last_day_op_month": age_on(F.last_day(F.col(op)), F.col(dob)),
    })


def in_country(area: str = "lsoa_final", prefix: str = "E") -> Column:
    """Areas of one country, by the first letter of their code."""
    return F.substring(F.col(area), 1, 1) == prefix


def in_working_age(cfg: StudyConfig) -> Column:
    """Both ages inside the working-age range (inclusive)."""
    lo, hi = cfg.working_age
    return between_both([F.col("age_at_operation"), F.col("age_on_last_day_op_month")], lo, hi)


def is_alive_after_index(op: str = "op_date") -> Column:
    """No death, or death after the end of the index month."""
    return F.col("dod").isNull() | (F.col("dod") > F.last_day(F.col(op)))


def working_age(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    return df.where(in_working_age(cfg))


def alive_after_index(df: DataFrame, op: str = "op_date") -> DataFrame:
    return df.where(is_alive_after_index(op))


def deflate(df: DataFrame, deflator: DataFrame, pay_col: str, out: str = "pay_deflated",
            label_col: str = "month_label") -> DataFrame:
    """Month-keyed deflator join (one row per month: bounded) and division."""
    d = deflator.select(F.col("month").alias("_dm"), F.col("cpih_deflator_2023").alias("_defl"))
    month = F.to_date(F.concat(F.col(label_col), F.lit("-01")), "yyyy-M-dd")
    return (df.join(d, month == F.col("_dm"), "left")
              .withColumn(out, F.col(pay_col) / F.col("_defl")).drop("_dm", "_defl"))
