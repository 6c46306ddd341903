"""DuckDB SQL fragments for the oracle side of the registered queries.

These are written the way the reference writes its rules (OR ladders, CASE
ladders, two-step window filters), independently of the Spark operators,
so the comparison checks the library's work rather than repeating it."""

from __future__ import annotations

import datetime as dt

from epicohort.config import StudyConfig
from epicohort.functions import recode as R


def d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def in_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in sorted(values)) + ")"


def mb(a: str, b: str) -> str:
    """Spark months_between(a, b) for DATE arguments."""
    whole = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    return (f"(CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b})) "
            f"THEN CAST({whole} AS DOUBLE) ELSE round({whole} + (day({a}) - day({b})) / 31.0, 8) END)")


def month_no(x: str) -> str:
    return f"(year({x}) * 12 + month({x}) - 1)"


def age(day: str, dob: str) -> str:
    return (f"CAST(year({day}) - year({dob}) - CASE WHEN strftime({day}, '%m-%d') < strftime({dob}, '%m-%d') "
            f"THEN 1 ELSE 0 END AS INTEGER)")


def label(x: str) -> str:
    return f"(CAST(year({x}) AS VARCHAR) || '-' || CAST(month({x}) AS VARCHAR))"


def ranges_sql(x: str, spec, default=R.MISSING, half_open=False) -> str:
    parts = []
    for lo, hi, lab in spec:
        conds = []
        if lo is not None:
            conds.append(f"{x} >= {lo}")
        if hi is not None:
            conds.append(f"{x} < {hi}" if half_open else f"{x} <= {hi}")
        parts.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN '{lab}'")
    dflt = "NULL" if default is None else f"'{default}'"
    return f"(CASE {' '.join(parts)} ELSE {dflt} END)"


def exact_sql(x: str, mapping, default=R.MISSING) -> str:
    parts = []
    for values, lab in mapping:
        vals = values if isinstance(values, tuple) else (values,)
        parts.append(f"WHEN {x} IN ({', '.join(str(v) for v in vals)}) THEN '{lab}'")
    dflt = "NULL" if default is None else f"'{default}'"
    return f"(CASE {' '.join(parts)} ELSE {dflt} END)"


def num(col: str) -> str:
    return f"TRY_CAST(CAST({col} AS VARCHAR) AS DOUBLE)"


def listed_slots(cfg: StudyConfig) -> str:
    """The (code, date) pairs of an episode's slots with a listed procedure, in slot order."""
    return f"list_filter(list_zip(opertn_4, opdate), lambda z: z[1] IN {in_list(cfg.procedure_codes)})"


def flagged_ctes(cfg: StudyConfig) -> str:
    dg, ac = in_list(cfg.diag_codes), in_list(cfg.associated_codes)
    lookup = ", ".join(f"('{k}', '{v}')" for k, v in sorted(cfg.procedure_codes.items()))
    s, e = d(cfg.follow_up_start), d(cfg.follow_up_end)
    endc = cfg.in_window_end_col
    return f"""
fl0 AS (
  SELECT e.*,
    CASE WHEN diag_4[1] IN {dg} THEN 1 ELSE 0 END AS primary_obesity_flag,
    CASE WHEN NOT (diag_4[1] IN {dg}) AND len(list_filter(diag_4[2:], lambda x: x IN {dg})) > 0 THEN 1 ELSE 0 END AS secondary_obesity_flag,
    CASE WHEN diag_4[1] IN {ac} THEN 1 ELSE 0 END AS associated_cond_flag,
    CASE WHEN len({listed_slots(cfg)}) > 0 THEN 1 ELSE 0 END AS metabolic_op_flag,
    CASE WHEN census_person_id_2011 IS NOT NULL THEN 1 ELSE 0 END AS census_id_flag
  FROM episodes e),
fl1 AS (
  SELECT *, CASE WHEN census_id_flag = 1 THEN census_person_id_2011 ELSE census_id_2021 END AS census_id_final,
    CASE WHEN epistart < {s} AND metabolic_op_flag = 1 THEN 1 ELSE 0 END AS previous_surgery,
    CASE WHEN epistart >= {s} AND {endc} < {e} AND metabolic_op_flag = 1 THEN 1 ELSE 0 END AS surgery_in_follow_up
  FROM fl0),
flagged AS (
  SELECT *,
    CASE WHEN census_id_final IS NULL THEN NULL
         ELSE CASE WHEN sum(previous_surgery) OVER (PARTITION BY census_id_final) >= 1 THEN 1 ELSE 0 END END
      AS any_prev_metab_surgery_flag,
    CASE WHEN census_id_final IS NULL THEN NULL
         ELSE CASE WHEN sum(surgery_in_follow_up) OVER (PARTITION BY census_id_final) >= 1 THEN 1 ELSE 0 END END
      AS any_metabolic_op_flag_in_dates
  FROM fl1),
proc_lookup AS (SELECT * FROM (VALUES {lookup}) t(Code, Name)),
proc AS (
  SELECT f.*, {listed_slots(cfg)}[1][1] AS op_code, {listed_slots(cfg)}[1][2] AS op_date0
  FROM flagged f
  WHERE census_id_final IS NOT NULL
    AND epistart >= {s} AND {endc} < {e} AND epiend > {d(cfg.episode_end_guard)}
    AND metabolic_op_flag = 1 AND any_prev_metab_surgery_flag = 0
    AND (primary_obesity_flag = 1 OR (secondary_obesity_flag = 1 AND associated_cond_flag = 1))),
proc2 AS (
  SELECT p.*, lk.Name AS operation_type,
         CASE WHEN op_date0 < {d(cfg.sentinel_cutoff)} THEN epistart ELSE op_date0 END AS op_date
  FROM proc p LEFT JOIN proc_lookup lk ON lk.Code = p.op_code),
idx1 AS (
  SELECT * FROM proc2
  QUALIFY epistart = min(epistart) OVER (PARTITION BY census_id_final)
      AND epiend = min(epiend) OVER (PARTITION BY census_id_final)),
idx2 AS (SELECT * FROM idx1 QUALIFY op_date = min(op_date) OVER (PARTITION BY census_id_final, epistart, epiend)),
exposed AS (SELECT * FROM idx2 QUALIFY epikey = max(epikey) OVER (PARTITION BY census_id_final, epistart, epiend)),
psurg AS (
  SELECT census_person_id_2011 AS census_id_final, max(previous_surgery) AS ap, max(surgery_in_follow_up) AS ai
  FROM flagged WHERE census_person_id_2011 IS NOT NULL GROUP BY census_person_id_2011),
unexposed AS (
  SELECT r.il4_person_id AS census_id_final, 1 AS census_id_flag FROM registry_2011 r
  WHERE NOT EXISTS (SELECT 1 FROM psurg s WHERE s.census_id_final = r.il4_person_id AND (s.ap = 1 OR s.ai = 1)))"""


def distribution_ctes(cfg: StudyConfig) -> str:
    o = cfg.origin
    o_no = o.year * 12 + o.month - 1
    mid = dt.date(o.year, o.month, 15)
    from epicohort.functions.draws import duckdb_draw
    return f"""
dist0 AS (SELECT {month_no('op_date')} - {o_no} AS op_month, count(*) AS op_count FROM exposed GROUP BY op_month),
dist1 AS (
  SELECT op_month, op_count,
         avg(op_count) OVER (ORDER BY op_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS op_count_smooth,
         sum(op_count) OVER () AS total
  FROM dist0),
dist2 AS (
  SELECT *, sum(op_count_smooth) OVER (ORDER BY op_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / total AS mcp
  FROM dist1),
dist AS (
  SELECT op_month, op_count, op_count_smooth,
         coalesce(lag(mcp) OVER (ORDER BY op_month), 0.0) AS min_cum_prop,
         CASE WHEN op_month = max(op_month) OVER () THEN 1.0 ELSE mcp END AS max_cum_prop
  FROM dist2),
unexposed_dated AS (
  SELECT x.census_id_final, x.census_id_flag, d.op_month,
         CAST({d(mid)} + to_months(CAST(d.op_month AS INTEGER)) AS DATE) AS op_date
  FROM (SELECT *, {duckdb_draw('census_id_final', cfg.seed)} AS u FROM unexposed) x
  JOIN dist d ON x.u > d.min_cum_prop AND x.u <= d.max_cum_prop)"""


def recode_2011_sql() -> str:
    dis = num("disability")
    ns = num("nssec")
    ns_case = ("(CASE " + " ".join(f"WHEN {ns} >= {lo} AND {ns} < {hi} THEN '{lab}'" for lo, hi, lab in R.NSSEC_2011_HALF_OPEN)
               + " " + " ".join(f"WHEN {ns} = {v} THEN '{lab}'" for v, lab in R.NSSEC_2011_EXACT)
               + " " + " ".join(f"WHEN {ns} >= {lo} AND {ns} < {hi} THEN '{lab}'" for lo, hi, lab in R.NSSEC_2011_TAIL)
               + f" ELSE '{R.MISSING}' END)")
    return f"""
      {exact_sql(num('sex'), list(R.SEX_2011.items()), None)} AS census_sex,
      {ranges_sql(num('ethpuk11'), R.ETHNIC_2011)} AS ethnic_group_tb,
      {ranges_sql(dis, R.DISABILITY_2011)} AS disability_category,
      CASE WHEN {dis} >= 1 AND {dis} <= 2 THEN 1 ELSE 0 END AS disability_binary,
      {ns_case} AS ns_sec,
      {exact_sql(num('RELPUK11'), [(i + 1, lab) for i, lab in enumerate(R.RELIGION_LABELS)])} AS religion_tb,
      {exact_sql(num('HLQPUK11'), [(i + 10, lab) for i, lab in enumerate(R.QUALIFICATION_LABELS)])} AS highest_qualification,
      {exact_sql(num('MARSTAT'), R.PARTNERSHIP_2011)} AS legal_partnership_status,
      TRY_CAST(CASE WHEN substr(dob_quarter, 6, 2) = '01' THEN substr(dob_quarter, 1, 5) || '02-15'
                    WHEN substr(dob_quarter, 6, 2) = '02' THEN substr(dob_quarter, 1, 5) || '05-15'
                    WHEN substr(dob_quarter, 6, 2) = '03' THEN substr(dob_quarter, 1, 5) || '08-15'
                    WHEN substr(dob_quarter, 6, 2) = '04' THEN substr(dob_quarter, 1, 5) || '11-15' END AS DATE) AS prov_dob"""


def recode_2021_sql() -> str:
    dis = num("disability")
    return f"""
      {exact_sql(num('sex'), list(R.SEX_2021.items()), None)} AS census_sex,
      {ranges_sql(num('ethnic_group_tb'), R.ETHNIC_2021)} AS ethnic_group_tb,
      {ranges_sql(dis, R.DISABILITY_2021)} AS disability_category,
      CASE WHEN {dis} >= 1 AND {dis} <= 2 THEN 1 ELSE 0 END AS disability_binary,
      {ranges_sql(num('ns_sec'), R.NSSEC_2021)} AS ns_sec,
      {exact_sql(num('religion_tb'), [(i + 1, lab) for i, lab in enumerate(R.RELIGION_LABELS)])} AS religion_tb,
      {exact_sql(num('highest_qualification'), [(i, lab) for i, lab in enumerate(R.QUALIFICATION_LABELS)])} AS highest_qualification,
      {ranges_sql(num('legal_partnership_status'), R.PARTNERSHIP_2021)} AS legal_partnership_status,
      TRY_CAST(CASE WHEN contains(dob_quarter, 'Q1') THEN substr(dob_quarter, 1, 5) || '02-15'
                    WHEN contains(dob_quarter, 'Q2') THEN substr(dob_quarter, 1, 5) || '05-15'
                    WHEN contains(dob_quarter, 'Q3') THEN substr(dob_quarter, 1, 5) || '08-15'
                    WHEN contains(dob_quarter, 'Q4') THEN substr(dob_quarter, 1, 5) || '11-15' END AS DATE) AS prov_dob"""


REG_ATTRS = ["census_sex", "ethnic_group_tb", "disability_category", "disability_binary", "ns_sec", "religion_tb",
             "highest_qualification", "legal_partnership_status", "prov_dob", "dob_quarter", "lsoa_census"]


def registry_ctes() -> str:
    return f"""
reg11 AS (
  SELECT il4_person_id AS census_id_final, 1 AS census_id_flag, {recode_2011_sql()},
         dob_quarter, lsoa_code AS lsoa_census
  FROM registry_2011 WHERE present_in_cenmortlink = 1 AND cen_pr_flag = 1),
reg21 AS (
  SELECT resident_id AS census_id_final, 0 AS census_id_flag, {recode_2021_sql()},
         dob_quarter, dwelling_address_lsoa AS lsoa_census
  FROM registry_2021
  WHERE proxy_answer IN (1, 2) AND linked_to_pds_flag IN ('linked to one nhs number', 'linked to multiple nhs numbers')),
regs AS (SELECT * FROM reg11 UNION ALL SELECT * FROM reg21),
deaths_d AS (
  SELECT make_date(CAST(dodyr AS INTEGER), CAST(dodmt AS INTEGER), CAST(doddy AS INTEGER)) AS dod,
         census2011_person_id, census2021_person_id
  FROM (SELECT * FROM deaths_first UNION ALL SELECT * FROM deaths_repeat) t),
dth AS (
  SELECT census2011_person_id AS census_id_final, 1 AS census_id_flag, min(dod) AS dod FROM deaths_d
  WHERE census2011_person_id IS NOT NULL GROUP BY census2011_person_id
  UNION ALL
  SELECT census2021_person_id, 0, min(dod) FROM deaths_d
  WHERE census2011_person_id IS NULL AND census2021_person_id IS NOT NULL GROUP BY census2021_person_id),
births_long AS (SELECT baby_dob_census_id_final AS pid, unnest(baby_dobs) AS d FROM births),
links AS (
  SELECT 1 AS census_id_flag, census_id AS census_id_final, frameworks_nino AS valid_nino
  FROM person_ids_2011 WHERE nino_contains_multiple_census_id = 0
  UNION ALL
  SELECT 0, census_id, frameworks_nino FROM person_ids_2021 WHERE nino_contains_multiple_census_id = 0),
pm AS (
  SELECT k.census_id_flag, k.census_id_final, p.month AS month_label,
         sum(greatest(coalesce(p.pay, 0.0), 0.0)) AS pay, sum(coalesce(p.days_worked, 0.0)) AS days_worked
  FROM links k JOIN monthly_pay p ON p.valid_nino = k.valid_nino
  GROUP BY k.census_id_flag, k.census_id_final, p.month)"""


def linked_ctes(x: str, cfg: StudyConfig, own_area: bool = False) -> str:
    """``own_area``: the people carry an area of their own (lsoa11), which goes before the registry's."""
    lo, hi = cfg.working_age
    area = "coalesce(lsoa11, lsoa_census)" if own_area else "lsoa_census"
    ra = ", ".join(f"r.{c}" for c in REG_ATTRS)
    return f"""
{x}_l1 AS (SELECT x.*, {ra} FROM {x} x JOIN regs r USING (census_id_flag, census_id_final)),
{x}_l2 AS (SELECT a.*, t.dod FROM {x}_l1 a LEFT JOIN dth t USING (census_id_flag, census_id_final)),
{x}_l3 AS (
  SELECT a.* REPLACE (CASE WHEN a.census_id_flag = 0 THEN c.LSOA11CD ELSE a.lsoa_census END AS lsoa_census)
  FROM {x}_l2 a LEFT JOIN crosswalk c ON a.census_id_flag = 0 AND c.LSOA21CD = a.lsoa_census),
{x}_l4 AS (SELECT *, {area} AS lsoa_final FROM {x}_l3 WHERE substr({area}, 1, 1) = 'E'),
{x}_l5 AS (
  SELECT a.*, i.IMD_DECILE AS imd_decile, i.IMD_QUINTILE AS imd_quintile, u.RUC11CD AS ruc11cd, u.RUC11 AS ruc11,
         CASE WHEN u.LSOA11CD IS NULL THEN NULL  -- classified in the lookup: an area that is not in it has no class
              WHEN regexp_matches(u.RUC11, 'Urban') THEN 'Urban' WHEN regexp_matches(u.RUC11, 'Rural') THEN 'Rural'
              ELSE 'Error' END AS rural_urban,
         g.RGN20NM AS region
  FROM {x}_l4 a LEFT JOIN imd i ON i.LSOA11CD = a.lsoa_final
  LEFT JOIN rural_urban u ON u.LSOA11CD = a.lsoa_final LEFT JOIN region_lookup g ON g.LSOA11CD = a.lsoa_final),
{x}_l6 AS (
  SELECT *, {age('op_date', 'prov_dob')} AS age_at_operation,
         {age('last_day(op_date)', 'prov_dob')} AS age_on_last_day_op_month
  FROM {x}_l5),
{x}_linked AS (
  SELECT * FROM {x}_l6
  WHERE age_at_operation BETWEEN {lo} AND {hi} AND age_on_last_day_op_month BETWEEN {lo} AND {hi}
    AND (dod IS NULL OR dod > last_day(op_date)))"""


def panel_ctes(x: str, cfg: StudyConfig) -> str:
    s, e = cfg.spine_bounds
    first = dt.date(s.year, s.month, 1)
    last_idx = e.year * 12 + e.month - 2
    last = dt.date(last_idx // 12, last_idx % 12 + 1, 1)
    alo, ahi = cfg.panel_age
    tlo, thi = cfg.event_window
    bands = ranges_sql("age_at_operation", R.TEN_YEAR_BANDS, R.TEN_YEAR_DEFAULT, half_open=True)

    def births(lo, hi):
        return (f"EXISTS (SELECT 1 FROM births_long bl WHERE bl.pid = a.census_id_final AND {mb('ref_date', 'bl.d')} >= {lo} "
                f"AND {mb('ref_date', 'bl.d')} < {hi})")
    return f"""
{x}_p0 AS (SELECT * FROM {x}_linked QUALIFY row_number() OVER (PARTITION BY census_id_final ORDER BY lsoa_final NULLS LAST) = 1),
{x}_p1 AS (
  SELECT p.*, {bands} AS age_bands FROM {x}_p0 p
  WHERE EXISTS (SELECT 1 FROM links k WHERE k.census_id_flag = p.census_id_flag AND k.census_id_final = p.census_id_final)),
{x}_p2 AS (SELECT * FROM {x}_p1),
{x}_p3 AS (
  SELECT p.*, s.ref_date,
         {month_no('s.ref_date')} - {month_no('p.op_date')} + 1 AS t_op,
         {label('s.ref_date')} AS month_label,
         {age('s.ref_date', 'p.prov_dob')} AS age_monthly
  FROM {x}_p2 p, (SELECT CAST(last_day(CAST(m AS DATE)) AS DATE) AS ref_date
                  FROM generate_series({d(first)}, {d(last)}, INTERVAL 1 MONTH) g(m)) s),
{x}_p4 AS (SELECT * FROM {x}_p3 WHERE (dod IS NULL OR dod > ref_date) AND age_monthly BETWEEN {alo} AND {ahi}
           AND t_op BETWEEN {tlo} AND {thi}),
{x}_panel AS (
  SELECT a.*,
         coalesce(m.pay, 0.0) AS pay, coalesce(m.days_worked, 0.0) AS days_worked,
         CASE WHEN m.pay IS NULL THEN 0 ELSE 1 END AS paye_flag,
         CASE WHEN {births(0, 12)} THEN 1 ELSE 0 END AS birth_in_1yr,
         CASE WHEN {births(12, 60)} THEN 1 ELSE 0 END AS birth_in_5yr
  FROM {x}_p4 a LEFT JOIN pm m USING (census_id_flag, census_id_final, month_label))"""
