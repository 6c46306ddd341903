"""Domain-shaped input tables derived from the driver's TPC-H-style tables.

The reference reads restricted registries (hospital episodes, two census
waves, death registrations, area lookups, monthly pay, births, a price
deflator).  FIXTURES.md part B fixes how tables of the same shape are made
from ``customer``, ``orders``, ``lineitem``, ``part``, ``nation`` and
``region``.  The derivations below are written in plain SQL that Spark and
DuckDB both accept, so the DuckDB oracle sees exactly the same input rows;
they only shape rows and do none of the study's work.
"""

from __future__ import annotations

import re

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

N_OP_SLOTS = 24
N_DIAG_SLOTS = 20

OP_COLS = [f"opertn_4_{i:02d}" for i in range(1, N_OP_SLOTS + 1)]
OPDATE_COLS = [f"opdate_{i:02d}" for i in range(1, N_OP_SLOTS + 1)]
DIAG_COLS = [f"diag_4_{i:02d}" for i in range(1, N_DIAG_SLOTS + 1)]
#: The families' names where they hold a slot for every line: lists in the oracle's tables, columns of ``FixtureTables.episode_lines``.
OP_CODES, OP_DATES, DIAG_CODES = "opertn_4", "opdate", "diag_4"
#: A line's place in its episode, from first to last key.
SLOT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def _wide(col: str, out: str, n: int) -> str:
    return ",\n".join(
        f"    max(CASE WHEN slot = {i} THEN {col} END) AS {out.format(i=i)}" for i in range(1, n + 1)
    )


# The wide form, with as many numbered columns as the reference's tables have: one
# episode per order, slot = position of the line inside its order; lines beyond the last
# column are not in it.  The study reads the lines themselves
# (FixtureTables.episode_lines), the oracle lists of all lines (EPISODE_LISTS_SQL).
EPISODES_SQL = f"""
SELECT o.o_orderkey AS epikey,
       CAST(o.o_orderdate AS DATE) AS epistart,
       greatest(CAST(o.o_orderdate AS DATE), e.last_ship) AS epiend,
       {", ".join(f"w.{c}" for c in OP_COLS)},
       {", ".join(f"w.{c}" for c in OPDATE_COLS)},
       {", ".join(f"w.{c}" for c in DIAG_COLS)},
       CASE WHEN o.o_custkey % 4 <> 0 THEN 'A' || CAST(o.o_custkey AS STRING) END AS census_person_id_2011,
       'B' || CAST(o.o_custkey AS STRING) AS census_id_2021
FROM orders o
LEFT JOIN (SELECT l_orderkey AS okey, max(CAST(l_shipdate AS DATE)) AS last_ship FROM lineitem GROUP BY l_orderkey) e
  ON e.okey = o.o_orderkey
LEFT JOIN (
  SELECT okey,
{_wide("op_code", "opertn_4_{i:02d}", N_OP_SLOTS)},
{_wide("ship", "opdate_{i:02d}", N_OP_SLOTS)},
{_wide("diag_code", "diag_4_{i:02d}", N_DIAG_SLOTS)}
  FROM (
    SELECT s.okey, s.slot, s.ship,
           p.p_brand || '-' || substr(p.p_type, 1, 1) AS op_code,
           p.p_type AS diag_code
    FROM (
      SELECT * FROM (
        SELECT l_orderkey AS okey, l_partkey AS partkey, CAST(l_shipdate AS DATE) AS ship,
               row_number() OVER (PARTITION BY l_orderkey
                                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS slot
        FROM lineitem
      ) numbered
      WHERE slot <= {N_OP_SLOTS}
    ) s
    LEFT JOIN part p ON p.p_partkey = s.partkey
  ) c
  GROUP BY okey
) w ON w.okey = o.o_orderkey
"""

_LINE_LIST = "list({} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"

#: The oracle's episodes (DuckDB): slot families as lists over all lines of the order.
EPISODE_LISTS_SQL = f"""
SELECT o.o_orderkey AS epikey, CAST(o.o_orderdate AS DATE) AS epistart,
       greatest(CAST(o.o_orderdate AS DATE), w.last_ship) AS epiend, w.opertn_4, w.opdate, w.diag_4,
       CASE WHEN o.o_custkey % 4 <> 0 THEN 'A' || CAST(o.o_custkey AS VARCHAR) END AS census_person_id_2011,
       'B' || CAST(o.o_custkey AS VARCHAR) AS census_id_2021
FROM orders o
LEFT JOIN (
  SELECT l_orderkey AS okey, max(CAST(l_shipdate AS DATE)) AS last_ship,
         {_LINE_LIST.format("p_brand || '-' || substr(p_type, 1, 1)")} AS opertn_4,
         {_LINE_LIST.format("CAST(l_shipdate AS DATE)")} AS opdate, {_LINE_LIST.format("p_type")} AS diag_4
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) w ON w.okey = o.o_orderkey
"""

_DOB = "(DATE '1940-01-15' + CAST(c_custkey * 37 % 14000 AS INT))"
_AREA = ("CASE WHEN c_nationkey % 7 = 6 THEN 'W' ELSE 'E' END || '{wave}' "
         "|| lpad(CAST(c_nationkey AS STRING), 3, '0')")

REGISTRY_2011_SQL = f"""
SELECT 'A' || CAST(c_custkey AS STRING) AS il4_person_id,
       CAST(1 + c_custkey % 2 AS INT) AS sex,
       CASE WHEN c_custkey % 23 = 0 THEN 'XX' ELSE lpad(CAST(1 + c_custkey % 19 AS STRING), 2, '0') END AS ethpuk11,
       CASE WHEN c_custkey % 17 = 0 THEN 'X' ELSE CAST(1 + c_custkey % 3 AS STRING) END AS disability,
       CASE WHEN c_custkey % 29 = 0 THEN 'XXXX'
            WHEN c_custkey % 13 = 1 THEN '14.1'
            WHEN c_custkey % 13 = 2 THEN '14.2'
            ELSE CAST(1 + c_custkey % 17 AS STRING) END AS nssec,
       CASE WHEN c_custkey % 11 = 0 THEN 'XX' ELSE CAST(10 + c_custkey % 7 AS STRING) END AS HLQPUK11,
       {_AREA.format(wave='0')} AS lsoa_code,
       CAST(1 + c_custkey % 9 AS STRING) AS MARSTAT,
       CASE WHEN c_custkey % 31 = 0 THEN 'X' ELSE CAST(1 + c_custkey % 9 AS STRING) END AS RELPUK11,
       CAST(year({_DOB}) AS STRING) || '-0' || CAST(quarter({_DOB}) AS STRING) AS dob_quarter,
       CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE 1 END AS present_in_cenmortlink,
       1 AS cen_pr_flag
FROM customer
WHERE c_custkey % 4 <> 0
"""

REGISTRY_2021_SQL = f"""
SELECT 'B' || CAST(c_custkey AS STRING) AS resident_id,
       CAST(1 + c_custkey % 2 AS INT) AS sex,
       CAST(CASE WHEN c_custkey % 23 = 0 THEN -8 ELSE 1 + c_custkey % 19 END AS INT) AS ethnic_group_tb,
       CAST(1 + c_custkey % 4 AS INT) AS disability,
       CAST(CASE WHEN c_custkey % 29 = 0 THEN -8 ELSE 1 + c_custkey % 16 END AS INT) AS ns_sec,
       CAST(CASE WHEN c_custkey % 11 = 0 THEN -8 ELSE c_custkey % 7 END AS INT) AS highest_qualification,
       {_AREA.format(wave='1')} AS dwelling_address_lsoa,
       CAST(1 + c_custkey % 11 AS INT) AS legal_partnership_status,
       CAST(1 + c_custkey % 9 AS INT) AS religion_tb,
       CAST(year({_DOB}) AS STRING) || '-Q' || CAST(quarter({_DOB}) AS STRING) AS dob_quarter,
       CAST(CASE WHEN c_custkey % 50 = 9 THEN 3 ELSE 1 + c_custkey % 2 END AS INT) AS proxy_answer,
       CASE WHEN c_custkey % 60 = 4 THEN 'not linked'
            WHEN c_custkey % 7 = 0 THEN 'linked to multiple nhs numbers'
            ELSE 'linked to one nhs number' END AS linked_to_pds_flag
FROM customer
"""

# Two death-registration sources with one column list (the reference has one
# table per registration year); some people appear twice.
_DEATH_COLS = """CAST(day(d) AS DOUBLE) AS doddy, CAST(month(d) AS DOUBLE) AS dodmt, CAST(year(d) AS DOUBLE) AS dodyr,
       'B' || CAST(k AS STRING) AS census2021_person_id,
       CASE WHEN k % 4 <> 0 THEN 'A' || CAST(k AS STRING) END AS census2011_person_id"""

DEATHS_FIRST_SQL = f"""
SELECT {_DEATH_COLS}
FROM (SELECT c_custkey AS k, DATE '1998-01-01' + CAST(c_custkey * 13 % 1500 AS INT) AS d
      FROM customer WHERE c_custkey % 10 = 3) t
"""

DEATHS_REPEAT_SQL = f"""
SELECT {_DEATH_COLS}
FROM (SELECT c_custkey AS k, DATE '1998-01-01' + CAST(c_custkey * 13 % 1500 + 30 + c_custkey % 300 AS INT) AS d
      FROM customer WHERE c_custkey % 20 = 3) t
"""

# Area lookups keyed by 2011 area code; nations with key % 5 = 0 own a second
# 2011 code, so the 2021 -> 2011 crosswalk fans out for them.
_AREA_CODES = """
SELECT n_nationkey AS nk, n_regionkey AS rk, r_name,
       CASE WHEN n_nationkey % 7 = 6 THEN 'W' ELSE 'E' END AS country,
       lpad(CAST(n_nationkey AS STRING), 3, '0') AS num
FROM nation JOIN region ON r_regionkey = n_regionkey
"""

CROSSWALK_SQL = f"""
SELECT country || '0' || num AS LSOA11CD, country || '1' || num AS LSOA21CD FROM ({_AREA_CODES}) a
UNION ALL
SELECT country || '2' || num AS LSOA11CD, country || '1' || num AS LSOA21CD FROM ({_AREA_CODES}) a WHERE nk % 5 = 0
"""

_ALL_2011 = f"""
SELECT country || '0' || num AS code, nk, rk, r_name FROM ({_AREA_CODES}) a
UNION ALL
SELECT country || '2' || num AS code, nk, rk, r_name FROM ({_AREA_CODES}) a WHERE nk % 5 = 0
"""

IMD_SQL = f"""
SELECT code AS LSOA11CD, CAST(1 + nk % 10 AS INT) AS IMD_DECILE, CAST(1 + nk % 5 AS INT) AS IMD_QUINTILE
FROM ({_ALL_2011}) t
"""

RURAL_URBAN_SQL = f"""
SELECT code AS LSOA11CD, 'R' || CAST(rk AS STRING) AS RUC11CD,
       CASE WHEN r_name LIKE 'A%' THEN 'Urban major conurbation'
            WHEN r_name LIKE 'E%' THEN 'Rural town and fringe'
            ELSE 'Unclassified ' || r_name END AS RUC11
FROM ({_ALL_2011}) t
"""

REGION_SQL = f"""
SELECT code AS LSOA11CD, r_name AS RGN20NM FROM ({_ALL_2011}) t
"""

# Person <-> pay identifier links, one table per census wave.
PERSON_IDS_2011_SQL = """
SELECT 'N' || CAST(c_custkey AS STRING) AS frameworks_nino, 'A' || CAST(c_custkey AS STRING) AS census_id,
       CASE WHEN c_custkey % 25 = 1 THEN 1 ELSE 0 END AS nino_contains_multiple_census_id
FROM customer WHERE c_custkey % 4 <> 0
UNION ALL
SELECT 'M' || CAST(c_custkey AS STRING), 'A' || CAST(c_custkey AS STRING), 0
FROM customer WHERE c_custkey % 4 <> 0
"""

PERSON_IDS_2021_SQL = """
SELECT 'N' || CAST(c_custkey AS STRING) AS frameworks_nino, 'B' || CAST(c_custkey AS STRING) AS census_id,
       CASE WHEN c_custkey % 25 = 1 THEN 1 ELSE 0 END AS nino_contains_multiple_census_id
FROM customer
UNION ALL
SELECT 'M' || CAST(c_custkey AS STRING), 'B' || CAST(c_custkey AS STRING), 0
FROM customer
"""

# Monthly measure per identifier and unpadded month label.
MONTHLY_PAY_SQL = """
SELECT valid_nino, month, sum(o_totalprice) AS pay, CAST(count(*) AS DOUBLE) AS days_worked
FROM (
  SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'M' ELSE 'N' END || CAST(o_custkey AS STRING) AS valid_nino,
         CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) AS month,
         o_totalprice
  FROM orders
) t
GROUP BY valid_nino, month
"""

# All dates of a person in one array, in no order.
BIRTHS_SQL = """
SELECT CASE WHEN o_custkey % 4 <> 0 THEN 'A' ELSE 'B' END || CAST(o_custkey AS STRING) AS baby_dob_census_id_final,
       array_agg(CAST(o_orderdate AS DATE)) AS baby_dobs
FROM orders
GROUP BY o_custkey
"""

DEFLATOR_SQL = """
SELECT m AS month, CAST(m AS STRING) AS month_org,
       CAST(1 + 0.002 * ((year(m) - 1995) * 12 + month(m) - 1) AS DOUBLE) AS cpih_deflator_2023
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) t
"""

FIXTURE_SQL = {
    "episodes": EPISODES_SQL,
    "registry_2011": REGISTRY_2011_SQL,
    "registry_2021": REGISTRY_2021_SQL,
    "deaths_first": DEATHS_FIRST_SQL,
    "deaths_repeat": DEATHS_REPEAT_SQL,
    "crosswalk": CROSSWALK_SQL,
    "imd": IMD_SQL,
    "rural_urban": RURAL_URBAN_SQL,
    "region_lookup": REGION_SQL,
    "person_ids_2011": PERSON_IDS_2011_SQL,
    "person_ids_2021": PERSON_IDS_2021_SQL,
    "monthly_pay": MONTHLY_PAY_SQL,
    "births": BIRTHS_SQL,
    "deflator": DEFLATOR_SQL,
}


def _suffix(sf_dir: str) -> str:
    import hashlib
    return hashlib.md5(sf_dir.encode()).hexdigest()[:10]


def register_driver_tables(spark: SparkSession, sf_dir: str) -> dict:
    """Expose the driver's parquet files as temp views named per input folder
    (two studies over different folders never see each other's tables).
    Column pruning and filter pushdown still reach the scans through the views."""
    names = {}
    for name in DRIVER_TABLES:
        view = f"{name}_{_suffix(sf_dir)}"
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
        names[name] = view
    return names


_TABLE_RX = re.compile(r"\b(" + "|".join(DRIVER_TABLES) + r")\b")


def bind_tables(sql: str, names: dict) -> str:
    """Point the fixture SQL's table names at one folder's views."""
    return _TABLE_RX.sub(lambda m: names[m.group(1)], sql)


class FixtureTables:
    """Lazily built domain tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.names = register_driver_tables(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.sql(bind_tables(FIXTURE_SQL[name], self.names))

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def episode_lines(self) -> DataFrame:
        """Every line of every order: epikey, its place (SLOT_ORDER) and its procedure code, date and diagnosis."""
        lines, parts = self.driver("lineitem"), self.driver("part")
        return lines.join(parts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("l_orderkey").alias("epikey"), *SLOT_ORDER,
            F.concat("p_brand", F.lit("-"), F.substring("p_type", 1, 1)).alias(OP_CODES),
            F.col("l_shipdate").cast("date").alias(OP_DATES), F.col("p_type").alias(DIAG_CODES))

    @cached_property
    def episode_heads(self) -> DataFrame:
        """One episode per order: epikey, its start and its person's ids (the end is in the lines)."""
        person = F.col("o_custkey").cast("string")
        return self.driver("orders").select(
            F.col("o_orderkey").alias("epikey"), F.col("o_orderdate").cast("date").alias("epistart"),
            F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("A"), person)).alias("census_person_id_2011"),
            F.concat(F.lit("B"), person).alias("census_id_2021"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self.table(name)
        raise AttributeError(name)


def oracle_ctes() -> str:
    """The same fixture tables as DuckDB CTE definitions (comma separated); episodes with lists of all lines."""
    tables = FIXTURE_SQL | {"episodes": EPISODE_LISTS_SQL}
    return ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in tables.items())
