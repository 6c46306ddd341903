"""SURVEY section 5 properties on the smallest tables."""
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_panel_unique_on_person_month(spark):
    p = E.queries()["month_panel"](spark, SF)
    assert p.groupBy("census_id_final", "ref_date").count().where(F.col("count") > 1).count() == 0


def test_flow_counts_never_increase(spark):
    rows = sorted(E.queries()["sample_flow"](spark, SF).collect(), key=lambda r: r.step)
    for a, b in zip(rows, rows[1:]):
        assert b.n_rows <= a.n_rows and b.n_ids <= a.n_ids


def test_sample_no_larger_than_targets(spark):
    s = E.queries()["stratified_sample"](spark, SF)
    shares = E.queries()["strata_shares"](spark, SF)
    from epicohort.plans.queries import SAMPLE_TOTAL
    want = {(r.census_sex, r.five_year_bands): round(SAMPLE_TOTAL * r.prop) for r in shares.collect()}
    got = {(r.census_sex, r.five_year_bands): r["count"] for r in s.groupBy("census_sex", "five_year_bands").count().collect()}
    assert all(got[k] <= want[k] for k in got)
