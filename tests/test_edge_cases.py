"""Hand-made tables for the semantic traps (FIXTURES part C)."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from epicohort.config import FIXTURE_CONFIG
from epicohort.functions.dates import age_on, event_time
from epicohort.functions.draws import uniform_draw
from epicohort.functions.recode import recode_2011
from epicohort.functions.slots import secondary_only
from epicohort.operators import cohort as C
from epicohort.operators.describe import rolling_mean
from epicohort.operators.flow import flow_counts
from epicohort.operators.panel import combine_ids, event_bins
from epicohort.operators import quantiles
from epicohort.operators.quantiles import exact_quantiles
from epicohort.operators.sample import stratified_sample

D = dt.date


def test_no_joint_minimum_drops_person(spark):
    df = spark.createDataFrame([("p", 1, 1, 9), ("p", 2, 2, 3)], "census_id_final string, epikey int, epistart int, epiend int")
    assert C.index_event(df).count() == 0


def test_key_tie_break_keeps_largest_key(spark):
    df = spark.createDataFrame([("p", 5, 1, 2, D(2015, 1, 1)), ("p", 7, 1, 2, D(2015, 1, 1))],
                               "census_id_final string, epikey int, epistart int, epiend int, op_date date")
    out = C.tie_break(C.index_event(df), ["census_id_final", "epistart", "epiend"])
    assert [r.epikey for r in out.collect()] == [7]


def test_null_first_diagnosis_gives_zero(spark):
    df = spark.createDataFrame([(None, "E66")], "d1 string, d2 string")
    assert df.select(secondary_only(["d1", "d2"], ["E66"]).alias("f")).first().f == 0


def test_null_ids_count_as_one_id(spark):
    df = spark.createDataFrame([(None,), (None,), (None,), ("a",)], "id string")
    r = flow_counts(df, "id", [("all", None), ("with id", F.col("id").isNotNull())]).orderBy("step").collect()
    assert (r[0].n_rows, r[0].n_ids) == (4, 2)
    assert (r[1].n_rows, r[1].n_ids) == (1, 1)


def test_steps_without_a_filter_hold_rows_that_fail_later(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), (None, 0)], "id string, ok int")
    r = flow_counts(df, "id", [("all", None), ("joined", None), ("ok", F.col("ok") == 1)]).orderBy("step").collect()
    assert [(x.n_rows, x.n_ids) for x in r] == [(3, 3), (3, 3), (1, 1)]


def test_steps_before_a_fan_out_count_the_rows_of_then(spark):
    from epicohort.operators.link import crosswalk
    df = spark.createDataFrame([("p", 0, "X21"), ("p", 0, "X21"), ("q", 1, "Y11"), ("r", 0, None), (None, 0, "Z")],
                               "census_id_final string, census_id_flag int, lsoa_census string")
    xw = spark.createDataFrame([("A11", "X21"), ("B11", "X21"), (None, "X21"), ("Y11", "Y21"), ("C", None)],
                               "LSOA11CD string, LSOA21CD string")
    plain = crosswalk(df, xw)
    out = crosswalk(df, xw, first="one")
    assert sorted(map(str, out.drop("one").collect())) == sorted(map(str, plain.collect()))
    steps = [("people", None, F.col("one")), ("areas", None), ("area A11", F.col("lsoa_census") == "A11")]
    r = flow_counts(out, "census_id_final", steps, first_step=5).orderBy("step").collect()
    assert [(x.step, x.n_rows, x.n_ids) for x in r] == [(5, 5, 4), (6, 9, 4), (7, 2, 1)]


def test_flow_of_an_empty_frame_is_zero(spark):
    df = spark.createDataFrame([], "id string, n int")
    r = flow_counts(df, "id", [("all", None, F.col("n")), ("some", F.col("n") > 0)]).orderBy("step").collect()
    assert [(x.n_rows, x.n_ids) for x in r] == [(0, 0), (0, 0)]


def test_recode_markers_never_raise(spark):
    df = spark.createDataFrame([(c, c, c, c, c, c, "1") for c in ("XX", "X", "XXXX", None)] +
                               [("1", "1", "14.1", "10", "1", "1", "2"), ("1", "1", "14.2", "10", "1", "1", "2")],
                               "ethpuk11 string, disability string, nssec string, HLQPUK11 string, MARSTAT string, "
                               "RELPUK11 string, sex string")
    rows = recode_2011(df).select("ns_sec", "ethnic_group_tb").collect()
    assert rows[0].ns_sec == "Missing or not stated" and rows[0].ethnic_group_tb == "Missing or not stated"
    assert rows[4].ns_sec == "Never worked" and rows[5].ns_sec == "Long-term unemployed"


def test_sentinel_imputation(spark):
    df = spark.createDataFrame([(D(1800, 1, 1), D(2015, 3, 1)), (None, D(2015, 3, 1))], "op_date date, epistart date")
    out = [r.d for r in df.select(C.impute_sentinel("op_date", D(1850, 1, 1), "epistart").alias("d")).collect()]
    assert out == [D(2015, 3, 1), None]


def test_event_time_around_event_month(spark):
    refs = [D(2014, 4, 30), D(2014, 5, 31), D(2014, 6, 30), D(2014, 7, 31)]
    df = spark.createDataFrame([(r, D(2014, 6, 30)) for r in refs], "ref date, ev date")
    assert [r.t for r in df.select(event_time(F.col("ref"), F.last_day("ev")).alias("t")).collect()] == [-1, 0, 1, 2]
    leap = spark.createDataFrame([(D(2016, 3, 31), D(2016, 2, 10))], "ref date, ev date")
    assert leap.select(event_time(F.col("ref"), F.last_day("ev")).alias("t")).first().t == 2


def test_age_birthday_boundary(spark):
    df = spark.createDataFrame([(D(2020, 5, 15), D(1980, 5, 15)), (D(2020, 5, 15), D(1980, 5, 16))], "d date, dob date")
    assert [r.a for r in df.select(age_on(F.col("d"), F.col("dob")).alias("a")).collect()] == [40, 39]


def test_six_month_bins(spark):
    ts = [-59, -6, -5, 0, 1, 6, 7, 60]
    df = spark.createDataFrame([(t,) for t in ts], "t_op int")
    got = [r.t_treatment_6_month for r in event_bins(df).collect()]
    assert got == [-9, -1, 0, 0, 1, 6, 7, 15]


def test_negative_pay_clamped_per_identifier(spark):
    pay = spark.createDataFrame([("n1", "2015-1", -50.0, 1.0), ("n2", "2015-1", 20.0, 2.0)],
                                "valid_nino string, month string, pay double, days_worked double")
    links = spark.createDataFrame([(1, "p", "n1"), (1, "p", "n2")], "census_id_flag int, census_id_final string, valid_nino string")
    r = combine_ids(pay, links).first()
    assert r.pay == 20.0 and r.days_worked == 3.0 and r.paye_flag == 1


def test_stratified_sample_exact_and_whole_when_short(spark):
    pop = spark.createDataFrame([(f"id{i}", "F", "25-29") for i in range(10)] + [(f"m{i}", "M", "25-29") for i in range(9)],
                                "census_id_final string, census_sex string, five_year_bands string")
    targets = spark.createDataFrame([("F", "25-29", 10), ("M", "25-29", 10)], "census_sex string, five_year_bands string, n_wanted long")
    out = stratified_sample(pop, targets, ["census_sex", "five_year_bands"], "7", buckets=4, check=False)
    counts = {r.census_sex: r["count"] for r in out.groupBy("census_sex").count().collect()}
    assert counts == {"F": 10, "M": 9}
    smaller = spark.createDataFrame([("F", "25-29", 4)], "census_sex string, five_year_bands string, n_wanted long")
    got = {r.census_id_final for r in stratified_sample(pop, smaller, ["census_sex", "five_year_bands"], "7", buckets=4).collect()}
    draws = pop.where("census_sex = 'F'").withColumn("u", uniform_draw(F.col("census_id_final"), "7")).orderBy("u", "census_id_final")
    assert got == {r.census_id_final for r in draws.limit(4).collect()}


def test_rolling_mean_partial_ends(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 6.0), (3, 9.0)], "m int, v double")
    assert [r.v_smooth for r in rolling_mean(df, "m", "v").orderBy("m").collect()] == [4.5, 6.0, 7.5]


def test_draws_independent_of_partitioning(spark):
    df = spark.range(500).withColumn("id", F.col("id").cast("string"))
    a = {r.id: r.u for r in df.repartition(3).withColumn("u", uniform_draw(F.col("id"), "s")).collect()}
    b = {r.id: r.u for r in df.repartition(11).withColumn("u", uniform_draw(F.col("id"), "s")).collect()}
    assert a == b and all(0 <= v < 1 for v in a.values())


def test_exact_quantiles_match_numpy_with_ties(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LISTED", 5)
    monkeypatch.setattr(quantiles, "CELLS", 8)
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.zeros(400), rng.normal(size=600).round(2)])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", [0.1, 0.5, 0.9999], by=["g"], accuracy=100).collect()}
    for g in range(3):
        xs = np.array([v for k, v in rows if k == g])
        for p in (0.1, 0.5, 0.9999):
            assert abs(got[(g, p)] - np.quantile(xs, p)) < 1e-9


def test_exact_quantiles_of_large_groups(spark):
    """More rows than any bracket lists, in two groups of different spread and one NULL group."""
    df = spark.range(600_000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"),
        F.round(F.exp(F.randn(7) * 3) * F.when(F.col("id") % 3 == 0, 1e6).otherwise(1.0), 3).alias("x"))
    pdf = df.toPandas()
    probs = [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", probs, by=["g"], accuracy=100).collect()}
    assert len(got) == 18
    for g in ("a", "b", None):
        xs = pdf.x[pdf.g.isna() if g is None else pdf.g == g].to_numpy()
        assert len(xs) == 200_000
        for p in probs:
            want = np.quantile(xs, p)
            assert abs(got[g, p] - want) <= 1e-12 * max(1.0, abs(want))


def test_exact_quantiles_survive_a_poor_first_bracket(spark, monkeypatch):
    """The guess lies wholly below, wholly above, or at both ends of the wanted ranks."""
    values = [float(v) for v in range(1000)] + [1e308, -1e308, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 3.0), ("none", None)], "g string, x double")
    finite = np.array([v for v in values if v is not None and np.isfinite(v)])
    for guess in ((-1e308, -1e308), (1e308, 1e308), (-1e308, 1e308), (499.0, 499.0), (2.5, 3.5)):
        monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, ps, acc: F.array(*[F.lit(x) for x in guess * (len(ps) // 2)]))
        got = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", [0.1, 0.5, 1.0], by=["g"]).collect()}
        assert {g for g, _ in got} == {"g", "one"}
        for p in (0.1, 0.5, 1.0):
            assert got["g", p] == np.quantile(finite, p) and got["one", p] == 3.0


def test_std_diff_category_matches_the_matrix_form(spark):
    from epicohort.operators.describe import std_diff_category
    rng = np.random.default_rng(4)
    rows = [(int(g), str(rng.choice(list("abcd"), p=[.4, .3, .2, .1] if g else [.1, .2, .3, .4])), f"l{rng.integers(30)}",
             "only", "x" if g else "y", None if i % 5 else "n") for i, g in enumerate(rng.integers(0, 2, 900))]
    cols = ["a", "b", "one", "apart", "holes"]
    df = spark.createDataFrame([*rows, (None, "a", "b", "c", "d", "e")], "g int, a string, b string, one string, apart string, holes string")
    got = {r.variable: r for r in std_diff_category(df, "g", cols).collect()}
    for k, col in enumerate(cols[:3], 1):
        levels = sorted({r[k] for r in rows})[1:]
        n = {g: sum(r[0] == g for r in rows) for g in (0, 1)}
        p = {g: np.array([sum(r[0] == g and r[k] == lv for r in rows) / n[g] for lv in levels]) for g in (0, 1)}
        cov = sum(np.diag(p[g]) - np.outer(p[g], p[g]) for g in (0, 1)) / 2
        d = float(np.sqrt((p[1] - p[0]) @ np.linalg.pinv(cov) @ (p[1] - p[0]))) if levels else 0.0
        se = np.sqrt((n[0] + n[1]) / (n[0] * n[1]) + d * d / (2 * (n[0] + n[1])))
        assert abs(got[col].std_diff - d) < 1e-10 and abs(got[col].std_diff_ucl - d - 1.96 * se) < 1e-10
    assert got["apart"].std_diff is None and got["holes"].std_diff == 0.0


def test_histogram_counts_every_value(spark):
    from epicohort.operators.describe import histogram
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 99.9, 100.0, 249.0, 250.0, 1e9, None, float("nan"))], "x double")
    got = {r.bin: (r.n, r.bin_start) for r in histogram(df, "x", 100.0, 0.0, 250.0).collect()}
    assert got == {-1: (1, None), 0: (2, 0.0), 1: (1, 100.0), 2: (1, 200.0), 3: (2, 250.0)}


def test_fixture_config_is_half_open_window():
    assert FIXTURE_CONFIG.follow_up_start < FIXTURE_CONFIG.follow_up_end


def test_exact_quantiles_global_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vals = np.concatenate([np.zeros(300), rng.exponential(size=700).round(3)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for listed in (2, 10_000):
        monkeypatch.setattr(quantiles, "LISTED", listed)
        got = {r.p: r.q for r in exact_quantiles(df, "x", [0.0001, 0.5, 0.9, 0.9999], accuracy=200).collect()}
        for p in (0.0001, 0.5, 0.9, 0.9999):
            assert abs(got[p] - np.quantile(vals, p)) < 1e-9


def test_death_censoring_on_month_end(spark):
    from epicohort.operators.panel import build_panel
    cfg = FIXTURE_CONFIG.with_(spine_start=D(1998, 1, 1), spine_end=D(1998, 4, 1), panel_age=(0, 200))
    df = spark.createDataFrame([("a", D(1998, 1, 10), D(1960, 1, 1), D(1998, 2, 28)),
                                ("b", D(1998, 1, 10), D(1960, 1, 1), D(1998, 3, 1))],
                               "census_id_final string, op_date date, prov_dob date, dod date")
    got = {(r.census_id_final, r.ref_date) for r in build_panel(df, cfg).collect()}
    assert ("a", D(1998, 2, 28)) not in got and ("a", D(1998, 1, 31)) in got
    assert ("b", D(1998, 2, 28)) in got and ("b", D(1998, 3, 31)) not in got


def test_crosswalk_fans_out_one_to_two(spark):
    from epicohort.operators.link import crosswalk
    df = spark.createDataFrame([("p", 0, "X21"), ("q", 1, "Y11")], "census_id_final string, census_id_flag int, lsoa_census string")
    xw = spark.createDataFrame([("A11", "X21"), ("B11", "X21"), ("Y11", "Y21")], "LSOA11CD string, LSOA21CD string")
    got = sorted((r.census_id_final, r.lsoa_census) for r in crosswalk(df, xw).collect())
    assert got == [("p", "A11"), ("p", "B11"), ("q", "Y11")]


def test_all_zero_pay_group_has_null_in_work_measures(spark):
    from epicohort.operators.describe import pay_summary
    df = spark.createDataFrame([("g", 0.0, 0), ("g", 0.0, 0), ("h", 5.0, 1)], "grp string, pay double, in_work int")
    r = {x.grp: x for x in pay_summary(df, ["grp"], deflated=None).collect()}
    assert r["g"].average_monthly_pay_in_work is None and r["g"].median_monthly_pay_in_work is None
    assert r["g"].prop_in_work == 0.0 and r["h"].median_monthly_pay == 5.0


def test_short_stratum_raises_when_checked(spark):
    import pytest
    pop = spark.createDataFrame([(f"m{i}", "M", "25-29") for i in range(9)],
                                "census_id_final string, census_sex string, five_year_bands string")
    targets = spark.createDataFrame([("M", "25-29", 10)], "census_sex string, five_year_bands string, n_wanted long")
    with pytest.raises(ValueError):
        stratified_sample(pop, targets, ["census_sex", "five_year_bands"], "7", check=True)


def test_missing_stratum_leaves_others_unchanged(spark):
    pop = spark.createDataFrame([(f"f{i}", "F", "25-29") for i in range(20)] + [(f"m{i}", "M", "30-34") for i in range(20)],
                                "census_id_final string, census_sex string, five_year_bands string")
    full = spark.createDataFrame([("F", "25-29", 5), ("M", "30-34", 5)], "census_sex string, five_year_bands string, n_wanted long")
    part = spark.createDataFrame([("M", "30-34", 5)], "census_sex string, five_year_bands string, n_wanted long")
    keys = ["census_sex", "five_year_bands"]
    a = {r.census_id_final for r in stratified_sample(pop, full, keys, "3").where("census_sex = 'M'").collect()}
    b = {r.census_id_final for r in stratified_sample(pop, part, keys, "3").collect()}
    assert a == b and len(b) == 5


def test_hot_person_is_split_or_never_shuffled(spark):
    """One person holds a third of the rows: the join with the person's own figures is split."""
    from epicohort.operators.cohort import any_flag_over, per_key
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                     (F.col("id") % 1000 == 0).cast("int").alias("f"), F.md5(F.col("id").cast("string")).alias("x"))
    rows = rows.repartition(12)
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        for out in (per_key(rows, ["k"], {"n": F.count(F.lit(1))}), any_flag_over(rows, "k", {"any": "f"})):
            assert len(out.collect()) == 60000
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_fitting_sample_is_the_largest_without_a_short_stratum(spark):
    from epicohort.operators import sample as S
    have = {"a": 3, "b": 40, "c": 11}
    shares = spark.createDataFrame([("a", 5), ("b", 8), ("c", 4), ("d", 9), (None, 2)], "k string, n long")
    pop = spark.createDataFrame([(f"{k}{i}", k) for k, n in have.items() for i in range(n)], "census_id_final string, k string")
    got = {r.k: r for r in S.fitting_targets(pop, shares, ["k"], 1000).collect()}
    n, every = {"a": 5, "b": 8, "c": 4}, 17
    size = lambda t, k: (2 * t * n[k] + every) // (2 * every)
    best = max(t for t in range(200) if all(size(t, k) <= have[k] for k in n))
    assert {k: r.n_wanted for k, r in got.items()} == {k: size(best, k) for k in n}
    assert {r.total for r in got.values()} == {best}
    assert {r.total for r in S.fitting_targets(pop, shares, ["k"], 4).collect()} == {4}
    targets = S.fitting_targets(pop, shares, ["k"], 1000).select("k", "n_wanted")
    out = {r.k: r["count"] for r in S.stratified_sample(pop, targets, ["k"], "42").groupBy("k").count().collect()}
    assert out == {k: r.n_wanted for k, r in got.items()}
    assert S.fitting_targets(pop.limit(0), shares, ["k"], 9).count() == 0
