"""M1: demean-by-person + month dummies on Spark == full dummy regression in numpy."""
import numpy as np
import pandas as pd

from epicohort.operators.fe import fe_event_study


def _numpy_fit(pdf):
    persons = sorted(pdf.pid.unique())
    months = sorted(pdf.month.unique())
    X = np.column_stack([(pdf.bin == 1).astype(float), pdf.x.to_numpy()] +
                        [(pdf.month == m).astype(float) for m in months[1:]] +
                        [(pdf.pid == p).astype(float) for p in persons])
    y = pdf.y.to_numpy()
    inv = np.linalg.pinv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    meat = np.zeros((X.shape[1], X.shape[1]))
    for p in persons:
        s = X[pdf.pid.to_numpy() == p].T @ e[pdf.pid.to_numpy() == p]
        meat += np.outer(s, s)
    v = inv @ meat @ inv
    return b[:2], np.sqrt(np.diag(v)[:2])


def test_fe_matches_dummy_regression(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(40):
        a = rng.normal()
        for m in range(rng.integers(4, 9)):
            b = int(m >= 3 and p % 2 == 0)
            x = rng.normal()
            rows.append((f"p{p:02d}", f"m{m}", b, x, 2.0 * b + 0.5 * x + a + 0.1 * m + rng.normal()))
    pdf = pd.DataFrame(rows, columns=["pid", "month", "bin", "x", "y"])
    res = fe_event_study(spark.createDataFrame(pdf), "y", {"bin": 0}, ["x"], person="pid", month="month",
                         small_sample=False, partitions=3)
    want_b, want_se = _numpy_fit(pdf)
    got = dict(zip(res.terms, res.estimate))
    se = dict(zip(res.terms, res.std_error()))
    assert abs(got["bin1"] - want_b[0]) < 1e-8 and abs(got["x"] - want_b[1]) < 1e-8
    assert abs(se["bin1"] - want_se[0]) < 1e-8 and abs(se["x"] - want_se[1]) < 1e-8


def test_fe_hot_person_spread_over_tasks(spark):
    """One person holds most rows and sits in every task; partial sums are
    flushed after two persons, so every code path of the reduction runs."""
    import epicohort.operators.fe as FE
    rng = np.random.default_rng(5)
    rows = []
    for p in range(12):
        n = 300 if p == 0 else 6
        for t in range(n):
            b = int(t >= n // 2 and p % 2 == 0)
            x = rng.normal()
            rows.append((f"p{p:02d}", f"m{t % 6}", b, x, 1.5 * b - 0.7 * x + p * 0.3 + rng.normal()))
    pdf = pd.DataFrame(rows, columns=["pid", "month", "bin", "x", "y"])
    res = FE.fe_event_study(spark.createDataFrame(pdf), "y", {"bin": 0}, ["x"], person="pid", month="month",
                            small_sample=False, partitions=7, flush_persons=2)
    want_b, want_se = _numpy_fit(pdf)
    got = dict(zip(res.terms, res.estimate))
    se = dict(zip(res.terms, res.std_error()))
    assert abs(got["bin1"] - want_b[0]) < 1e-8 and abs(got["x"] - want_b[1]) < 1e-8
    assert abs(se["bin1"] - want_se[0]) < 1e-8 and abs(se["x"] - want_se[1]) < 1e-8
    assert res.n == len(pdf) and res.n_clusters == 12


def test_effects_by_level_delta_rule(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(60):
        sex = "F" if p % 2 else "M"
        for m in range(6):
            b = int(m >= 3 and p % 3 == 0)
            eff = 2.0 if sex == "F" else 3.5
            rows.append((f"p{p:02d}", f"m{m}", b, sex, eff * b + rng.normal() * 0.01 + p))
    pdf = pd.DataFrame(rows, columns=["pid", "month", "bin", "sex", "y"])
    res = fe_event_study(spark.createDataFrame(pdf), "y", {"bin": 0}, [], person="pid", month="month",
                         interact=("bin", "sex"))
    eff = {r["level"]: r for r in res.effects_by_level("bin", "sex", res.by_levels, res.by_levels[0])}
    assert abs(eff["F"]["estimate"] - 2.0) < 0.05 and abs(eff["M"]["estimate"] - 3.5) < 0.05
    assert eff["M"]["std_error"] > 0


def _panel(seed, level, n_people=300, n_months=8):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(n_people):
        a = level * rng.normal()
        for m in range(n_months):
            b = int(m >= 4 and p % 2 == 0)
            x = rng.normal()
            rows.append((f"p{p:03d}", f"m{m}", b, x, 2.0 * b + 0.5 * x + a + 0.1 * m + rng.normal(), rng.normal(), "s" + str(p % 2)))
    return pd.DataFrame(rows, columns=["pid", "month", "bin", "x", "y", "y2", "half"])


def test_rss_and_parameter_count_at_large_levels(spark):
    """Person levels near 5e7 with unit noise: the residual sum of squares keeps its digits,
    and the parameters counted are the rank of the full dummy regression."""
    pdf = _panel(8, 5e7)
    res = fe_event_study(spark.createDataFrame(pdf), "y", {"bin": 0}, ["x"], person="pid", month="month")
    d = pdf.assign(**{c: pdf[c] - pdf.groupby("pid")[c].transform("mean") for c in ("x", "y")})
    X = np.column_stack([(pdf.bin == 1).astype(float), d.x] + [(pdf.month == f"m{m}").astype(float) for m in range(1, 8)])
    X = X - pd.DataFrame(X).groupby(pdf.pid).transform("mean").to_numpy()
    e = d.y - X @ np.linalg.lstsq(X, d.y, rcond=None)[0]
    assert abs(res.rss / float(e @ e) - 1) < 1e-9
    assert res.k + res.n_absorbed == 300 + 9 and res.aic() == -2 * res.loglik() + 2 * (309 + 1)
    assert [r["term"] for r in res.rows()] == ["bin1", "x"]


def test_small_units_are_no_reason_to_drop_and_constants_are(spark):
    pdf = _panel(9, 10.0, 40)
    pdf["tiny"], pdf["same"], pdf["twice"] = pdf.x * 1e-9, pdf.groupby("pid").ngroup() * 1e6 + 0.1, 2 * pdf.x
    res = fe_event_study(spark.createDataFrame(pdf), "y", {"bin": 0}, ["tiny", "same", "twice"], person="pid", month="month")
    got = dict(zip(res.terms, res.estimate))
    assert abs(got["tiny"] * 1e-9 - 0.5) < 0.2 and np.isnan(got["same"]) and np.isnan(got["twice"])
    assert set(res.dropped) == {"same", "twice"}


def test_strata_and_outcomes_in_one_job_equal_single_fits(spark):
    from epicohort.operators.fe import fit_models
    pdf = _panel(10, 10.0, 40)
    pdf.loc[pdf.half == "s1", "bin"] = (pdf.month >= "m6").astype(int)
    df = spark.createDataFrame(pdf)
    both = fit_models(df, ["y", "y2"], {"bin": 0}, ["x"], person="pid", month="month", by="half", flush_persons=3, partitions=5)
    assert set(both) == {(s, y) for s in ("s0", "s1") for y in ("y", "y2")}
    for (s, y), res in both.items():
        one = fe_event_study(df.where(df.half == s), y, {"bin": 0}, ["x"], person="pid", month="month")
        assert res.terms == one.terms and res.n == one.n and abs(res.rss - one.rss) < 1e-8
        assert np.allclose(res.estimate, one.estimate, equal_nan=True) and np.allclose(res.cov, one.cov, equal_nan=True)


def test_tail_probabilities_match_known_values():
    from epicohort.functions.dist import chi2_upper, t_quantile_975, t_two_sided
    for stat, dof, p in ((2.0, 10, 0.07338803477074), (12.706204736, 1, 0.05), (8, 5, 0.00049290660), (0.5, 3, 0.65144796), (1.959963984540054, 1e9, 0.05)):
        assert abs(t_two_sided(stat, dof) - p) < 1e-8
    for dof, t in ((1, 12.7062047362), (10, 2.2281388520), (300, 1.9679030113)):
        assert abs(t_quantile_975(dof) - t) < 1e-8
    for x, dof in ((3.841458820694, 1), (5.991464547108, 2), (7.814727903251, 3), (18.30703805328, 10)):
        assert abs(chi2_upper(x, dof) - 0.05) < 1e-10


def test_reference_level_and_order_of_the_metadata(spark):
    """Contrasts against the named reference are those of the default fit, rebased."""
    from epicohort.functions.columns import reference_of, set_reference
    from epicohort.operators.fe import fit_models
    from epicohort.sources.io import stash
    rng = np.random.default_rng(8)
    rows = [(f"p{p}", f"m{m}", rng.choice(list("abc")), float(rng.normal() + (m > 3)), ) for p in range(40) for m in range(7)]
    df = spark.createDataFrame(rows, "pid string, month string, f string, y double")
    plain = fit_models(df, ["y"], {"f": None}, person="pid", month="month")[None, "y"]
    named = set_reference(df, {"f": "b"}, {"f": ["c", "a"]})
    kept = stash(named.join(df.select("pid").distinct(), "pid").select("y", "f", "month", "pid"), "named")
    assert reference_of(kept, "f") == "b"
    other = fit_models(kept, ["y"], {"f": None}, person="pid", month="month")[None, "y"]
    assert [t for t in plain.terms if t.startswith("f")] == ["fb", "fc"]
    assert [t for t in other.terms if t.startswith("f")] == ["fc", "fa"]
    a, b = dict(zip(plain.terms, plain.estimate)), dict(zip(other.terms, other.estimate))
    assert abs(b["fc"] - (a["fc"] - a["fb"])) < 1e-9 and abs(b["fa"] + a["fb"]) < 1e-9


def test_natural_spline_basis_has_known_values():
    """A row of the textbook basis: heights 58..72 with inner knots at the fifths."""
    from epicohort.operators.fe import natural_spline_basis
    knots = [58, 60.8, 63.6, 66.4, 69.2, 72]
    got = natural_spline_basis(np.array([58.0, 59.0]), knots)
    assert np.allclose(got[0], 0, atol=1e-12)
    assert np.allclose(got[1], [7.592323e-03, 0, -8.670223e-02, 2.601067e-01, -1.734045e-01], atol=1e-7)


def test_spline_columns_are_the_basis_up_to_constants(spark):
    from pyspark.sql import functions as F

    from epicohort.operators.fe import natural_spline_basis, natural_spline_terms
    knots = [20.0, 27.5, 31.0, 44.0, 52.0, 60.0]
    x = np.linspace(5, 75, 141)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = df.select("x", *[c.alias(n) for n, c in natural_spline_terms(F.col("x"), knots).items()]).orderBy("x").toPandas().to_numpy()[:, 1:]
    gap = got - natural_spline_basis(x, knots)
    assert np.ptp(gap, axis=0).max() < 1e-9
    # natural: straight beyond the boundary, on either side
    assert np.abs(np.diff(got[x > 60], n=2, axis=0)).max() < 1e-9 and np.abs(np.diff(got[x < 20], n=2, axis=0)).max() < 1e-9


def test_vectors_of_whole_persons_stay_in_their_task(spark, monkeypatch):
    """Only persons whose rows lie in several tasks leave a vector; the fit is the same either way."""
    import epicohort.operators.fe as FE
    kept = {}

    def keep(df, name):
        kept[name] = stash(df, name)
        return kept[name]
    stash = FE.stash
    monkeypatch.setattr(FE, "stash", keep)
    df = spark.createDataFrame(_panel(12, 10.0, 60)).repartition(1)
    fit = lambda **kw: FE.fe_event_study(df, "y", {"bin": 0}, ["x"], person="pid", month="month", **kw)
    whole = fit()
    assert all(kept[c].where("kind = 1").count() == 0 for c in ("fe_gram", "fe_scores"))
    spread = fit(partitions=4, flush_persons=7)
    assert kept["fe_scores"].where("kind = 1").count() > 60
    assert np.allclose(whole.estimate, spread.estimate) and np.allclose(whole.cov, spread.cov) and whole.n == spread.n


def test_spline_of_the_stack_is_looked_up(spark):
    """One spline term for each variant and age, those of the age's expressions; rows without an age stay."""
    from pyspark.sql import functions as F

    from epicohort.operators.fe import natural_spline_basis
    from epicohort.plans.models import BIN, KNOTS, MAIN, SPLINE, stack
    df = spark.range(400).select(F.when(F.col("id") % 50 > 0, F.col("id") % 40 + 25).cast("int").alias("age_monthly"),
                                 F.lit(1).alias("in_work"), (F.col("id") % 3).alias(BIN))
    out = stack(df, [MAIN])
    assert "POWER" not in out._jdf.queryExecution().optimizedPlan().toString().upper()
    got = out.toPandas()
    assert len(got) == 400 and got[got.age_monthly.isna()][SPLINE].isna().all().all()
    got = got.dropna()
    lo, hi = np.quantile(got.age_monthly, [0.1, 0.9])
    inner = got.age_monthly[(got.age_monthly >= lo) & (got.age_monthly <= hi)]
    knots = [lo, *np.quantile(inner, KNOTS[1:-1]), hi]
    assert np.ptp(got[SPLINE].to_numpy() - natural_spline_basis(got.age_monthly.to_numpy(float), knots), axis=0).max() < 1e-9


def test_memory_of_a_pass_does_not_grow_with_the_rows():
    """A task's peak over ten times as many whole persons, each with a wide vector, stays the same."""
    import tracemalloc

    import pyarrow as pa

    import epicohort.operators.fe as FE
    width, persons, months = 600, 200, 6

    def batches(n):
        for i in range(n):
            pid = [f"p{i}_{p}" for p in range(persons) for _ in range(months)]
            yield pa.RecordBatch.from_pydict({"_s": ["a"] * len(pid), "_pid": pid, "_n": [months] * len(pid)})

    def peak(n):
        run = FE._row_pass(lambda s, rows, starts: (np.ones((len(starts), width)), np.ones(1)),
                           lambda s, v, n: np.array([len(n), n.sum()], float), width, FE.FLUSH_PERSONS)
        tracemalloc.start()
        try:
            out = [b for b in run(batches(n))]
            return tracemalloc.get_traced_memory()[1], out
        finally:
            tracemalloc.stop()
    peak(2)
    small, _ = peak(20)
    large, out = peak(200)
    assert [b.column("kind").to_pylist() for b in out] == [[0]]
    assert out[0].column("v")[0].as_py()[1:] == [200 * persons, 200 * persons * months]
    assert large < 1.5 * small and large < 8e7
