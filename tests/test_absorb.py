"""M8: absorbed cell effects against the regression with all dummies."""
import numpy as np
import pandas as pd
import pytest

from epicohort.operators.absorb import fit_absorbed
from epicohort.operators.fe import fit_models, lr_test


def _rows(seed=5, people=90, months=9, regions=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(people):
        level, region = rng.normal(), f"r{i % regions}"
        for m in range(months):
            if rng.uniform() < 0.25:
                continue
            b = int(m >= 4 and (i // 4) % 2 == 0) * (1 + m % 2)
            x = rng.normal() + 0.3 * m
            rows.append((f"p{i}", region, f"m{m}", b, x, 2.0 * b - x + level + rng.normal(), float(rng.uniform() < 0.4), f"s{(i // 8) % 2}"))
    return pd.DataFrame(rows, columns=["census_id_final", "region", "month_label", "bin", "x", "y", "w", "half"])


@pytest.mark.parametrize("by", [None, "half"])
def test_equals_the_dummy_fit(spark, by):
    pdf = _rows()
    df = spark.createDataFrame(pdf.assign(cell=pdf.region + "|" + pdf.month_label))
    got = fit_absorbed(df, ["y", "w"], {"bin": 0}, ["x"], ["region", "month_label"], by=by)
    want = fit_models(df, ["y", "w"], {"bin": 0}, ["x"], month="cell", by=by)
    assert set(got) == set(want) and len(got) == (4 if by else 2)
    for key, res in got.items():
        full = want[key]
        at = [full.terms.index(t) for t in res.terms]
        assert res.terms == ["bin1", "bin2", "x"]
        assert np.allclose(res.estimate, full.estimate[at], rtol=1e-8, atol=1e-10)
        assert np.allclose(res.std_error(), full.std_error()[at], rtol=1e-8, atol=1e-10)
        assert res.k == full.k and abs(res.rss - full.rss) < 1e-8 * full.rss
        assert abs(res.aic() - full.aic()) < 1e-6 and abs(res.bic() - full.bic()) < 1e-6


def test_likelihood_ratio_counts_absorbed_effects(spark):
    df = spark.createDataFrame(_rows())
    full = fit_absorbed(df, ["y"], {"bin": 0}, ["x"], ["region", "month_label"])[None, "y"]
    less = fit_models(df, ["y"], {"bin": 0}, ["x"])[None, "y"]
    test = lr_test(less, full)
    assert test["df"] == 3 * 8 and 0 <= test["p_value"] <= 1 and test["statistic"] >= 0


def test_columns_that_the_effects_explain_have_no_estimate(spark):
    pdf = _rows()
    pdf["of_cell"] = pdf.month_label.str[1:].astype(float) * (1 + pdf.region.str[1:].astype(float))
    pdf["of_person"] = pdf.census_id_final.str[1:].astype(float)
    res = fit_absorbed(spark.createDataFrame(pdf), ["y"], {}, ["x", "of_cell", "of_person"], ["region", "month_label"])[None, "y"]
    assert np.isfinite(res.estimate[0]) and np.isnan(res.estimate[1:]).all()


def test_missing_values_leave_and_an_empty_frame_has_no_fit(spark):
    pdf = _rows()
    holes = pdf.copy()
    holes.loc[::11, "x"] = None
    holes.loc[::13, "region"] = None
    whole = spark.createDataFrame(holes.dropna())
    got = fit_absorbed(spark.createDataFrame(holes).replace(float("nan"), None), ["y"], {"bin": 0}, ["x"], ["region", "month_label"])[None, "y"]
    want = fit_absorbed(whole, ["y"], {"bin": 0}, ["x"], ["region", "month_label"])[None, "y"]
    assert np.allclose(got.estimate, want.estimate) and got.n == want.n == len(holes.dropna())
    assert fit_absorbed(whole.limit(0), ["y"], {"bin": 0}, ["x"], ["region", "month_label"]) == {}


def test_a_hundred_thousand_levels(spark):
    """Cells by the hundred thousand, each met by a few persons; the true slope is known."""
    from pyspark.sql import functions as F
    df = spark.range(400_000).select(
        (F.col("id") % 20_000).cast("string").alias("census_id_final"), (F.xxhash64("id") % 60_000).cast("string").alias("cell"),
        F.randn(3).alias("x"), F.randn(4).alias("noise"))
    df = df.withColumn("y", 3.0 * F.col("x") + F.col("census_id_final").cast("int") % 17 + F.col("cell").cast("int") % 23 + 0.1 * F.col("noise"))
    res = fit_absorbed(df, ["y"], {}, ["x"], ["cell"])[None, "y"]
    assert abs(res.estimate[0] - 3.0) < 6 * res.std_error()[0] and res.std_error()[0] < 1e-3
    assert res.absorbed_rank > 100_000


@pytest.mark.parametrize("by", [None, "half"])
def test_formed_and_iterated_systems_agree(spark, monkeypatch, by):
    """Few cells: no pass over the persons for a step; the fit is that of the passes."""
    import epicohort.operators.absorb as A
    df = spark.createDataFrame(_rows())
    fit = lambda: fit_absorbed(df, ["y", "w"], {"bin": 0}, ["x"], ["region", "month_label"], by=by)
    with monkeypatch.context() as m:
        m.setattr(A, "MAX_FORMED", 0)
        want = fit()
    monkeypatch.setattr(A.Cells, "over_people", None)
    got = fit()
    assert set(got) == set(want) and len(got) == (4 if by else 2)
    for key, res in got.items():
        assert np.allclose(res.estimate, want[key].estimate, rtol=1e-9) and np.allclose(res.cov, want[key].cov, rtol=1e-8)
        assert res.k == want[key].k and res.n == want[key].n


@pytest.mark.parametrize("formed", [True, False])
def test_columns_within_levels_are_made_in_the_tasks(spark, monkeypatch, formed):
    """Columns in the levels of a factor that some persons change are those of the products; no stored table of rows widens with
    bins and levels."""
    from pyspark.sql import functions as F
    import epicohort.operators.absorb as A
    if not formed:
        monkeypatch.setattr(A, "MAX_FORMED", 0)
    pdf = _rows(people=60)
    moves = pdf.census_id_final.str[1:].astype(int) % 7 == 0
    pdf.loc[moves & (pdf.month_label > "m4"), "region"] = "r1"
    pdf["x"] += 50.0
    df = spark.createDataFrame(pdf)
    want = fit_absorbed(df.withColumns({f"x:region{r}": F.col("x") * (F.col("region") == r).cast("double") for r in ("r1", "r2", "r3")}),
                        ["y", "w"], {"bin": 0}, ["x", "x:regionr1", "x:regionr2", "x:regionr3"], ["region", "month_label"], by="half")
    stored = {}
    stash = A.stash
    monkeypatch.setattr(A, "stash", lambda out, name: stored.setdefault(name, stash(out, name)))
    got = fit_absorbed(df, ["y", "w"], {"bin": 0}, ["x"], ["region", "month_label"], by="half", within=(["x"], "region"))
    assert set(got) == set(want) and len(got) == 4
    for key, res in got.items():
        assert res.terms == want[key].terms == ["bin1", "bin2", "x", "x:regionr1", "x:regionr2", "x:regionr3"]
        assert np.allclose(res.estimate, want[key].estimate, rtol=1e-8) and np.allclose(res.cov, want[key].cov, rtol=1e-7, atol=1e-12)
        assert res.k == want[key].k and np.isclose(res.rss, want[key].rss, rtol=1e-9)
    assert not {"v3", "z3"} & set(stored["absorb_centred"].columns)  # x, y, w and no dummies or products


def test_factors_known_on_the_same_rows_share_the_main_fit(spark, monkeypatch):
    from types import SimpleNamespace

    import epicohort.plans.models as M
    rows = [(1, 1, 1, None, 1, 1), (1, None, 1, None, None, 1), (1, 1, 1, 1, 1, None)]
    combined = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in M.FACTORS))
    monkeypatch.setattr(M, "study", lambda *_: SimpleNamespace(combined=combined))
    got = dict(zip(M.FACTORS, map(M.known_alike(spark, "").get, M.FACTORS)))
    a, b, c, d, e, f = M.FACTORS
    assert got == {a: a, b: b, c: a, d: d, e: b, f: f}


def test_weighted_quantiles_are_those_of_the_rows(spark):
    from epicohort.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 6000).astype(str), "x": np.round(rng.normal(size=6000), 3)})
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    counts = spark.createDataFrame(pdf.value_counts(["g", "x"]).rename("n").reset_index())
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(counts, "x", probs, ["g"], weight="n").collect()}
    assert got == {(g, p): pytest.approx(np.quantile(own.x, p)) for g, own in pdf.groupby("g") for p in probs}
