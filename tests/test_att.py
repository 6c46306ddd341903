"""M15/M16 on a noise-free staggered panel with parallel trends."""
from epicohort.operators.att import aggregate_att, att_gt, att_standard_errors


def test_att_recovers_constant_effect(spark):
    rows = []
    cohorts = {**{f"a{i}": 3 for i in range(4)}, **{f"b{i}": 5 for i in range(4)}, **{f"n{i}": 0 for i in range(4)}}
    for pid, g in cohorts.items():
        unit = int(pid[1:]) * 10.0
        for t in range(1, 8):
            y = unit + 2.0 * t + (5.0 if g and t >= g else 0.0)
            rows.append((pid, g, t, y))
    df = spark.createDataFrame(rows, "census_id_final string, treatment_group long, six_month_num long, y double")
    att = att_gt(df, "y")
    got = {(r.group, r.time): r.att for r in att.collect()}
    for (g, t), v in got.items():
        assert abs(v - (5.0 if t >= g else 0.0)) < 1e-9
    se = {(r.group, r.time): r.se for r in att_standard_errors(df, att, "y").collect()}
    assert all(abs(v) < 1e-9 for v in se.values())
    dyn = {r.event_time: r.att for r in aggregate_att(att, df).collect()}
    assert abs(dyn[0] - 5.0) < 1e-9 and abs(dyn[-2] - 0.0) < 1e-9


def _panel(seed, persons=240, missing=0.15):
    """Unbalanced staggered panel whose trend depends on age and sex."""
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(persons):
        g = int(rng.choice([0, 3, 4, 6]))
        age, sex, level = float(rng.uniform(20, 60)), str(rng.choice(["f", "m"])), rng.normal(0, 50)
        for t in range(1, 8):
            if rng.uniform() < missing:
                continue
            y = level + t * (2 + 0.1 * age + (sex == "m")) + (30 + 5 * (t - g) if g and t >= g else 0) + rng.normal(0, 10)
            rows.append((f"p{i}", g, t, age + t / 2, sex, y))
    return rows


def _by_hand(rows, covariates, weights=None):
    """ATT(g, t) and the dynamic means by least squares in numpy; ``weights``: how often each person counts."""
    import numpy as np
    pid = np.array([r[0] for r in rows])
    G, T, y = (np.array([r[i] for r in rows], float) for i in (1, 2, 5))
    cols = {"age": np.array([r[3] for r in rows]), "sex": np.array([float(r[4] == "m") for r in rows])}
    X = np.column_stack([np.ones(len(rows)), *[cols[c] for c in covariates]])
    w = np.ones(len(rows)) if weights is None else np.array([weights.get(p, 0) for p in pid], float)
    att = {}
    for g in (3, 4, 6):
        for t in range(1, 8):
            fit = {}
            for at in (t, g - 1):
                c = (T == at) & (G != g) & ((G == 0) | (G > max(t, g - 1)))
                r = np.sqrt(w[c])
                fit[at] = np.linalg.lstsq(X[c] * r[:, None], y[c] * r, rcond=None)[0]
            post, pre = (G == g) & (T == t), (G == g) & (T == g - 1)
            change = X @ (fit[t] - fit[g - 1])
            expected = (np.sum(w[post] * change[post]) + np.sum(w[pre] * change[pre])) / (w[post].sum() + w[pre].sum())
            att[g, t] = np.average(y[post], weights=w[post]) - np.average(y[pre], weights=w[pre]) - expected
    size = {g: sum((1 if weights is None else weights.get(p, 0)) for p in set(pid[G == g])) for g in (3, 4, 6)}
    dynamic = {}
    for e in sorted({t - g for g, t in att}):
        own = [(size[g], v) for (g, t), v in att.items() if t - g == e]
        dynamic[e] = sum(n * v for n, v in own) / sum(n for n, _ in own)
    return att, dynamic


def _frame(spark, rows):
    return spark.createDataFrame(rows, "census_id_final string, treatment_group long, six_month_num long, age double, sex string, y double")


def test_covariates_match_least_squares_and_the_infinitesimal_jackknife(spark):
    """Estimates against numpy; standard errors against derivatives of the estimates in each person's weight."""
    import numpy as np

    from epicohort.operators.att import group_time_effects
    rows = _panel(11, persons=120)
    people = sorted({r[0] for r in rows})
    for covariates in ([], ["age"], ["age", "sex"]):
        found = group_time_effects(_frame(spark, rows), "y", covariates=covariates)
        att, dynamic = _by_hand(rows, covariates)
        assert {(p["group"], p["time"]) for p in found.pairs} == set(att)
        for p in found.pairs:
            assert abs(p["att"] - att[p["group"], p["time"]]) < 1e-7
        h, moves, moves_dynamic = 1e-4, [], []
        for i in people:
            up, down = ({p: 1 + (d if p == i else 0) for p in people} for d in (h, -h))
            (a, da), (b, db) = _by_hand(rows, covariates, up), _by_hand(rows, covariates, down)
            moves.append([(a[p["group"], p["time"]] - b[p["group"], p["time"]]) / (2 * h) for p in found.pairs])
            moves_dynamic.append([(da[e] - db[e]) / (2 * h) for e in sorted(dynamic)])
        cov = np.array(moves).T @ np.array(moves)
        n = len(found.pairs)
        assert np.allclose(found.cov[:n, :n], cov, atol=1e-4 * cov.max())
        se = np.sqrt((np.array(moves_dynamic) ** 2).sum(axis=0))
        got = {r["event_time"]: r for r in found.dynamic(spark).collect()}
        for e, want in zip(sorted(dynamic), se):
            assert abs(got[e]["att"] - dynamic[e]) < 1e-7 and abs(got[e]["se"] - want) < 1e-4 * max(se)
            assert abs(got[e]["conf_high"] - got[e]["att"] - 1.959963984540054 * got[e]["se"]) < 1e-9


def test_dynamic_errors_match_a_person_bootstrap(spark):
    import numpy as np

    from epicohort.operators.att import group_time_effects
    rows = _panel(12)
    people = sorted({r[0] for r in rows})
    rng = np.random.default_rng(1)
    draws = []
    for _ in range(400):
        picked = rng.choice(people, len(people))
        draws.append(_by_hand(rows, ["age"], dict(zip(*np.unique(picked, return_counts=True))))[1])
    for r in group_time_effects(_frame(spark, rows), "y", covariates=["age"]).dynamic(spark).collect():
        spread = np.std([d[r["event_time"]] for d in draws])
        assert abs(r["se"] - spread) <= 0.2 * spread + 1e-9


def test_a_constant_covariate_changes_nothing_and_missing_ones_leave(spark):
    from epicohort.operators.att import group_time_effects
    rows = _panel(13, persons=80)
    plain = group_time_effects(_frame(spark, rows), "y")
    constant = group_time_effects(_frame(spark, [(*r[:3], 40.0, "f", r[5]) for r in rows]), "y", covariates=["age", "sex"])
    for a, b in zip(plain.table(spark).collect(), constant.table(spark).collect()):
        assert all(abs(x - z) < 1e-8 for x, z in zip(a, b))
    holes = [(*r[:3], None, r[4], r[5]) if i % 7 == 0 else r for i, r in enumerate(rows)]
    got = group_time_effects(_frame(spark, holes), "y", covariates=["age"])
    want, _ = _by_hand([r for r in holes if r[3] is not None], ["age"])
    for p in got.pairs:
        assert abs(p["att"] - want[p["group"], p["time"]]) < 1e-7
    assert group_time_effects(_frame(spark, []), "y").table(spark).count() == 0
