"""Group-time average treatment effects.

ATT(g, t) compares the change of the cohort first treated in period g, from the
universal base period g-1 to period t, with what the units not yet treated by
max(t, g-1) (never treated included, the cohort itself excluded) would have
changed.  With unbalanced panels allowed, every period's observations stand for
themselves.  Without covariates the comparison is the difference of control
means; with covariates it is by outcome regression: the controls' outcome is
regressed on the covariates in period t and in period g-1, and the difference of the
two fits is averaged over the cohort's observations of both periods.

Everything comes from sums.  One grouped pass over the panel gives, per (group,
period) cell, the packed triangle of z'z for z = [1, covariates, outcome]; cells of
controls add up to the normal equations of each pair, (covariates + 1)^2
numbers that the driver solves.  A person's influence on every ATT(g, t) is
linear in the same packed triangle of its own observations (Callaway and
Sant'Anna 2021), so a second pass, over one row per person with at most one entry per
period, forms the vector of its influences on all pairs and adds up their
outer products: the joint covariance of all effects, clustered by person.
The dynamic aggregate and its standard error, the estimation of the group
weights included, are read off that matrix.  Intervals are pointwise and
normal; the reference's package draws a multiplier bootstrap instead, so its
intervals agree only approximately.  Rows with a missing outcome or covariate are
left out; a pair without treated or control observations in one of its two
periods has no effect and is absent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.operators.fe import SUMS, Z975, _pack, _totals, _unpack, solve_normal
from epicohort.session import ship_package
from epicohort.sources.io import stash


def six_month_panel(df: DataFrame, id_col: str = "census_id_final") -> DataFrame:
    """L17 + M17: person x six-month rows: mean deflated pay, minimum age,
    in-work flag, event time (treated: period - group + 1, else 0)."""
    g = df.groupBy(id_col, "six_month_num", "treat", "treatment_group", "census_sex").agg(
        F.avg("pay_deflated").alias("pay_deflated_six_month"),
        F.min("age_monthly").alias("age_monthly_six_month"))
    return g.withColumns({
        "in_work_six_month": F.when(F.col("pay_deflated_six_month") > 0, 1).otherwise(0),
        "event_time": F.when(F.col("treat") == 1, F.col("six_month_num") - F.col("treatment_group") + 1)
                       .otherwise(F.lit(0)).cast("long"),
        "cal_period": F.col("six_month_num"),
    })


@dataclass
class GroupTimeEffects:
    """ATT(g, t) of every pair, and the joint covariance of all of them and of the
    groups' sizes (``cov``: pairs first, then groups)."""
    pairs: list[dict]
    groups: list[int]
    sizes: dict[int, int]
    cov: np.ndarray

    PAIRS = ("group long, time long, event_time long, att double, se double, conf_low double, conf_high double, "
             "n_treated long, n_control long")
    DYNAMIC = "event_time long, att double, se double, conf_low double, conf_high double, n_groups long"

    def table(self, spark) -> DataFrame:
        """One row per pair."""
        rows = [(p["group"], p["time"], p["time"] - p["group"], p["att"], *_interval(p["att"], self.cov[i, i]),
                 p["n_treated"], p["n_control"]) for i, p in enumerate(self.pairs)]
        return spark.createDataFrame(rows, self.PAIRS)

    def dynamic(self, spark) -> DataFrame:
        """Per event time the mean of ATT(g, g + e) over the groups that have
        it, weighted by their numbers of persons.  A person of group g moves the
        weights, hence the mean, by (ATT(g, g + e) - mean) / (sum of weights)."""
        rows = []
        for e in sorted({p["time"] - p["group"] for p in self.pairs}):
            own = [(i, p) for i, p in enumerate(self.pairs) if p["time"] - p["group"] == e]
            w = np.array([self.sizes[p["group"]] for _, p in own], float)
            effects = np.array([p["att"] for _, p in own])
            mean = float(w @ effects / w.sum())
            c = np.zeros(len(self.cov))
            for (i, p), weight, effect in zip(own, w, effects):
                c[i] = weight / w.sum()
                c[len(self.pairs) + self.groups.index(p["group"])] = (effect - mean) / w.sum()
            rows.append((e, mean, *_interval(mean, float(c @ self.cov @ c)), len(own)))
        return spark.createDataFrame(rows, self.DYNAMIC)


def _interval(estimate: float, variance: float) -> tuple[float, float, float]:
    se = float(np.sqrt(max(variance, 0.0)))
    return se, estimate - Z975 * se, estimate + Z975 * se


def _design(df: DataFrame, y: str, t: str, g: str, id_col: str, covariates: Sequence[str]) -> DataFrame:
    """pid, G, T and z1.. = [1, covariates less their means, outcome less its mean] of the
    complete rows; a string covariate has a dummy for each level but the first.  The one scan
    before is for the means (sums then cancel nothing large) and the levels."""
    kinds = dict(df.dtypes)
    text = [c for c in covariates if kinds[c] == "string"]
    numeric = [c for c in covariates if c not in text] + [y]
    rows = df.select(F.col(id_col).cast("string").alias("pid"), F.col(g).cast("long").alias("G"), F.col(t).cast("long").alias("T"),
                     *[F.col(c).cast("double").alias(c) for c in numeric], *text).dropna(subset=["G", "T", *numeric, *text])
    known = rows.agg(*[F.avg(c).alias(c) for c in numeric], *[F.sort_array(F.collect_set(c)).alias(c) for c in text]).first()
    z = [F.lit(1.0)]
    for c in covariates:
        z += [(F.col(c) == lv).cast("double") for lv in known[c][1:]] if c in text else [F.col(c) - F.lit(known[c] or 0.0)]
    z.append(F.col(y) - F.lit(known[y] or 0.0))
    return rows.select("pid", "G", "T", *[x.alias(f"z{i}") for i, x in enumerate(z)])


def _controls(cells: dict, g: int, t: int, at: int) -> np.ndarray | None:
    """Sum of the cells of period ``at`` whose units are not yet treated by max(t, g - 1)."""
    found = [v for (own, when), v in cells.items() if when == at and own != g and (own == 0 or own > max(t, g - 1))]
    return np.sum(found, axis=0) if found else None


def group_time_effects(df: DataFrame, y: str, t: str = "six_month_num", g: str = "treatment_group",
                       id_col: str = "census_id_final", covariates: Sequence[str] = ()) -> GroupTimeEffects:
    """M15 + M16 (see the module's text); ``covariates`` are numeric or string columns."""
    spark = df.sparkSession
    ship_package(spark)
    rows = _design(df, y, t, g, id_col, covariates)
    size = len(rows.columns) - 3
    k = size - 1
    packed = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{q}") for q, (i, j) in enumerate(packed)]
    names = [f"m{q}" for q in range(len(packed))]
    # one row per person and period (map-side combined), from which the cells and the influences come
    people = stash(rows.groupBy("pid", "G", "T").agg(*sums), "att_people")
    cells = {(r["G"], r["T"]): np.array([r[m] for m in names]) for r in people.groupBy("G", "T").agg(*[F.sum(m).alias(m) for m in names]).collect()}
    sizes = {r["G"]: r["n"] for r in df.where(F.col(g) > 0).groupBy(F.col(g).cast("long").alias("G")).agg(F.countDistinct(id_col).alias("n")).collect()}

    pairs, weights = [], {key: {} for key in cells}  # weights: of a cell, by pair the functional of a person's packed sums
    ones = [q for q, (i, _) in enumerate(packed) if i == 0]  # of 1 * z

    def moment(index: int, vector: np.ndarray) -> np.ndarray:
        """The functional v' Z e_index of a packed symmetric matrix Z."""
        out = np.zeros(len(packed))
        for q, (i, j) in enumerate(packed):
            if j == index:
                out[q] += vector[i]
            if i == index and i != j:
                out[q] += vector[j]
        return out

    for own, when in sorted(cells):
        if own <= 0 or (own, own - 1) not in cells:
            continue
        post, pre = _unpack(cells[own, when], size), _unpack(cells[own, own - 1], size)
        control = {s: _controls(cells, own, when, at) for s, at in (("post", when), ("pre", own - 1))}
        if control["post"] is None or control["pre"] is None:
            continue
        n = {"post": post[0, 0], "pre": pre[0, 0]}
        mean = {"post": post[0, -1] / n["post"], "pre": pre[0, -1] / n["pre"]}
        both = post[0, :k] + pre[0, :k]
        profile = both / both[0]
        beta, lead = {}, {}
        for s in ("post", "pre"):
            m = _unpack(control[s], size)
            _, inverse = solve_normal(m[:k, :k], np.zeros(k))
            beta[s], lead[s] = inverse @ m[:k, -1], inverse @ profile
        change = beta["post"] - beta["pre"]
        counterfactual = float(profile @ change)
        q = len(pairs)
        pairs.append({"group": own, "time": when, "att": float(mean["post"] - mean["pre"] - counterfactual),
                      "n_treated": int(round(n["post"])), "n_control": int(round(control["post"][0]))})
        gap = np.zeros(size)  # of z: change' x - counterfactual, per observation of the cohort
        gap[:k] = change
        gap[0] -= counterfactual
        for s, at, sign in (("post", when, 1.0), ("pre", own - 1, -1.0)):
            level = np.zeros(size)
            level[-1], level[0] = 1.0, -mean[s]
            w = np.zeros(len(packed))
            w[ones] = sign * level / n[s] - gap / both[0]
            weights[own, at][q] = weights[own, at].get(q, 0.0) + w
            residual = np.zeros(size)
            residual[:k] = lead[s]
            score = moment(size - 1, residual) - sum(b * moment(i, residual) for i, b in enumerate(beta[s]))
            for (other, period), held in weights.items():
                if period == at and other != own and (other == 0 or other > max(when, own - 1)):
                    held[q] = held.get(q, 0.0) - sign * score
    groups = sorted({p["group"] for p in pairs})
    n_pairs, width = len(pairs), len(pairs) + len(groups)
    if not pairs:
        return GroupTimeEffects([], [], sizes, np.zeros((0, 0)))
    functionals = {key: (np.array(list(held)), np.array(list(held.values()))) for key, held in weights.items() if held}

    def run(batches):
        total = np.zeros(width * (width + 1) // 2)
        for batch in batches:
            obs = batch.column(0)
            owner = np.repeat(np.arange(len(obs)), np.diff(obs.offsets.to_numpy()))
            flat = obs.flatten()
            own, when = flat.field("G").to_numpy(), flat.field("T").to_numpy()
            values = np.column_stack([flat.field(m).to_numpy() for m in names])
            influence = np.zeros((len(obs), width))
            for (gg, tt), (at, w) in functionals.items():
                rows_of = np.flatnonzero((own == gg) & (when == tt))
                if len(rows_of):
                    influence[owner[rows_of][:, None], at] += values[rows_of] @ w.T
            for i, gg in enumerate(groups):
                influence[owner[own == gg], n_pairs + i] = 1.0
            total += _pack(influence.T @ influence)
        out = pd.DataFrame({"kind": np.zeros(1, np.int32), "s": [""], "pid": [None], "n": np.zeros(1, np.int64), "v": [total]})
        yield pa.RecordBatch.from_pandas(out, schema=_SUMS_ARROW, preserve_index=False)

    gathered = people.groupBy("pid").agg(F.collect_list(F.struct("G", "T", *names)).alias("obs"))  # a period each at most
    cov = _unpack(_totals(gathered.select("obs").mapInArrow(run, SUMS))[""], width)
    for i, gg in enumerate(groups):  # every person of the group weighs, observed or not
        cov[n_pairs + i, n_pairs + i] = sizes[gg]
    return GroupTimeEffects(pairs, groups, sizes, cov)


_SUMS_ARROW = pa.schema([("kind", pa.int32()), ("s", pa.string()), ("pid", pa.string()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))])


def att_gt(df: DataFrame, y: str, t: str = "six_month_num", g: str = "treatment_group", id_col: str = "census_id_final",
           covariates: Sequence[str] = ()) -> DataFrame:
    """(group, time, event_time, att, se, conf_low, conf_high, n_treated, n_control)."""
    return group_time_effects(df, y, t, g, id_col, covariates).table(df.sparkSession)


def att_standard_errors(df: DataFrame, att: DataFrame, y: str, id_col: str = "census_id_final", t: str = "six_month_num",
                        g: str = "treatment_group") -> DataFrame:
    """(group, time, se) of the effects in ``att``, which carries them already or else is joined with them."""
    found = att if "se" in att.columns else att.select("group", "time").join(att_gt(df, y, t, g, id_col), ["group", "time"])
    return found.select("group", "time", "se")


def aggregate_att(att: DataFrame, df: DataFrame, id_col: str = "census_id_final",
                  g: str = "treatment_group") -> DataFrame:
    """M16 points alone, for effects that come as a table: average of ATT(g, g+e) over groups weighted by group size."""
    sizes = df.where(F.col(g) > 0).groupBy(F.col(g).alias("group")).agg(
        F.countDistinct(id_col).alias("w"))
    j = att.join(sizes, "group")
    return j.groupBy("event_time").agg((F.sum(F.col("att") * F.col("w")) / F.sum("w")).alias("att"),
                                       F.count(F.lit(1)).alias("n_groups"))
