"""Two-way fixed-effects event studies on Spark.

outcome ~ bin dummies + natural spline(age) + controls | person + month,
errors clustered by person.

The person effect is absorbed by demeaning within person; month effects
enter as explicit dummies (first level dropped), which by Frisch-Waugh is the
full two-way dummy regression.  Several outcomes and several strata (or
variants of one model, stacked) are fitted in the same passes.  Everything
comes from sufficient statistics, so no person's rows are ever gathered in one
task:

* outcomes and numeric columns are centred on their person means first (a
  grouped aggregate, joined back), so no later sum cancels large levels; the join
  leaves each person's rows beside each other, with how many they are;
* pass 1 (rows, any partitioning): Z'Z for z = [x, y...] and, of every person
  whose rows a task has seen to the last, S_i S_i'/n_i of its sums S_i; the
  within-person Gram is Z'Z - sum_i S_i S_i'/n_i.  Both are one packed triangle per
  task and stratum;
* the k x k systems are solved on the driver;
* pass 2 (rows, coefficients shipped): per-person sums of x and x r with r = y - x b,
  and sum r^2; cluster score s_i = sum_t x_it r_it - S_x,i (S_y,i - S_x,i b) / n_i,
  meat = sum s_i s_i', RSS = sum r^2 - sum_i (S_y,i - S_x,i b)^2 / n_i.

A person whose rows lie in several tasks leaves a partial vector in each; those few are
summed by person in two rounds and go through the same sums.  So a person holding a third
of all rows costs one partial vector per task, and no vector of another person
leaves its task.  Triangles are summed in two rounds.  The width of a model
is set by its design (bins, months, spline terms, interactions), not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.functions.columns import in_order, level_order_of, reference_of
from epicohort.functions.dist import chi2_upper, normal_two_sided, t_quantile_975, t_two_sided
from epicohort.operators.quantiles import quantile_values
from epicohort.session import ship_package
from epicohort.sources.io import stash

Z975 = 1.959963984540054
#: A column whose variance after the columns before it is below this share of its own is collinear.
COLLINEAR = 1e-9
#: A numeric column whose centred sum of squares is below this share of its own does not vary within persons.
CONSTANT = 1e-24


# ----------------------------------------------------------------- spline basis
def natural_spline_knots(df: DataFrame, col: str, dfree: int = 5, boundary=(0.1, 0.9)) -> list[float]:
    """M2 knots: boundary knots at the given quantiles and dfree-1 interior
    knots at equally spaced quantiles of the values between them (exact)."""
    lo, hi = quantile_values(df, col, list(boundary))
    inner = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
    probs = [i / dfree for i in range(1, dfree)]
    return [lo] + quantile_values(inner, col, probs) + [hi]


def _b_splines(x: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """B-splines of the knots ``t`` at the points ``x`` inside them, by the recursion in the degree (0 / 0 is 0)."""
    last = np.flatnonzero(t < t[-1])[-1]
    out = np.array([(x >= t[i]) & ((x < t[i + 1]) | ((i == last) & (x == t[-1]))) for i in range(len(t) - 1)], float).T
    share = lambda num, den: num / den if den > 0 else 0.0 * num
    for k in range(1, degree + 1):
        out = np.column_stack([share(x - t[i], t[i + k] - t[i]) * out[:, i] + share(t[i + k + 1] - x, t[i + k + 1] - t[i + 1]) * out[:, i + 1]
                               for i in range(len(t) - k - 1)])
    return out


def _b_spline_slopes(x: np.ndarray, t: np.ndarray, degree: int, times: int) -> np.ndarray:
    """Derivatives of B-splines: differences of those one degree lower."""
    if not times:
        return _b_splines(x, t, degree)
    low = _b_spline_slopes(x, t, degree - 1, times - 1)
    share = lambda i: degree / (t[i + degree] - t[i]) if t[i + degree] > t[i] else 0.0
    return np.column_stack([share(i) * low[:, i] - share(i + 1) * low[:, i + 1] for i in range(low.shape[1] - 1)])


def natural_spline_basis(x: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """M2 in numbers: cubic B-splines without the first one, the second derivatives at
    the boundary knots projected out by a QR decomposition (Householder), linear beyond
    the boundary: the basis, columns and signs, that the reference's models report on."""
    k = np.asarray(knots, float)
    t = np.concatenate([[k[0]] * 3, k, [k[-1]] * 3])
    inside = np.clip(x, k[0], k[-1])
    basis = _b_splines(inside, t, 3) + (x - inside)[:, None] * _b_spline_slopes(inside, t, 3, 1)
    curve = _b_spline_slopes(k[[0, -1]], t, 3, 2)[:, 1:]
    return basis[:, 1:] @ np.linalg.qr(curve.T, mode="complete")[0][:, 2:]


def _truncated(x, knots, cube, split) -> list:
    """x and the K - 2 curvature terms of a natural cubic spline in truncated powers (linear beyond the boundary)."""
    last = knots[-1]
    d = [(cube(x, kj) - cube(x, last)) / (split(last) - split(kj)) for kj in knots[:-1]]
    return [x, *[dj - d[-1] for dj in d[:-1]]]


def natural_spline_change(knots: Sequence[float]) -> np.ndarray:
    """The matrix that takes the truncated-power terms (less a constant, which the person
    effects absorb) to the columns of ``natural_spline_basis``: both span the same splines."""
    k = np.asarray(knots, float)
    x = np.concatenate([np.linspace(lo, hi, 6) for lo, hi in zip(k[:-1], k[1:])] + [[k[0] - 1, k[-1] + 1]])
    terms = _truncated(x, list(k), lambda v, kj: np.maximum(v - kj, 0) ** 3, float)
    return np.linalg.lstsq(np.column_stack([np.ones_like(x), *terms]), natural_spline_basis(x, k), rcond=None)[0][1:]


def _spline_powers(x: Column, knots: Sequence[float | Column]) -> list[Column]:
    knots = [F.lit(float(k)) if not isinstance(k, Column) else k for k in knots]
    return _truncated(x.cast("double"), knots, lambda v, kj: F.greatest(v - kj, F.lit(0.0)) ** 3, lambda kj: kj)


def _spline_sums(powers: Sequence[Column], change, prefix: str) -> dict:
    return {f"{prefix}{j + 1}": reduce(lambda a, b: a + b, [t * row[j] for t, row in zip(powers, change)]) for j in range(len(powers))}


def natural_spline_terms(x: Column, knots: Sequence[float], prefix: str = "ns") -> dict:
    """M2: columns of the natural cubic spline basis (up to a constant each), as
    expressions: truncated powers times the change of basis."""
    return _spline_sums(_spline_powers(x, knots), natural_spline_change(knots).tolist(), prefix)


def with_natural_spline(df: DataFrame, x: str, knots: Sequence[Column], change, prefix: str = "ns") -> DataFrame:
    """``df`` with the basis columns where knots, and the rows of the change of basis, are
    columns that differ between rows; the powers are columns of their own in between, computed once."""
    powers = {f"_p{i}": p for i, p in enumerate(_spline_powers(F.col(x), knots))}
    out = df.withColumns(powers)
    return out.withColumns(_spline_sums([F.col(c) for c in powers], change, prefix)).drop(*powers)


def two_sided_p(stat: float, dof: float | None) -> float:
    """Student t p-value, or the normal one when dof is None."""
    if stat is None or not math.isfinite(stat):
        return float("nan")
    return normal_two_sided(stat) if dof is None else t_two_sided(stat, dof)


# ----------------------------------------------------------------- design
@dataclass
class Design:
    """Column layout shared by the Spark passes and the driver algebra."""
    factors: dict            # column -> list of kept levels (reference removed)
    numeric: list            # numeric column names (centred on the frame)
    absorb_month: str | None  # column whose levels become explicit dummies
    month_levels: list = field(default_factory=list)
    interact: str | None = None          # interaction factor column (M7)
    interact_levels: list = field(default_factory=list)
    interact_with: str | None = None     # factor interacted with ``interact``

    @property
    def absorbed(self) -> list:
        return [f"{self.absorb_month}{m}" for m in self.month_levels]

    @property
    def terms(self) -> list:
        t = [f"{c}{lv}" for c, levels in self.factors.items() for lv in levels]
        t += list(self.numeric)
        if self.interact:
            t += [f"{self.interact_with}{lv}:{self.interact}{g}" for lv in self.factors[self.interact_with]
                  for g in self.interact_levels]
        return t + self.absorbed

    def matrix(self, rows: pa.RecordBatch) -> np.ndarray:
        n = len(rows)
        out = np.zeros((n, len(self.terms)))
        at = 0

        def put(codes, width):
            nonlocal at
            hit = np.flatnonzero(codes >= 0)
            out[hit, at + codes[hit]] = 1.0
            at += width

        for c, levels in self.factors.items():
            put(_codes(rows.column(c), levels), len(levels))
        for c in self.numeric:
            out[:, at] = rows.column(c).to_numpy()
            at += 1
        if self.interact:
            levels = self.factors[self.interact_with]
            main, own = _codes(rows.column(self.interact_with), levels), _codes(rows.column(self.interact), self.interact_levels)
            both = (main >= 0) & (own >= 0)
            put(np.where(both, main * len(self.interact_levels) + own, -1), len(levels) * len(self.interact_levels))
        if self.absorb_month:
            put(_codes(rows.column(self.absorb_month), self.month_levels), len(self.month_levels))
        return out


def _codes(column: pa.Array, levels: Sequence) -> np.ndarray:
    """The place of each value among ``levels``, -1 for none."""
    if not (pa.types.is_string(column.type) or pa.types.is_integer(column.type)):
        column, levels = pa.array(column.to_pandas().astype(str)), [str(lv) for lv in levels]
    found = pc.index_in(column, value_set=pa.array(levels, column.type))
    return found.fill_null(-1).to_numpy().astype(np.int64)


# ----------------------------------------------------------------- sums over rows
FLUSH_PERSONS = 50000  # per-task bound on persons whose rows have not all come
FLUSH_NUMBERS = 2_000_000  # the same in numbers (persons times width), and of what is emitted at a time
BLOCK_NUMBERS = 2_000_000  # rows times width that a task works on at a time
REDUCERS = 32          # tasks of a first round of sums at most, and partial sums of a person in the second

SUMS = "kind int, s string, pid string, n long, v array<double>"
_SUMS_ARROW = pa.schema([("kind", pa.int32()), ("s", pa.string()), ("pid", pa.string()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))])


def _pack(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def _unpack(v: np.ndarray, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = v
    return m + np.triu(m, 1).T


def _sums_batch(kind: int, s: list, pid, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows of ``SUMS``; ``v`` has a vector in each row."""
    ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), kind, np.int32)), pa.array(s, pa.string()), pa.array(pid, pa.string()),
                                       pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], schema=_SUMS_ARROW)


class _Held:
    """Sums of a stratum's persons whose rows have not all come, in a task."""

    def __init__(self):
        self.pid, self.n, self.need, self.v, self.merged = [], [], [], [], 0

    def add(self, pid, n, need, v):
        self.pid.append(pid)
        self.n.append(n)
        self.need.append(need)
        self.v.append(v)

    def __len__(self):
        return sum(map(len, self.n))

    def take_complete(self):
        """(row counts, sums) of the persons that are complete now; the others stay, one vector each."""
        pid, n, need, v = (np.concatenate(x) for x in (self.pid, self.n, self.need, self.v))
        codes, _ = pd.factorize(pid)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        first = order[starts]
        n, v = np.add.reduceat(n[order], starts), np.add.reduceat(v[order], starts, axis=0)
        done = n == need[first]
        self.pid, self.n, self.need, self.v = [pid[first[~done]]], [n[~done]], [need[first[~done]]], [v[~done]]
        self.merged = len(self)
        return n[done], v[done]


def _row_pass(build, fold, width: int, flush: int):
    """A ``mapInArrow`` function over rows (``_s``, ``_pid``, ``_n``: the person's rows in all, ...):
    ``build(s, rows, starts)`` gives the sums of each person's run of rows, ``width`` numbers,
    and one total of the rows; ``fold(s, v, n)`` one total of whole persons.  Emits both totals of each
    stratum, joined, once per task (kind 0), and the sums of persons who were not whole here
    (kind 1), ``flush`` persons at a time."""
    at_most = max(1, min(flush, FLUSH_NUMBERS // max(width, 1)))
    step = max(64, BLOCK_NUMBERS // max(width, 1))

    def people_rows(s, held):
        pid, n, v = (np.concatenate(x) for x in (held.pid, held.n, held.v))
        for i in range(0, len(n), at_most):
            own = slice(i, i + at_most)
            yield _sums_batch(1, [s] * len(n[own]), pid[own], n[own], v[own])

    def blocks(batches):
        for batch in batches:
            s, pid = (batch.column(c).dictionary_encode() for c in ("_s", "_pid"))
            key = s.indices.to_numpy().astype(np.int64) * len(pid.dictionary) + pid.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            if (order[1:] < order[:-1]).any():
                batch, key = batch.take(pa.array(order)), key[order]
            names = s.dictionary.to_pylist()
            own = key // max(len(pid.dictionary), 1)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                for i in range(lo, hi, step):
                    j = min(i + step, hi)
                    yield names[own[i]], batch.slice(i, j - i), np.flatnonzero(np.diff(key[i:j], prepend=-1))

    def run(batches):
        totals: dict = {}
        held: dict = {}

        def whole(s, v, n):
            if len(n):
                own = fold(s, v, n)
                totals[s][1] = own if totals[s][1] is None else totals[s][1] + own

        for s, rows, starts in blocks(batches):
            v, total = build(s, rows, starts)
            if s in totals:
                totals[s][0] += total
            else:
                totals[s], held[s] = [total, None], _Held()
            n = np.diff(np.append(starts, len(rows)))
            need = rows.column("_n").to_numpy()[starts]
            done = n == need
            whole(s, v[done], n[done])
            if not done.all():
                open_ = np.flatnonzero(~done)
                held[s].add(np.array(rows.column("_pid").take(pa.array(starts[open_])).to_pylist(), object), n[open_], need[open_], v[open_])
            if len(held[s]) >= min(at_most, 64 + 2 * held[s].merged):
                n, v = held[s].take_complete()
                whole(s, v, n)
                if len(held[s]) >= at_most:
                    yield from people_rows(s, held[s])
                    held[s] = _Held()
        for s, own in held.items():
            if len(own):
                n, v = own.take_complete()
                whole(s, v, n)
                yield from people_rows(s, own)
        nobody = np.zeros((0, width)), np.zeros(0)
        for s, (rows, people) in totals.items():
            total = np.concatenate([rows, fold(s, *nobody) if people is None else people])
            yield _sums_batch(0, [s], [None], np.zeros(1), total[None])
    return run


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _person_pass(build):
    """A ``mapInArrow`` function over rows of ``SUMS``: ``build(s, v, n)`` gives one total of vectors and counts."""
    def run(batches):
        totals: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            names = batch.column("s").dictionary_encode()
            own, n, v = names.indices.to_numpy(), batch.column("n").to_numpy(), batch.column("v")
            for i, s in enumerate(names.dictionary.to_pylist()):
                at = np.flatnonzero(own == i)
                total = build(s, _vectors(v.take(pa.array(at))), n[at])
                totals[s] = totals[s] + total if s in totals else total
        for s, t in totals.items():
            yield _sums_batch(0, [s], [None], np.zeros(1), t[None])
    return run


def _totals(rows: DataFrame) -> dict:
    """Sum of the tasks' totals per stratum: first in REDUCERS tasks, then REDUCERS vectors per stratum on the driver."""
    part = _person_pass(lambda s, v, n: v.sum(axis=0))
    out: dict = {}
    tasks = min(REDUCERS, rows.sparkSession.sparkContext.defaultParallelism)
    table = rows.where(F.col("kind") == 0).repartition(tasks).mapInArrow(part, SUMS).toArrow()  # a vector of each task and stratum
    for s, v in zip(table.column("s").to_pylist(), table.column("v")):
        own = v.values.to_numpy()
        out[s] = out[s] + own if s in out else own.copy()
    return out


def _people(rows: DataFrame, width: int) -> DataFrame:
    """One summed vector per stratum and person, in two rounds: a person who is in
    every task meets its partial vectors in REDUCERS groups first."""
    add = lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)
    zero = F.array_repeat(F.lit(0.0), width)
    out = rows.where(F.col("kind") == 1).withColumn("_part", F.spark_partition_id() % REDUCERS)
    for keys in (["s", "pid", "_part"], ["s", "pid"]):
        out = out.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("v").alias("_vs"))
        out = out.select(*keys, "n", F.aggregate("_vs", zero, add).alias("v"))
    return out


def _pass_totals(data: DataFrame, build, fold, width: int, rows_width: int | dict, flush: int, name: str) -> tuple[dict, dict]:
    """Totals per stratum of a ``_row_pass``: (those of the rows, ``rows_width`` numbers, by stratum where they differ; those of the persons)."""
    sums = stash(data.mapInArrow(_row_pass(build, fold, width, flush), SUMS), name)
    of_tasks = _totals(sums)
    split = _people(sums, width).select(F.lit(0).alias("kind"), "s", "pid", "n", "v")  # persons with rows in several tasks
    of_split = _totals(split.mapInArrow(_person_pass(fold), SUMS))
    cut = {s: rows_width[s] if isinstance(rows_width, dict) else rows_width for s in of_tasks}
    return ({s: v[:cut[s]] for s, v in of_tasks.items()},
            {s: v[cut[s]:] + of_split.get(s, 0.0) for s, v in of_tasks.items()})


# ----------------------------------------------------------------- results
@dataclass
class FEResult:
    terms: list
    estimate: np.ndarray
    cov: np.ndarray
    n: int
    n_clusters: int
    rss: float
    tss_within: float
    n_absorbed: int
    dropped: list
    label: str = ""
    absorbed: list = field(default_factory=list)   # terms that are absorbed effects, not results
    by_levels: list = field(default_factory=list)
    absorbed_rank: int = 0   # effects that were absorbed beside the persons' (see ``absorb``)

    @property
    def k(self) -> int:
        return int(np.sum(~np.isnan(self.estimate))) + self.absorbed_rank

    @property
    def dof(self) -> int:
        """Degrees of freedom of statistics and intervals: clusters less one."""
        return max(self.n_clusters - 1, 1)

    def std_error(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def loglik(self) -> float:
        n = self.n
        return -0.5 * n * (math.log(2 * math.pi) + math.log(max(self.rss, 1e-300) / n) + 1)

    def aic(self) -> float:
        """M5: AIC counting estimated coefficients (month effects among them), person effects and the variance."""
        return -2 * self.loglik() + 2 * (self.k + self.n_absorbed + 1)

    def bic(self) -> float:
        return -2 * self.loglik() + math.log(self.n) * (self.k + self.n_absorbed + 1)

    def rows(self, scale: str | None = None) -> list[dict]:
        """M4 + M6: tidy rows of all terms but absorbed effects and levels that
        no row has; scale 'percent' multiplies by 100, 'log' gives
        exp(estimate) - 1 in percent.  Statistics and intervals are Student t's."""
        se = self.std_error()
        crit = t_quantile_975(self.dof)
        out = []
        skip = set(self.absorbed)
        for i, t in enumerate(self.terms):
            if t in skip:
                continue
            est = float(self.estimate[i])
            s = float(se[i]) if not math.isnan(est) else float("nan")
            stat = est / s if s and not math.isnan(est) else float("nan")
            lo, hi = est - crit * s, est + crit * s
            if scale == "percent":
                est, s, lo, hi = est * 100, s * 100, lo * 100, hi * 100
            elif scale == "log":
                est, lo, hi = (math.exp(est) - 1) * 100, (math.exp(lo) - 1) * 100, (math.exp(hi) - 1) * 100
            out.append({"term": t, "estimate": _nn(est), "std_error": _nn(s), "statistic": _nn(stat),
                        "p_value": _nn(two_sided_p(stat, self.dof)), "conf_low": _nn(lo), "conf_high": _nn(hi)})
        return out

    TIDY = ("term string, estimate double, std_error double, statistic double, p_value double, "
            "conf_low double, conf_high double")

    def tidy(self, spark, scale: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows(scale), self.TIDY)

    def effects_by_level(self, factor: str, by: str, by_levels: list, reference) -> list[dict]:
        """M7: effect of each ``factor`` level within each ``by`` level: the
        main term for the reference level, main + interaction otherwise, with
        se = sqrt(v_main + v_int + 2 cov) and z-based interval and p-value."""
        idx = {t: i for i, t in enumerate(self.terms)}
        out = []
        for t in self.terms:
            if not t.startswith(factor) or ":" in t:
                continue
            i = idx[t]
            for lv in [reference] + [x for x in by_levels if str(x) != str(reference)]:
                j = idx.get(f"{t}:{by}{lv}")
                est = self.estimate[i] + (self.estimate[j] if j is not None else 0.0)
                var = self.cov[i, i] + ((self.cov[j, j] + 2 * self.cov[i, j]) if j is not None else 0.0)
                se = math.sqrt(var) if var == var and var >= 0 else float("nan")
                z = est / se if se and se == se else float("nan")
                out.append({"term": t, "level": str(lv), "estimate": _nn(float(est)), "std_error": _nn(se),
                            "p_value": _nn(two_sided_p(z, None)), "conf_low": _nn(float(est - Z975 * se)),
                            "conf_high": _nn(float(est + Z975 * se))})
        return out

    def fit_stats(self) -> dict:
        return {"n_obs": self.n, "n_clusters": self.n_clusters, "rss": self.rss, "aic": self.aic(),
                "bic": self.bic(), "r2_within": 1 - self.rss / self.tss_within if self.tss_within else None}


def _nn(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def lr_test(restricted: FEResult, full: FEResult) -> dict:
    """M5: likelihood-ratio test of nested models (chi-square p-value)."""
    stat = 2 * (full.loglik() - restricted.loglik())
    dof = max(full.k - restricted.k, 1)
    return {"statistic": stat, "df": dof, "p_value": chi2_upper(stat, dof)}


# ----------------------------------------------------------------- fitting
def _centred(df: DataFrame, by: str | None, person: str, values: Sequence[str], keep: Sequence[str]):
    """Complete rows with ``values`` less their person means (within the stratum) and ``_n``, the person's
    number of rows, as a stored stage; and the values' sums of squares before that, per stratum.  The
    join sorts, so a person's rows lie beside each other but for hot persons, whose partitions are split."""
    data = df.select((F.col(by).cast("string") if by else F.lit("")).alias("_s"), F.col(person).cast("string").alias("_pid"),
                     *[F.col(c).cast("double").alias(c) for c in values], *keep).dropna()
    means = data.groupBy("_s", "_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in values],
                                           *[F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in values])
    means = stash(means, "fe_means")
    squares = {r["_s"]: np.array([r[c] for c in values]) for r in
               means.groupBy("_s").agg(*[F.sum(f"_q_{c}").alias(c) for c in values]).collect()}
    means = means.withColumnsRenamed({"_s": "_ms", "_pid": "_mp"})
    means = means.drop(*[f"_q_{c}" for c in values])
    own = data.join(means.hint("merge"), (F.col("_s") == F.col("_ms")) & (F.col("_pid") == F.col("_mp")))
    return stash(own.select("_s", "_pid", "_n", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in values], *keep), "fe_rows"), squares


def fit_models(df: DataFrame, outcomes: Sequence[str], factors: dict, numeric: Sequence[str] = (),
               person: str = "census_id_final", month: str | None = "month_label", interact: tuple | None = None,
               by: str | None = None, small_sample: bool = True, partitions: int | None = None,
               flush_persons: int = FLUSH_PERSONS) -> dict:
    """M1 (+M3, M7, M9, M11): one fit for each stratum of ``by`` and each outcome,
    all in the same passes; keys of the result are (stratum, outcome).

    factors: {column: reference level} expanded to dummies; a reference of None is that
    of the column's metadata (``columns.set_reference``, L14), else the first level.  The
    metadata's reference and level order also say which level of an interaction or of
    the month effects is left out, and in which order the terms come.  numeric: ready
    numeric columns; person: absorbed by demeaning and the cluster of the
    standard errors; month: explicit dummies (first level dropped);
    interact=(factor, by).  Rows with a missing value in any model column are
    left out, as a regression on complete cases does; outcomes that are missing
    on different rows belong in different calls.  A level that a stratum lacks
    is left out of its result; a collinear term has a NULL estimate.
    ``partitions`` spreads rows round-robin first (tests)."""
    spark = df.sparkSession
    ship_package(spark)
    outcomes, numeric = list(outcomes), list(numeric)
    labels = list(dict.fromkeys([*factors, *([month] if month else []), *([interact[1]] if interact else [])]))
    data, sizes = _centred(df, by, person, list(dict.fromkeys([*numeric, *outcomes])), labels)
    if partitions:
        data = data.repartition(partitions)
    found = data.agg(F.count(F.lit(1)).alias("_n"), *[F.collect_set(c).alias(c) for c in labels]).first()
    levels = {c: in_order(found[c], reference_of(df, c), level_order_of(df, c)) for c in labels}
    refs = {c: ref if ref is not None else levels[c][0] if levels[c] else None for c, ref in factors.items()}
    design = Design({c: [lv for lv in levels[c] if str(lv) != str(ref)] for c, ref in refs.items()}, numeric, month,
                    levels[month][1:] if month else [])
    if interact:
        design.interact_with, design.interact = interact
        design.interact_levels = levels[interact[1]][1:]
    at = sum(len(x) for x in design.factors.values())
    own = range(at, at + len(numeric))

    def floor(s, squares):
        out = COLLINEAR * squares
        out[own.start:own.stop] = CONSTANT * sizes[s][:len(numeric)]
        return out

    def x_of(s, rows, starts):
        return design.matrix(rows), np.column_stack([rows.column(c).to_numpy() for c in outcomes])
    return fit_passes(data, x_of, design.terms, outcomes, floor, own, by is not None, small_sample, flush_persons,
                      absorbed=design.absorbed, by_levels=levels[interact[1]] if interact else [])


def fit_passes(data: DataFrame, x_of, names: Sequence[str], outcomes: Sequence[str], floor, numeric: range, by: bool,
               small_sample: bool = True, flush_persons: int = FLUSH_PERSONS, scales: dict | None = None, absorbed_rank: dict | None = None,
               absorbed: Sequence[str] = (), by_levels: Sequence = ()) -> dict:
    """Both passes over ``data`` (``_s``, ``_pid``, ``_n``: the person's rows in all, ...) and the fits of each stratum
    and outcome.  ``x_of(s, rows, starts)`` gives the rows' terms (``names``) and outcomes as matrices; ``starts`` says where a
    person's run of rows begins.  ``floor(s, squares)``: sums of squares up to which a term counts as constant; ``numeric``:
    the terms that stay in a result where all are zero.  ``scales`` (by stratum: what collinearity is measured on) and
    ``absorbed_rank`` come with rows that had effects absorbed."""
    k, m = len(names), len(outcomes)
    kz = k + m

    def gram(s, rows, starts):
        z = np.hstack(x_of(s, rows, starts))
        return np.add.reduceat(z, starts, axis=0), _pack(z.T @ z)

    def between(s, v, n):
        return np.concatenate([_pack((v / n[:, None]).T @ v), [len(n), n.sum()]])
    raw, corr = _pass_totals(data, gram, between, kz, kz * (kz + 1) // 2, flush_persons, "fe_gram")
    solved, absent = {}, {}
    for s, v in raw.items():
        zt = _unpack(v - corr[s][:-2], kz)
        squares = v[_diagonal(kz)][:k]
        keep, inv = solve_normal(zt[:k, :k], floor(s, squares), scale=scales[s] if scales else None)
        beta = _times(inv, zt[:k, k:])
        solved[s] = (inv, beta, keep, np.diag(zt)[k:], int(corr[s][-2]), int(corr[s][-1]))
        absent[s] = {t for j, t in enumerate(names) if squares[j] == 0 and j not in numeric}
    betas = {s: x[1] for s, x in solved.items()}

    def residuals(s, rows, starts):
        x, y = x_of(s, rows, starts)
        r = y - x @ betas[s]
        sums = [np.add.reduceat(c, starts, axis=0) for c in (x, y, *[x * r[:, j:j + 1] for j in range(m)])]
        return np.hstack(sums), (r * r).sum(axis=0)

    def meat(s, v, n):
        out = []
        for j in range(m):
            mean = (v[:, k + j] - v[:, :k] @ betas[s][:, j]) / n
            own = v[:, kz + j * k:kz + (j + 1) * k] - v[:, :k] * mean[:, None]
            out += [_pack(own.T @ own), [float(np.sum(mean * mean * n))]]
        return np.concatenate(out)
    squares, meats = _pass_totals(data, residuals, meat, kz + k * m, m, flush_persons, "fe_scores")
    results, width = {}, k * (k + 1) // 2 + 1
    for s, (inv, beta, keep, tss, groups, n) in solved.items():
        gone = [j for j in range(k) if j not in keep]
        for j, y in enumerate(outcomes):
            own = meats[s][j * width:(j + 1) * width]
            cov = _times(_times(inv, _unpack(own[:-1], k)), inv)
            rank = (absorbed_rank or {}).get(s, 0)
            if small_sample and groups > 1 and n > len(keep) + rank:
                cov *= (groups / (groups - 1)) * ((n - 1) / (n - len(keep) - rank))
            est = beta[:, j].copy()
            est[gone], cov[gone, :], cov[:, gone] = np.nan, np.nan, np.nan
            here = [i for i, t in enumerate(names) if t not in absent[s]]
            terms = [names[i] for i in here]
            results[s if by else None, y] = FEResult(
                terms, est[here], cov[np.ix_(here, here)], n, groups, float(squares[s][j] - own[-1]), float(tss[j]), groups,
                [names[i] for i in gone if i in here], s, [t for t in absorbed if t not in absent[s]], list(by_levels), rank)
    return results


def fe_event_study(df: DataFrame, y: str, factors: dict, numeric: Sequence[str] = (),
                   person: str = "census_id_final", month: str | None = "month_label",
                   interact: tuple | None = None, partitions: int | None = None,
                   small_sample: bool = True, label: str = "", flush_persons: int = FLUSH_PERSONS) -> FEResult:
    """M1: one outcome over all rows (see ``fit_models``)."""
    res = fit_models(df, [y], factors, numeric, person, month, interact, None, small_sample, partitions, flush_persons)[None, y]
    res.label = label
    return res


def _diagonal(size: int) -> np.ndarray:
    """Places of the diagonal in a packed triangle."""
    i = np.arange(size)
    return i * size - i * (i - 1) // 2


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in one thread: a thread pool of the driver's linear algebra library
    would spin on cores that Spark's tasks hold."""
    return np.einsum("ij,jk->ik", a, b)


def solve_normal(within: np.ndarray, floor: np.ndarray, tol: float = COLLINEAR, scale: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """Columns kept, in order, and the inverse of their Gram matrix (0 elsewhere).  A
    column goes when it does not vary within persons (its sum of squares is at most
    its ``floor``), or when, on the scale of a unit diagonal, what the kept columns
    before it leave of its variance is below ``tol``.  One Gauss-Jordan sweep per
    kept column, k^3 in all; both tests are relative.  ``scale``: the sums of squares
    that stand for a unit diagonal, where they are not those of ``within``."""
    varies = np.diag(within) > floor
    own = np.diag(within) if scale is None else scale
    d = np.where(varies, 1 / np.sqrt(np.where(varies, own, 1.0)), 0.0)
    a = within * d[:, None] * d
    keep: list = []
    for j in np.flatnonzero(varies).tolist():
        pivot = a[j, j]
        if pivot <= tol:
            continue
        keep.append(j)
        row, col = a[j] / pivot, a[:, j].copy()
        a -= np.outer(col, row)
        a[j], a[:, j], a[j, j] = row, -col / pivot, 1 / pivot
    inverse = np.zeros_like(a)
    inverse[np.ix_(keep, keep)] = a[np.ix_(keep, keep)]
    return keep, inverse * d[:, None] * d
