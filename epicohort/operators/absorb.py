"""M8: fits that absorb a wide factor beside the person effect.

outcome ~ terms | person + cell, where a cell is a level of a wide factor such as
region x month.  Neither effect becomes dummy columns.  The person effect goes by
centring; the cell effects g of a column z solve D'M D g = D'M z, where D says which
row is in which cell and M takes person means off.

Rows are stored narrow and each person's beside each other: cell, levels, numeric columns and
outcomes.  Dummies and the numeric columns in a factor's levels are made in the tasks
(``Columns``).  Systems of few cells (``MAX_FORMED`` numbers in all) are formed: one pass adds up
each stratum's D'M D and D'M z, and the steps of conjugate gradients (preconditioned by the cells'
sizes) are taken on the driver.  With more cells D'M D is never formed: a step needs D'M D v
alone, which is one pass over a stored table with one row per person (its cells and how often each
comes), with v broadcast and the result added up over the tasks.
All columns and strata take their steps together, each with its own length.  The columns
less their cell effects go through the usual fit's passes as they read the rows, and are centred on
the persons again there, so the Gram matrix, coefficients and clustered errors are those
of the regression with all dummies (Frisch-Waugh).

Cells are numbered by a range partitioning (``numbering.dense_id``): no list of
levels is collected, and what the driver holds is the vectors, cells times columns
numbers, ``MAX_NUMBERS`` at most.  The effect without such a bound is the
person's, which needs no vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.operators.fe import FLUSH_PERSONS, REDUCERS, _codes, _pass_totals, _times, fit_passes
from epicohort.operators.numbering import dense_id, lookup_join
from epicohort.session import ship_package
from epicohort.sources.io import stash

#: Most cells times columns: what is broadcast and added up at a time, in 8-byte numbers.
MAX_NUMBERS = 16_000_000
#: Most numbers of the strata's systems together that are formed, cells squared each.
MAX_FORMED = 4_000_000
#: Most cells whose numbers are looked up in a broadcast table.
BROADCAST_CELLS = 100_000
#: Steps end when every residual is below this share of its right side; more steps than this are an error.
RESIDUAL, MAX_STEPS = 1e-13, 1_000
#: A column whose sum of squares falls to this share when the effects are taken off is collinear with them.
ABSORBED = 1e-18

_VECTOR = "v array<double>"
_VECTOR_ARROW = pa.schema([("v", pa.list_(pa.float64()))])


def _emit(total: np.ndarray | None):
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], schema=_VECTOR_ARROW)


def _reduce(batches, add: Callable):
    total = None
    for batch in batches:
        for v in batch.column(0):
            own = v.values.to_numpy()
            total = own.copy() if total is None else add(total, own)
    yield from _emit(total)


def _added(parts: DataFrame, add: Callable = np.add) -> np.ndarray | None:
    """Elementwise sum of the tasks' vectors, in two rounds."""
    tasks = min(REDUCERS, parts.sparkSession.sparkContext.defaultParallelism)
    total = None
    for v in parts.repartition(tasks).mapInArrow(partial(_reduce, add=add), _VECTOR).toArrow().column(0):  # a vector of each task
        own = v.values.to_numpy()
        total = own.copy() if total is None else add(total, own)
    return total


class Cells:
    """The cells (numbered from 0): their strata and sizes, and D'M D as far as it is formed.  ``bounds``: (stratum,
    first, last cell).  The parts of a formed system come with ``form``, the persons' table with ``count``."""

    def __init__(self, spark, bounds: Sequence[tuple]):
        self.spark = spark
        self.strata = [s for s, _, _ in bounds]
        self.starts = np.array([a for _, a, _ in bounds], np.int64)
        self.n = bounds[-1][2] + 1 if bounds else 0
        self.widths = np.diff([*self.starts, self.n])
        self.formed = int((self.widths ** 2).sum()) <= MAX_FORMED
        self.people = self.between = None

    def form(self, sizes: dict, between: dict) -> None:
        """By stratum the cells' rows, and the sum over persons of c c' / n for a person's rows per cell c
        and rows n: D'D less D'M D."""
        self.sizes = np.concatenate([sizes[s] for s in self.strata])
        self.between = [between[s] for s in self.strata]

    def count(self, rows: DataFrame) -> None:
        """Rows (``_s``, ``_pid``, ``_c``) as one stored row for each person."""
        pairs = rows.groupBy("_s", "_pid", "_c").agg(F.count(F.lit(1)).cast("double").alias("n"))
        self.people = stash(pairs.groupBy("_s", "_pid").agg(F.collect_list(F.struct("_c", "n")).alias("obs")).select("obs"), "absorb_people")
        sizes = partial(_over_people, per_person=_cell_sizes, cells=self.n, v=None)
        self.sizes = _added(self.people.mapInArrow(sizes, _VECTOR))

    def _strata(self):
        return zip(self.between, [slice(a, a + w) for a, w in zip(self.starts, self.widths)])

    def over_people(self, v: np.ndarray, per_person: Callable, add: Callable = np.add) -> np.ndarray:
        """The sum over persons of ``per_person(cells, counts, owner, persons, v)``, a vector of v's shape."""
        sent = self.spark.sparkContext.broadcast(v)
        try:
            run = partial(_over_people, per_person=per_person, cells=self.n, v=sent, add=add)
            return _added(self.people.mapInArrow(run, _VECTOR), add).reshape(v.shape)
        finally:
            sent.unpersist()

    def apply(self, v: np.ndarray) -> np.ndarray:
        """D'M D v."""
        if self.between is not None:
            return self.sizes[:, None] * v - np.vstack([_times(m, v[own]) for m, own in self._strata()])
        return self.sizes[:, None] * v - self.over_people(v, _mean_back)

    def by_stratum(self, values: np.ndarray) -> np.ndarray:
        """Sums of rows over each stratum's cells."""
        return np.add.reduceat(values, self.starts, axis=0)

    def spread(self, per_stratum: np.ndarray) -> np.ndarray:
        return np.repeat(per_stratum, self.widths, axis=0)

    def least(self, label: np.ndarray) -> np.ndarray:
        """For each cell the least label of the cells that share a person with it."""
        if self.between is not None:
            return np.vstack([np.where(m > 0, label[own, 0], np.inf).min(axis=1)[:, None] for m, own in self._strata()])
        return self.over_people(label, _least_back, np.minimum)

    def ranks(self) -> dict[str, int]:
        """By stratum: cells less their connected parts, that is how many cell effects the person effects leave free."""
        label = np.arange(self.n, dtype=np.float64)[:, None]
        while True:
            least = np.minimum(label, self.least(label))
            if np.array_equal(least, label):
                break
            label = least
        own = (label[:, 0] != np.arange(self.n)).astype(np.int64)
        return dict(zip(self.strata, self.by_stratum(own).tolist()))

    def solve(self, b: np.ndarray) -> np.ndarray:
        """g with D'M D g = b, by conjugate gradients; every column and stratum is a system of its own."""
        weight = 1.0 / self.sizes[:, None]
        g, r = np.zeros_like(b), b.copy()
        z = weight * r
        p, rz = z.copy(), self.by_stratum(r * z)
        enough = RESIDUAL ** 2 * rz
        for _ in range(MAX_STEPS):
            going = rz > enough
            if not going.any():
                return g
            ap = self.apply(p)
            curve = self.by_stratum(p * ap)
            length = self.spread(np.where(going & (curve > 0), rz / np.where(curve > 0, curve, 1.0), 0.0))
            g += length * p
            r -= length * ap
            z = weight * r
            after = self.by_stratum(r * z)
            p = z + self.spread(np.where(going, after / np.where(rz > 0, rz, 1.0), 0.0)) * p
            rz = np.where(going & (curve > 0), after, 0.0)
        raise RuntimeError(f"the absorbed effects did not settle in {MAX_STEPS} steps")


def _over_people(batches, per_person: Callable, cells: int, v, add: Callable = np.add):
    total = None
    for batch in batches:
        obs = batch.column(0)
        if not len(obs):
            continue
        counts = np.diff(obs.offsets.to_numpy())
        flat = obs.flatten()
        cell, n = flat.field("_c").to_numpy(), flat.field("n").to_numpy()
        own = per_person(cell, n, np.repeat(np.arange(len(obs)), counts), len(obs), None if v is None else v.value, cells)
        total = own if total is None else add(total, own)
    yield from _emit(total)


def _cell_sizes(cell, n, owner, persons, v, cells):
    return np.bincount(cell, n, cells)


def _mean_back(cell, n, owner, persons, v, cells):
    """Each person's mean of v over its rows, added to the cells of its rows."""
    rows = np.bincount(owner, n, persons)
    out = np.empty((cells, v.shape[1]))
    for j in range(v.shape[1]):
        mean = np.bincount(owner, n * v[cell, j], persons) / rows
        out[:, j] = np.bincount(cell, n * mean[owner], cells)
    return out


def _least_back(cell, n, owner, persons, v, cells):
    least = np.full(persons, np.inf)
    np.minimum.at(least, owner, v[cell, 0])
    out = np.full((cells, 1), np.inf)
    np.minimum.at(out[:, 0], cell, least[owner])
    return out


def _cell_sums(batches, cells: int, columns: int):
    """Per cell the sums of rows (_c, columns...)."""
    total = np.zeros((cells, columns))
    for batch in batches:
        cell = batch.column(0).to_numpy()
        for j in range(columns):
            total[:, j] += np.bincount(cell, batch.column(j + 1).to_numpy(), cells)
    yield from _emit(total)


@dataclass
class Columns:
    """The columns of a fit, made from narrow rows in the tasks: dummies of the factors' levels (``_f0`` ...), numeric
    columns (``v0`` ..., less the person's mean), some of them in each level of ``_g``, and the outcomes.  ``_r0`` ... are the
    means that were taken off the columns in levels, for rows of persons with several levels, else missing: there the
    column in a level is that of the values themselves, so a person's rows differ from the true column by one number."""
    factors: Sequence[Sequence]   # the levels that have a dummy
    numeric: int
    within: Sequence[int]         # numeric columns that come in levels too
    levels: Sequence[str]
    outcomes: int

    @property
    def width(self) -> int:
        return sum(map(len, self.factors)) + self.numeric + len(self.levels) * len(self.within) + self.outcomes

    def matrix(self, rows: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        at = 0
        for i, levels in enumerate(self.factors):
            codes = _codes(rows.column(f"_f{i}"), levels)
            hit = np.flatnonzero(codes >= 0)
            out[hit, at + codes[hit]] = 1.0
            at += len(levels)
        values = [rows.column(f"v{i}").to_numpy() for i in range(self.numeric + self.outcomes)]
        for v in values[:self.numeric]:
            out[:, at] = v
            at += 1
        if self.levels:
            codes = _codes(rows.column("_g"), self.levels)
            own = np.column_stack([values[i] for i in self.within])
            for j in range(own.shape[1]):
                own[:, j] += rows.column(f"_r{j}").fill_null(0.0).to_numpy()
            hit = np.flatnonzero(codes >= 0)
            for j in range(own.shape[1]):
                out[hit, at + codes[hit] * own.shape[1] + j] = own[hit, j]
            at += len(self.levels) * own.shape[1]
        for v in values[self.numeric:]:
            out[:, at] = v
            at += 1
        return out

    def expressions(self) -> dict:
        """The same columns as Spark expressions of rows whose values have no mean taken off."""
        dummies = [F.col(f"_f{i}") == F.lit(lv) for i, levels in enumerate(self.factors) for lv in levels]
        values = [F.col(f"v{i}") for i in range(self.numeric + self.outcomes)]
        inside = [F.col(f"v{i}") * (F.col("_g") == F.lit(lv)).cast("double") for lv in self.levels for i in self.within]
        return {f"z{i}": x.cast("double") for i, x in enumerate([*dummies, *values[:self.numeric], *inside, *values[self.numeric:]])}


def _less_means(z: np.ndarray, rows: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    """``z`` less its person means, where all rows of the person are at hand (the others' sums are cleared up later)."""
    n = np.diff(np.append(starts, len(rows)))
    whole = n == rows.column("_n").to_numpy()[starts]
    means = np.add.reduceat(z, starts, axis=0) / n[:, None] * whole[:, None]
    return z - np.repeat(means, n, axis=0)


def _form(data: DataFrame, columns: Columns, cells: Cells) -> tuple[np.ndarray, dict]:
    """One pass: the cells' systems (see ``Cells.form``), D'M z of all columns, and by stratum the columns' sums of squares
    less the persons' means."""
    most, k = int(cells.widths.max()), columns.width
    first, wide = dict(zip(cells.strata, cells.starts)), dict(zip(cells.strata, cells.widths))

    def build(s, rows, starts):
        z = _less_means(columns.matrix(rows), rows, starts)
        c = rows.column("_c").to_numpy() - first[s]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        counts = np.bincount(owner * most + c, minlength=len(starts) * most).reshape(len(starts), most)
        sums = np.column_stack([np.bincount(c, z[:, j], wide[s]) for j in range(k)])
        return np.hstack([counts, np.add.reduceat(z, starts, axis=0)]), np.concatenate(
            [np.bincount(c, minlength=wide[s]), sums.ravel(), (z * z).sum(axis=0)])

    def fold(s, v, n):
        c, sums = v[:, :wide[s]], v[:, most:]
        share = c / n[:, None]
        return np.concatenate([(share.T @ c).ravel(), (share.T @ sums).ravel(), (sums * sums / n[:, None]).sum(axis=0)])

    # the number of a stratum's totals of rows depends on its cells
    cut = {s: int(w) * (1 + k) + k for s, w in wide.items()}
    of_rows, of_people = _pass_totals(data, build, fold, most + k, cut, FLUSH_PERSONS, "absorb_system")
    sizes, between, right, scales = {}, {}, [], {}
    for s in cells.strata:
        w, rows, people = int(wide[s]), of_rows[s], of_people[s]
        sizes[s], between[s] = rows[:w], people[:w * w].reshape(w, w)
        right.append((rows[w:w * (1 + k)] - people[w * w:w * (w + k)]).reshape(w, k))
        scales[s] = rows[w * (1 + k):] - people[w * (w + k):]
    cells.form(sizes, between)
    return np.vstack(right), scales


def _many_cells(rows: DataFrame, columns: Columns, cells: Cells) -> tuple[np.ndarray, dict]:
    """What ``_form`` gives without the systems, for any number of cells: the persons' table, and sums of centred columns."""
    cells.count(rows)
    wide = rows.select("_s", "_pid", "_c", *[x.alias(z) for z, x in columns.expressions().items()])
    names = wide.columns[3:]
    means = wide.groupBy("_s", "_pid").agg(*[F.avg(z).alias(f"_m_{z}") for z in names])
    means = stash(means, "absorb_column_means").withColumnsRenamed({"_s": "_ms", "_pid": "_mp"})
    centred = wide.join(means, (F.col("_s") == F.col("_ms")) & (F.col("_pid") == F.col("_mp"))).select(
        "_s", "_c", *[(F.col(z) - F.col(f"_m_{z}")).alias(z) for z in names])
    centred = stash(centred, "absorb_centred_columns")
    sums = centred.select("_c", *names).mapInArrow(partial(_cell_sums, cells=cells.n, columns=len(names)), _VECTOR)
    scales = {r["_s"]: np.array(r[1:]) for r in centred.groupBy("_s").agg(*[F.sum(F.col(z) * F.col(z)) for z in names]).collect()}
    return _added(sums).reshape(cells.n, len(names)), scales


def fit_absorbed(df: DataFrame, outcomes: Sequence[str], factors: dict, numeric: Sequence[str], cell: Sequence[str],
                 person: str = "census_id_final", by: str | None = None, small_sample: bool = True,
                 within: tuple[Sequence[str], str] | None = None) -> dict:
    """``fit_models`` with the effect of each combination of the ``cell`` columns absorbed
    instead of month dummies; the same keys and results, and ``absorbed_rank`` says how many
    cell effects count as parameters.  factors: {column: reference level}, whose other
    levels become terms.  ``within``: numeric columns, and a column in whose levels but the first
    each of them is a term too.  Rows with a missing value in any column are left out."""
    ship_package(df.sparkSession)
    outcomes, numeric = list(outcomes), list(numeric)
    inside, split = (list(within[0]), within[1]) if within else ([], None)
    stratum = F.col(by).cast("string") if by else F.lit("")
    key = F.to_json(F.struct(stratum.alias("s"), *[F.col(c).cast("string") for c in cell]))
    for c in cell:
        key = F.when(F.col(c).isNotNull(), key)
    rows = stash(df.select(stratum.alias("_s"), F.col(person).cast("string").alias("_pid"), (F.col(split).cast("string") if split else F.lit("")).alias("_g"),
                           *[F.col(c).alias(f"_f{i}") for i, c in enumerate(factors)],
                           *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate([*numeric, *outcomes])], key.alias("_key")), "absorb_rows")
    found = rows.agg(F.sort_array(F.collect_set("_g")).alias("_g"), *[F.sort_array(F.collect_set(f"_f{i}")).alias(f"_f{i}") for i in range(len(factors))]).first()
    kept = [[lv for lv in found[f"_f{i}"] if str(lv) != str(ref)] for i, ref in enumerate(factors.values())]
    levels = found["_g"][1:] if split else []  # the categories of one attribute
    columns = Columns(kept, len(numeric), [numeric.index(c) for c in inside], levels, len(outcomes))
    dummies = [f"{c}{lv}" for c, own in zip(factors, kept) for lv in own]
    terms = [*dummies, *numeric, *[f"{c}:{split}{lv}" for lv in levels for c in inside]]
    rows = rows.dropna()
    numbers = stash(dense_id(rows.select("_s", "_key").distinct(), "_key", "_c").withColumn("_c", F.col("_c") - 1), "absorb_cells")
    bounds = numbers.groupBy("_s").agg(F.min("_c").alias("a"), F.max("_c").alias("b")).orderBy("a").collect()
    if not bounds:
        return {}
    cells = Cells(df.sparkSession, [(r["_s"], r["a"], r["b"]) for r in bounds])
    if cells.n * columns.width > MAX_NUMBERS:
        raise ValueError(f"{cells.n} cells times {columns.width} columns are more than {MAX_NUMBERS}: absorb the larger effect as the person")
    if cells.n <= BROADCAST_CELLS:
        placed = rows.join(F.broadcast(numbers.drop("_s")), "_key")
    else:
        placed = lookup_join(rows, numbers.drop("_s"), "_key", "inner")
    values = [f"v{i}" for i in range(len(numeric) + len(outcomes))]
    means = rows.groupBy("_s", "_pid").agg(F.count(F.lit(1)).alias("_n"), (F.min("_g") != F.max("_g")).alias("_several"), *[F.avg(v).alias(f"_m_{v}") for v in values])
    means = stash(means, "absorb_means").withColumnsRenamed({"_s": "_ms", "_pid": "_mp"})
    own = placed.join(means.hint("merge"), (F.col("_s") == F.col("_ms")) & (F.col("_pid") == F.col("_mp")))
    raw = [F.when(F.col("_several"), F.col(f"_m_v{i}")).alias(f"_r{j}") for j, i in enumerate(columns.within)]
    data = stash(own.select("_s", "_pid", "_n", "_c", "_g", *raw, *[f"_f{i}" for i in range(len(factors))],
                            *[(F.col(v) - F.col(f"_m_{v}")).alias(v) for v in values]), "absorb_centred")
    squares = _squares(rows, columns)
    right, scales = _form(data, columns, cells) if cells.formed else _many_cells(placed, columns, cells)
    sent = df.sparkSession.sparkContext.broadcast(cells.solve(right))
    k = len(terms)

    def x_of(s, rows, starts):
        z = _less_means(columns.matrix(rows) - sent.value[rows.column("_c").to_numpy()], rows, starts)
        return z[:, :k], z[:, k:]

    # collinear is what the effects and the terms before leave too little of: measured on the columns before the effects went
    fits = fit_passes(data, x_of, terms, outcomes, lambda s, _: ABSORBED * squares[s], range(k), by is not None, small_sample,
                      scales={s: v[:k] for s, v in scales.items()}, absorbed_rank=cells.ranks())
    for (s, _), res in fits.items():
        # levels of factors that no row of the stratum has are no terms of its fit
        here = [i for i in range(k) if i >= len(dummies) or squares[s if by else ""][i] > 0]
        names = [terms[i] for i in here]
        res.estimate, res.cov, res.dropped = res.estimate[here], res.cov[np.ix_(here, here)], [t for t in res.dropped if t in names]
        res.terms = names
    return fits


def _squares(rows: DataFrame, columns: Columns) -> dict:
    """By stratum the terms' sums of squares, no mean taken off."""
    values = [f"v{i}" for i in range(columns.numeric)]
    by_level = rows.groupBy("_s", "_g").agg(*[F.sum(F.col(v) * F.col(v)).alias(v) for v in values], F.count(F.lit(1))).collect()
    counts = [rows.groupBy("_s", f"_f{i}").agg(F.count(F.lit(1)).alias("n")).collect() for i in range(len(columns.factors))]
    out = {}
    for s in {r["_s"] for r in by_level}:
        own = {r["_g"]: np.array(r[2:2 + len(values)], float) for r in by_level if r["_s"] == s}
        none = np.zeros(len(values))
        dummies = [sum(r["n"] for r in found if r["_s"] == s and r[1] == lv) for found, levels in zip(counts, columns.factors) for lv in levels]
        out[s] = np.array([*dummies, *sum(own.values()), *[own.get(lv, none)[i] for lv in columns.levels for i in columns.within]], float)
    return out
