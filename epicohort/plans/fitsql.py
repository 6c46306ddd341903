"""DuckDB SQL of the two-way fixed-effects fits, for the oracles.

Nothing is shared with the estimator: columns are demeaned with windows, the
normal equations are built in long form (one row per data row and non-zero
column), solved by sweeping pivots in a recursive query, and the clustered
covariance comes from residuals that are demeaned again.

``source`` is a CTE or subquery with columns s (fit), pid, y, bin (integer,
NULL for the reference level), mon (text), and numeric columns; each fit of
``s`` is solved for itself in the one recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from epicohort.operators.fe import COLLINEAR, CONSTANT


def knots_sql(name: str, source: str, col: str = "age_monthly") -> str:
    """CTEs ``name`` (s, k0..k5): spline knots of each fit's rows."""
    inner = ", ".join(f"quantile_cont(b.{col}, {i / 5}) AS k{i}" for i in range(1, 5))
    return f"""
{name}_b AS (SELECT s, quantile_cont({col}, 0.1) AS k0, quantile_cont({col}, 0.9) AS k5 FROM {source} GROUP BY s),
{name} AS (
  SELECT b.s, e.k0, e.k5, {inner} FROM {source} b JOIN {name}_b e ON e.s = b.s
  WHERE b.{col} >= e.k0 AND b.{col} <= e.k5 GROUP BY b.s, e.k0, e.k5)"""


def b_spline_sql(x: str = "age_monthly") -> list[str]:
    """Columns b2..b8: the cubic B-splines over knots k0..k5 (k0 and k5 four times) but the first, linear
    beyond the boundary; u1, u2 and w5..w7, the Householder vectors that take off the second
    derivatives at k0 (of b2, b3) and at k5 (of b6..b8), which have no spline in common."""
    t = ["k0"] * 4 + [f"k{i}" for i in range(1, 5)] + ["k5"] * 4
    xx = f"least(greatest({x}, k0), k5)"

    def b(i: int, k: int) -> str:
        if k == 0:
            if t[i] == t[i + 1]:
                return "0.0"
            return f"(CASE WHEN {xx} >= {t[i]} AND ({xx} < {t[i + 1]}{f' OR {xx} = k5' if t[i + 1] == 'k5' else ''}) THEN 1.0 ELSE 0.0 END)"
        parts = []
        if t[i] != t[i + k]:
            parts.append(f"coalesce(({xx} - {t[i]}) / nullif({t[i + k]} - {t[i]}, 0), 0) * {b(i, k - 1)}")
        if t[i + 1] != t[i + k + 1]:
            parts.append(f"coalesce(({t[i + k + 1]} - {xx}) / nullif({t[i + k + 1]} - {t[i + 1]}, 0), 0) * {b(i + 1, k - 1)}")
        return "(" + " + ".join(parts) + ")"
    low, high = f"3 * least({x} - k0, 0) / (k1 - k0)", f"3 * greatest({x} - k5, 0) / (k5 - k4)"
    more = {2: f" + {low}", 7: f" - {high}", 8: f" + {high}"}
    left = ("(-1 / (k1 - k0) - 1 / (k2 - k0))", "(1 / (k2 - k0))")
    right = ("(1 / (k5 - k3))", "(-1 / (k5 - k4) - 1 / (k5 - k3))", "(1 / (k5 - k4))")
    size_left = f"(-sqrt({left[0]} ** 2 + {left[1]} ** 2))"  # the sign of its first part
    size_right = f"sqrt({' + '.join(f'{r} ** 2' for r in right)})"
    return ([f"{b(i - 1, 3)}{more.get(i, '')} AS b{i}" for i in range(2, 9)]
            + [f"{left[0]} / {size_left} + 1 AS u1", f"{left[1]} / {size_left} AS u2"]
            + [f"{r} / {size_right} AS w{i + 5}" for i, r in enumerate(right)])


def spline_sql(prefix: str = "age_ns") -> list[str]:
    """The natural spline's columns ``{prefix}1`` ... ``{prefix}5`` over those of ``b_spline_sql``."""
    s = "(b3 - u2 * (u1 * b2 + u2 * b3) / u1 + w5 * b6 + w6 * b7 + w7 * b8)"
    return [f"b4 AS {prefix}1", f"b5 AS {prefix}2", f"b6 - w5 * {s} AS {prefix}3", f"b7 - w6 * {s} AS {prefix}4", f"b8 - w7 * {s} AS {prefix}5"]


def fit_ctes(f: str, source: str, numeric: Sequence[str] = (), interact: str | None = None,
             factor: str = "t_treatment_6_month", month: str = "month_label", month_first: bool = False) -> str:
    """CTEs with prefix ``f``; the results are ``{f}_coef`` (s, term, ord, kind, estimate,
    std_error, statistic), ``{f}_cov`` (s, a, b, v) for pairs of terms, and
    ``{f}_stat`` (s, n, g, kk, rss, aic, bic).  ``interact`` names a text column.  With ``month_first``
    the month effects are swept first, so that a term they explain is the one without an estimate."""
    month_ord = 0 if month_first else 4000000
    values = [*numeric, "y"]
    cols = ", ".join(values)
    full = " AND ".join(f"{c} IS NOT NULL" for c in ["s", "pid", "y", "mon", *numeric] + ([interact] if interact else []))
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY s, pid) AS {c}" for c in values)
    long = [f"SELECT s, rid, pid, '{factor}' || bin AS term, 1000000 + bin AS ord, 'bin' AS kind, CAST(1 AS DOUBLE) AS v FROM {f}_c WHERE bin IS NOT NULL"]
    long += [f"SELECT s, rid, pid, '{c}', {2000000 + i}, 'numeric', {c} FROM {f}_c" for i, c in enumerate(numeric)]
    if interact:
        long.append(f"""SELECT s, rid, pid, '{factor}' || bin || ':{interact}' || {interact},
          3000000 + 1000 * bin + dense_rank() OVER (ORDER BY {interact}), 'interaction', 1.0
          FROM {f}_c WHERE bin IS NOT NULL AND {interact} <> (SELECT min({interact}) FROM {f}_c)""")
    long.append(f"SELECT s, rid, pid, '{month}' || mon, {month_ord} + dense_rank() OVER (ORDER BY mon), 'month', 1.0 FROM {f}_c "
                f"WHERE mon <> (SELECT min(mon) FROM {f}_c)")
    long.append(f"SELECT s, rid, pid, 'y', 9000000, 'y', y FROM {f}_c")
    sizes = " UNION ALL ".join(f"SELECT s, '{c}' AS term, sum({c} * {c}) AS q FROM {f}_r GROUP BY s" for c in values)
    return f"""
{f}_r AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM {source} WHERE {full}),
{f}_c AS MATERIALIZED (SELECT * EXCLUDE ({cols}), {centred} FROM {f}_r),
{f}_z AS MATERIALIZED ({" UNION ALL ".join(long)}),
{f}_people AS (SELECT s, pid, count(*) AS n FROM {f}_c GROUP BY s, pid),
{f}_sum AS MATERIALIZED (SELECT s, pid, ord, sum(v) AS v FROM {f}_z GROUP BY s, pid, ord),
{f}_raw AS (SELECT a.s, a.ord AS i, b.ord AS j, sum(a.v * b.v) AS v FROM {f}_z a JOIN {f}_z b ON a.s = b.s AND a.rid = b.rid GROUP BY a.s, a.ord, b.ord),
{f}_btw AS (SELECT a.s, a.ord AS i, b.ord AS j, sum(a.v * b.v / p.n) AS v
            FROM {f}_sum a JOIN {f}_sum b ON a.s = b.s AND a.pid = b.pid JOIN {f}_people p ON p.s = a.s AND p.pid = a.pid
            GROUP BY a.s, a.ord, b.ord),
{f}_size AS ({sizes}),
{f}_terms AS MATERIALIZED (
  SELECT t.*, row_number() OVER (PARTITION BY t.s ORDER BY t.ord) AS p, coalesce(r.v, 0) AS raw, r.v - w.v AS within,
         CASE WHEN t.kind IN ('numeric', 'y') THEN {CONSTANT!r} * q.q ELSE {COLLINEAR!r} * r.v END AS least
  FROM (SELECT DISTINCT s, ord, term, kind FROM {f}_z) t
  JOIN {f}_raw r ON r.s = t.s AND r.i = t.ord AND r.j = t.ord JOIN {f}_btw w ON w.s = t.s AND w.i = t.ord AND w.j = t.ord
  LEFT JOIN {f}_size q ON q.s = t.s AND q.term = t.term),
{f}_g AS MATERIALIZED (
  SELECT a.s, a.p AS i, b.p AS j, CASE WHEN a.within > a.least AND b.within > b.least
         THEN (coalesce(r.v, 0) - coalesce(w.v, 0)) / sqrt(a.within) / sqrt(b.within) ELSE 0 END AS v
  FROM {f}_terms a JOIN {f}_terms b ON a.s = b.s
  LEFT JOIN {f}_raw r ON r.s = a.s AND r.i = a.ord AND r.j = b.ord LEFT JOIN {f}_btw w ON w.s = a.s AND w.i = a.ord AND w.j = b.ord),
{f}_last AS (SELECT s, max(p) AS y FROM {f}_terms GROUP BY s),
{f}_sweep AS (
  SELECT 0 AS step, s, i, j, v FROM {f}_g
  UNION ALL
  SELECT a.step + 1, a.s, a.i, a.j,
         CASE WHEN a.step + 1 >= l.y OR d.v <= {COLLINEAR!r} THEN a.v
              WHEN a.i = a.step + 1 AND a.j = a.step + 1 THEN -1 / d.v
              WHEN a.i = a.step + 1 OR a.j = a.step + 1 THEN a.v / d.v
              ELSE a.v - r.v * c.v / d.v END
  FROM {f}_sweep a JOIN {f}_last l ON l.s = a.s
  LEFT JOIN {f}_sweep d ON d.s = a.s AND d.i = a.step + 1 AND d.j = a.step + 1
  LEFT JOIN {f}_sweep r ON r.s = a.s AND r.i = a.i AND r.j = a.step + 1
  LEFT JOIN {f}_sweep c ON c.s = a.s AND c.i = a.step + 1 AND c.j = a.j
  WHERE a.step + 1 < (SELECT max(y) FROM {f}_last)),
{f}_end AS MATERIALIZED (SELECT s, i, j, v FROM {f}_sweep WHERE step = (SELECT max(y) FROM {f}_last) - 1),
{f}_kept AS MATERIALIZED (SELECT t.s, t.p, t.ord, t.term, t.kind, t.within FROM {f}_terms t JOIN {f}_last l ON l.s = t.s AND t.p < l.y
           JOIN {f}_end e ON e.s = t.s AND e.i = t.p AND e.j = t.p WHERE t.within > t.least AND e.v < -0.5),
{f}_inv AS MATERIALIZED (SELECT a.s, a.ord AS i, b.ord AS j, -e.v / sqrt(a.within) / sqrt(b.within) AS v
          FROM {f}_end e JOIN {f}_kept a ON a.s = e.s AND a.p = e.i JOIN {f}_kept b ON b.s = e.s AND b.p = e.j),
{f}_beta AS MATERIALIZED (SELECT a.s, a.ord, e.v * sqrt(y.within) / sqrt(a.within) AS b
           FROM {f}_kept a JOIN {f}_last l ON l.s = a.s JOIN {f}_end e ON e.s = a.s AND e.i = a.p AND e.j = l.y
           JOIN {f}_terms y ON y.s = a.s AND y.kind = 'y'),
{f}_fit AS (SELECT z.s, z.rid, sum(z.v * b.b) AS fit FROM {f}_z z JOIN {f}_beta b ON b.s = z.s AND b.ord = z.ord GROUP BY z.s, z.rid),
{f}_res0 AS (SELECT c.s, c.rid, c.pid, c.y - coalesce(x.fit, 0) AS r FROM {f}_c c LEFT JOIN {f}_fit x ON x.s = c.s AND x.rid = c.rid),
{f}_res AS MATERIALIZED (SELECT s, rid, pid, r - avg(r) OVER (PARTITION BY s, pid) AS e FROM {f}_res0),
{f}_score AS MATERIALIZED (SELECT z.s, z.pid, z.ord, sum(z.v * e.e) AS v FROM {f}_z z JOIN {f}_res e ON e.s = z.s AND e.rid = z.rid
            JOIN {f}_beta b ON b.s = z.s AND b.ord = z.ord GROUP BY z.s, z.pid, z.ord),
{f}_meat AS MATERIALIZED (SELECT a.s, a.ord AS i, b.ord AS j, sum(a.v * b.v) AS v FROM {f}_score a JOIN {f}_score b ON a.s = b.s AND a.pid = b.pid
           GROUP BY a.s, a.ord, b.ord),
{f}_half AS MATERIALIZED (SELECT a.s, a.i, m.j, sum(a.v * m.v) AS v FROM {f}_inv a JOIN {f}_meat m ON m.s = a.s AND m.i = a.j GROUP BY a.s, a.i, m.j),
{f}_stat0 AS MATERIALIZED (
  SELECT n.s, n.n, n.g, k.kk, r.rss, n.n * (ln(2 * pi()) + ln(r.rss / n.n) + 1) AS deviance
  FROM (SELECT s, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT pid) AS DOUBLE) AS g FROM {f}_c GROUP BY s) n
  JOIN (SELECT s, CAST(count(*) AS DOUBLE) AS kk FROM {f}_kept GROUP BY s) k ON k.s = n.s
  JOIN (SELECT s, sum(e * e) AS rss FROM {f}_res GROUP BY s) r ON r.s = n.s),
{f}_stat AS (SELECT *, deviance + 2 * (kk + g + 1) AS aic, deviance + ln(n) * (kk + g + 1) AS bic FROM {f}_stat0),
{f}_cov AS MATERIALIZED (SELECT h.s, h.i, a.i AS j, sum(h.v * a.v) * (t.g / (t.g - 1)) * ((t.n - 1) / (t.n - t.kk)) AS v
          FROM {f}_half h JOIN {f}_inv a ON a.s = h.s AND a.j = h.j JOIN {f}_stat t ON t.s = h.s GROUP BY h.s, h.i, a.i, t.g, t.n, t.kk),
{f}_coef AS MATERIALIZED (
  SELECT t.s, t.term, t.ord, t.kind, b.b AS estimate, sqrt(c.v) AS std_error, b.b / sqrt(c.v) AS statistic
  FROM {f}_terms t LEFT JOIN {f}_beta b ON b.s = t.s AND b.ord = t.ord LEFT JOIN {f}_cov c ON c.s = t.s AND c.i = t.ord AND c.j = t.ord
  WHERE t.kind NOT IN ('y', 'month'))"""


def t_tail_sql(x: str, dof: str, steps: int = 1000) -> str:
    """Two-sided Student t probability by Simpson's rule over [0, |x|]."""
    density = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi() * {dof})"
    nodes = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
             f"* (1 + (abs({x}) * i / {steps}.0) ** 2 / {dof}) ** (-({dof} + 1) / 2)))")
    return f"greatest(0.0, 1 - 2 * {density} * abs({x}) / {3 * steps}.0 * {nodes})"


def normal_tail_sql(z: str, steps: int = 1000) -> str:
    """Two-sided normal probability by Simpson's rule over [0, |z|]."""
    nodes = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
             f"* exp(-power(abs({z}) * i / {steps}.0, 2) / 2)))")
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * abs({z}) / {3 * steps}.0 * {nodes})"


def critical_ctes(f: str) -> str:
    """``{f}_crit`` (s, t): Student t's 97.5 % point for each fit, by bisection on Simpson
    sums of 1,000 steps (what is left of their error at 36 degrees of freedom is 1e-12)."""
    tail = t_tail_sql("((lo + hi) / 2)", "dof")
    return f"""
{f}_bis AS (
  SELECT s, 0 AS step, g - 1 AS dof, CAST(1.9 AS DOUBLE) AS lo, CAST(13.0 AS DOUBLE) AS hi FROM {f}_stat
  UNION ALL
  SELECT s, step + 1, dof, CASE WHEN {tail} > 0.05 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN {tail} > 0.05 THEN hi ELSE (lo + hi) / 2 END
  FROM {f}_bis WHERE step < 48),
{f}_crit AS (SELECT s, (lo + hi) / 2 AS t FROM {f}_bis WHERE step = 48)"""


def tidy_sql(f: str, scale: str = "NULL") -> str:
    """SELECT over coefficients, scaled, with p-values and intervals; ``scale`` is an SQL
    expression over c (percent, log or NULL)."""
    lo, hi = "c.estimate - k.t * c.std_error", "c.estimate + k.t * c.std_error"

    def scaled(x, log_too=True):
        log = f"WHEN {scale} = 'log' THEN (exp({x}) - 1) * 100" if log_too else ""
        return f"CASE WHEN {scale} = 'percent' THEN ({x}) * 100 {log} ELSE {x} END"
    return f"""SELECT c.s, c.term, c.ord, {scaled('c.estimate')} AS estimate, {scaled('c.std_error', False)} AS std_error, c.statistic,
       CASE WHEN c.statistic IS NOT NULL THEN {t_tail_sql('c.statistic', '(st.g - 1)')} END AS p_value,
       {scaled(lo)} AS conf_low, {scaled(hi)} AS conf_high
FROM {f}_coef c JOIN {f}_crit k ON k.s = c.s JOIN {f}_stat st ON st.s = c.s"""
