"""Seasonal autoregressive forecasts of many pay series in one job.

All series and all candidate orders are fitted together. Rows of lags are made
with window functions; every regression is a set of sums of products per series
(one grouped aggregate); only the tiny normal equations (at most 14 unknowns) are
solved in Python, Arrow batch by Arrow batch. Candidates of a series share one
set of sums, because each candidate uses a subset of the same regressors.

Estimator: differencing d, then a long autoregression whose residuals stand in for
the unobserved shocks, then least squares on own lags, shock lags and additive
lag-12 terms; the order with the smallest AIC on common rows wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.months import month_date
from hirecube.operators.series import (
    SERIES_KEYS, calendar_complete, group_series, min_history, salary_series,
)
from hirecube.session import checkpoint

SEASON = 12
LONG_LAGS = 13
SEASONAL_MIN_MONTHS = 48
MIN_FREE_ROWS = 10

# regressors shared by all candidates; the last entry is the target
TERMS = ["const", "w1", "w2", "w12", "e1", "e2", "e12", "w0"]


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    seasonal: bool

    @property
    def terms(self) -> list[int]:
        """Indices into TERMS."""
        own = [1, 2][: self.p] + ([3] if self.seasonal else [])
        shocks = [4, 5][: self.q] + ([6] if self.seasonal else [])
        return [0, *own, *shocks]


def order_grid(max_p: int = 2, max_d: int = 1, max_q: int = 2, seasonal: bool = True) -> list[Order]:
    return [
        Order(p, d, q, s)
        for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)
        for s in ([False, True] if seasonal else [False])
    ]


def _normal_equations():
    """Arrow UDF: least squares from sums of products.

    ``gram`` is the full k x k table of sums, row by row, with the target last.
    ``use`` lists the regressors; the others get 0. Also returns the residual sum
    of squares, the rank, and the spectral radius of the autoregressive part when
    ``lags`` says which regressors are own lags.
    """

    @F.pandas_udf("struct<beta:array<double>,rss:double,rank:int,radius:double>")
    def solve(gram: pd.Series, use: pd.Series, lags: pd.Series) -> pd.DataFrame:
        out = []
        for cells, terms, lag in zip(gram, use, lags):
            k = int(round(len(cells) ** 0.5))
            g = np.asarray(cells, dtype=float).reshape(k, k)
            idx = np.asarray(terms, dtype=int)
            a, b = g[np.ix_(idx, idx)], g[idx, -1]
            size = np.sqrt(np.clip(np.diag(a), 0.0, None))
            size[size == 0.0] = 1.0
            scaled, _, rank, _ = np.linalg.lstsq(a / np.outer(size, size), b / size, rcond=1e-10)
            beta = np.zeros(k - 1)
            beta[idx] = scaled / size
            rss = max(float(g[-1, -1] - 2 * beta[idx] @ b + beta[idx] @ a @ beta[idx]), 0.0)
            poly = np.zeros(max([0, *lag]) + 1)
            poly[0] = 1.0
            for term, step in enumerate(lag):
                if step > 0:
                    poly[step] -= beta[term]
            roots = np.roots(poly) if np.any(poly[1:]) else np.zeros(1)
            out.append((beta.tolist(), rss, int(rank), float(np.abs(roots).max(initial=0.0))))
        return pd.DataFrame(out, columns=["beta", "rss", "rank", "radius"])

    # keeps the optimizer from running it once for a filter and again for the output
    return solve.asNondeterministic()


def _gram(names: list[str]) -> Column:
    """Sums of products of all pairs, as one flat array (equal sums are computed once)."""
    k = range(len(names))
    cells = ", ".join(f"sum({names[min(i, j)]} * {names[max(i, j)]})" for i in k for j in k)
    return F.expr(f"array({cells})")


def _lag_rows(calendar: DataFrame, max_lag: int) -> DataFrame:
    """Standardised values with calendar-true lags y0..y{max_lag} and row position ``i``."""
    w = Window.partitionBy(*SERIES_KEYS).orderBy("t")
    y = (F.col("media_salario") - F.col("centro")) / F.col("escala")
    return calendar.withColumn("y0", y).withColumn("i", F.row_number().over(w) - 1).withColumns(
        {f"y{k}": F.lag("y0", k).over(w) for k in range(1, max_lag + 1)}
    )


def _differenced(lag: int, d: int) -> str:
    return f"y{lag}" if d == 0 else f"(y{lag} - y{lag + 1})"


def _structs(alternatives: list[dict[str, str]]) -> Column:
    """Rows out of column texts: one struct per alternative."""
    texts = ["named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + ")" for fields in alternatives]
    return F.expr(f"inline(array({', '.join(texts)}))")


def fit_candidates(calendar: DataFrame, grid: list[Order] | None = None) -> DataFrame:
    """One row per series and usable order: coefficients, variance, AIC, and the state to forecast from.

    ``calendar`` comes from :func:`calendar_complete`.
    """
    grid = order_grid() if grid is None else grid
    ds = sorted({o.d for o in grid})
    needs_shocks = any(o.q or o.seasonal for o in grid)
    solve = _normal_equations()
    series_window = Window.partitionBy(*SERIES_KEYS).orderBy("t")
    if needs_shocks:
        # the two regressions both start from the series, which are small: they are computed once
        calendar = checkpoint(calendar)

    seasonal_ok = F.col("n_obs") >= SEASONAL_MIN_MONTHS
    has_seasonal = any(o.seasonal for o in grid)
    rows = _lag_rows(calendar, LONG_LAGS + 1).withColumn("h", F.least(F.lit(LONG_LAGS), F.floor(F.col("n_obs") / 4)).cast("int"))

    if needs_shocks:
        # long autoregression: lags beyond h are switched off by a zero
        xs = [f"x{i}" for i in range(LONG_LAGS + 2)]

        def long_terms(d: int) -> list[str]:
            lags = [f"if({k} <= h, {_differenced(k, d)}, 0D)" for k in range(1, LONG_LAGS + 1)]
            return ["1D", *lags, _differenced(0, d)]

        stacked = rows.select(*SERIES_KEYS, "h", _structs([
            {"d": str(d), **dict(zip(xs, long_terms(d)))} for d in ds
        ]))
        sums = stacked.na.drop(subset=xs).groupBy(*SERIES_KEYS, "h", "d").agg(_gram(xs).alias("gram"))
        use = F.sequence(F.lit(0), F.col("h"))
        long_fit = sums.withColumn("beta", solve("gram", use, F.array(F.lit(0)))["beta"])
        wide = long_fit.groupBy(*SERIES_KEYS).agg(*[F.expr(f"max(if(d = {d}, beta, null)) AS long{d}") for d in ds])
        residuals = {
            f"e{d}_0": f"{_differenced(0, d)} - ("
            + " + ".join(f"get(long{d}, {i}) * {term}" for i, term in enumerate(long_terms(d)[:-1])) + ")"
            for d in ds
        }
        rows = rows.join(wide, SERIES_KEYS).withColumns({name: F.expr(text) for name, text in residuals.items()})
        rows = rows.withColumns({
            f"e{d}_{k}": F.lag(f"e{d}_0", k).over(series_window) for d in ds for k in (1, 2, SEASON)
        })
        first_row = F.col("h") + 1 + F.when(seasonal_ok & F.lit(has_seasonal), SEASON).otherwise(2)
    else:
        rows = rows.withColumns({f"e{d}_{k}": F.lit(0.0) for d in ds for k in (0, 1, 2, SEASON)})
        first_row = F.lit(max(o.p + o.d for o in grid))

    # the same rows for every candidate of a series, or their AICs would not compare
    max_p = max(o.p for o in grid)
    needed = {f"y{k}" for d in ds for k in range(max_p + d + 1)}
    seasonal_needed = {f"y{SEASON + k}" for d in ds for k in range(d + 1)} if has_seasonal else set()
    if needs_shocks:
        needed |= {f"e{d}_{k}" for d in ds for k in (1, 2)}
        seasonal_needed |= {f"e{d}_{SEASON}" for d in ds}

    def present(names) -> str:
        return "(" + " AND ".join(f"{name} IS NOT NULL" for name in sorted(names)) + ")" if names else "true"

    usable = (
        (F.col("i") >= first_row) & F.expr(present(needed)) & (F.expr(present(seasonal_needed)) | ~seasonal_ok)
    )

    def regressors(d: int) -> dict[str, str]:
        season = f"n_obs >= {SEASONAL_MIN_MONTHS}"
        values = {
            "const": "1D",
            "w1": _differenced(1, d), "w2": _differenced(2, d),
            "w12": f"if({season}, {_differenced(SEASON, d)}, 0D)",
            "e1": f"e{d}_1", "e2": f"e{d}_2", "e12": f"if({season}, e{d}_{SEASON}, 0D)",
            "w0": _differenced(0, d),
        }
        # rows outside the common set weigh nothing
        masked = {n: f"if(usable, {values[n]}, 0D)" for n in TERMS}
        return {"d": str(d), **masked, "w": _differenced(0, d), "e": f"e{d}_0"}

    carried = ["n_obs", "t1", "centro", "escala"]
    stacked = rows.withColumn("usable", usable).select(
        *SERIES_KEYS, *carried, "t", "y0", _structs([regressors(d) for d in ds])
    )
    recent = F.when(F.col("t") > F.col("t1") - SEASON, F.struct((-F.col("t")).alias("k"), "w", "e"))
    # a lag that only some orders use may be missing on a row that others use: it counts as average
    sums = stacked.na.fill(0.0, TERMS).groupBy(*SERIES_KEYS, *carried, "d").agg(
        _gram(TERMS).alias("gram"),
        # the last season, newest first: all that a forecast starts from
        F.sort_array(F.collect_list(recent)).alias("recent"),
        F.max(F.when(F.col("t") == F.col("t1"), F.col("y0"))).alias("level"),
    )
    candidates = _structs([
        {
            "p": str(o.p), "_d": str(o.d), "q": str(o.q), "sazonal": str(o.seasonal).lower(),
            "use": f"array({', '.join(map(str, o.terms))})",
        } for o in grid
    ])
    tried = sums.select(*sums.columns, candidates).where(
        (F.col("d") == F.col("_d")) & (~F.col("sazonal") | (F.col("n_obs") >= SEASONAL_MIN_MONTHS))
    ).drop("_d")
    n, k = F.get("gram", F.lit(0)), F.size("use")
    tried = tried.where(n - k >= MIN_FREE_ROWS)
    own_lags = F.array(*[F.lit(v) for v in (0, 1, 2, SEASON)])
    solved = tried.withColumn("s", solve("gram", "use", own_lags))
    solved = solved.where((F.col("s.rank") == k) & (F.col("s.radius") < 1.0) & (F.col("s.rss") >= 0))

    def lag_array(first: int, second: int, seasonal: int) -> Column:
        picks = {1: first, 2: second, SEASON: seasonal}
        cells = [f"get(s.beta, {picks[j]})" if j in picks else "0D" for j in range(1, SEASON + 1)]
        return F.expr(f"array({', '.join(cells)})")

    rss = F.col("s.rss")
    return solved.select(
        *SERIES_KEYS, "n_obs", "t1", "centro", "escala", "p", "d", "q", "sazonal",
        n.cast("int").alias("n_linhas"),
        (rss / (n - k)).alias("sigma2"),
        # an exact fit, as of a flat series, is better than any other
        F.when(rss > 0, n * F.log(rss / n) + 2 * (k + 1)).otherwise(F.lit(float("-inf"))).alias("aic"),
        F.get("s.beta", F.lit(0)).alias("c"),
        lag_array(1, 2, 3).alias("phi"),
        lag_array(4, 5, 6).alias("theta"),
        # shocks and differences that a gap hides count as average
        F.expr(f"transform(sequence(0, {SEASON - 1}), j -> coalesce(get(recent, j).w, 0D))").alias("w"),
        F.expr(f"transform(sequence(0, {SEASON - 1}), j -> coalesce(get(recent, j).e, 0D))").alias("e"),
        "level",
    )


def fit_seasonal_ar(calendar: DataFrame, grid: list[Order] | None = None) -> DataFrame:
    """The order with the smallest AIC per series; simpler orders win ties."""
    fits = fit_candidates(calendar, grid)
    rest = [c for c in fits.columns if c not in SERIES_KEYS]
    rank = F.struct("aic", F.col("p") + F.col("q") + F.col("sazonal").cast("int"), "d")
    return fits.groupBy(*SERIES_KEYS).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(*SERIES_KEYS, "b.*")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _pushed(value: Column, history: Column) -> Column:
    return F.concat(F.array(value), F.slice(history, 1, SEASON - 1))


def forecast(
    fits: DataFrame, periods: int = vocab.FORECAST_MONTHS, alpha: float = vocab.FORECAST_ALPHA
) -> DataFrame:
    """Path of means with symmetric bounds, one row per series and future month.

    One fold per series: the recent values roll forward, while the weights of past
    shocks add up to the forecast variance.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    d = F.col("d")
    start = F.struct(
        F.col("w").alias("hw"), F.col("e").alias("he"),
        F.array(F.lit(1.0), *[F.lit(0.0)] * (SEASON - 1)).alias("hp"),
        F.col("level").alias("level"), F.lit(0.0).alias("psum"), F.lit(0.0).alias("var"),
        F.array().cast("array<struct<j:int,media:double,var:double>>").alias("out"),
    )

    def step(state: Column, j: Column) -> Column:
        w = F.col("c") + _dot(F.col("phi"), state["hw"]) + _dot(F.col("theta"), state["he"])
        level = F.when(d == 1, state["level"] + w).otherwise(w)
        psi = F.get(state["hp"], F.lit(0))
        psum = F.when(d == 1, state["psum"] + psi).otherwise(psi)
        var = state["var"] + F.col("sigma2") * psum * psum
        next_psi = _dot(F.col("phi"), state["hp"]) + F.coalesce(F.get(F.col("theta"), j - 1), F.lit(0.0))
        return F.struct(
            _pushed(w, state["hw"]).alias("hw"),
            _pushed(F.lit(0.0), state["he"]).alias("he"),
            _pushed(next_psi, state["hp"]).alias("hp"),
            level.alias("level"), psum.alias("psum"), var.alias("var"),
            F.concat(state["out"], F.array(F.struct(j.alias("j"), level.alias("media"), var.alias("var")))).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start, step, lambda s: s["out"])
    rows = fits.select(*SERIES_KEYS, "t1", "centro", "escala", F.inline(path))
    mean = F.col("centro") + F.col("escala") * F.col("media")
    half = F.lit(z) * F.col("escala") * F.sqrt("var")
    return rows.select(
        *SERIES_KEYS, (F.col("t1") + F.col("j")).alias("t"),
        mean.alias("salario_projetado"),
        (mean - half).alias("salario_projetado_low"), (mean + half).alias("salario_projetado_high"),
    )


def _group_label() -> Column:
    """Model label of (grupo_tipo, grupo_codigo)."""
    labels = [F.when(F.col("grupo_tipo") == d, dims.label(F.col("grupo_codigo"), d, "model")) for d in vocab.LABELS]
    return F.coalesce(*labels, F.lit("NA"))


def union_history_forecast(series: DataFrame, future: DataFrame) -> DataFrame:
    """Observed rows without a forecast, and future rows without an observation."""
    names = ["salario_projetado", "salario_projetado_low", "salario_projetado_high"]
    nothing = F.lit(None).cast("double")
    observed = series.select(
        *SERIES_KEYS, "t", F.col("media_salario").alias("salario_real"), *[nothing.alias(n) for n in names]
    )
    projected = future.select(*SERIES_KEYS, "t", nothing.alias("salario_real"), *names)
    return observed.unionByName(projected).select(
        *SERIES_KEYS[:3], "grupo_codigo", _group_label().alias("grupo_valor"),
        month_date(F.col("t")).alias("data"), "salario_real", *names,
    )


def project_groups(
    cube: DataFrame,
    scenarios=None,
    dimensions=None,
    quality: DataFrame | None = None,
    periods: int = vocab.FORECAST_MONTHS,
    alpha: float = vocab.FORECAST_ALPHA,
    grid: list[Order] | None = None,
    min_months: int = vocab.MIN_HISTORY_MONTHS,
    snap: int | None = None,
    with_status: bool = False,
):
    """History and forecast of every scenario x dimension x code; with their status rows as a second table where asked for.

    The series (one value per series and month) are checkpointed, so the cube is
    read once however often the steps after it look back.
    """
    series = checkpoint(salary_series(group_series(cube, scenarios, dimensions, snap), quality))
    fits = fit_seasonal_ar(calendar_complete(min_history(series, min_months)), grid)
    # as in a run that skips a failing series, history is stored along with its forecast only
    fits = checkpoint(fits) if with_status else fits
    future = forecast(fits, periods, alpha)
    rows = union_history_forecast(series.join(fits.select(*SERIES_KEYS), SERIES_KEYS, "left_semi"), future)
    return (rows, projection_status(series, fits, min_months)) if with_status else rows


def projection_status(series: DataFrame, fits: DataFrame, min_months: int = vocab.MIN_HISTORY_MONTHS) -> DataFrame:
    """What became of each series: fitted, too short, or without a usable model."""
    sizes = series.groupBy(*SERIES_KEYS).agg(F.count(F.lit(1)).alias("meses"))
    chosen = fits.select(*SERIES_KEYS, "p", "d", "q", "sazonal", "n_linhas", "aic")
    status = (
        F.when(F.col("meses") < min_months, "insufficient_history")
        .when(F.col("aic").isNull(), "no_model")
        .otherwise("ok")
    )
    return sizes.join(chosen, SERIES_KEYS, "left").withColumn("status", status)


def projection_lookup(projections: DataFrame, kind: str, value: str, group_type: str, groups: list[str]) -> DataFrame:
    """Stored series of some groups, named by code or by label, in month order."""
    return projections.where(
        (F.col("filtro_tipo") == kind) & (F.col("filtro_valor") == value) & (F.col("grupo_tipo") == group_type)
        & (F.col("grupo_codigo").isin(list(groups)) | F.col("grupo_valor").isin(list(groups)))
    ).orderBy("data")
