import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from hirecube.operators import forecast as fc
from hirecube.operators import series as ts

SCHEMA = "filtro_tipo string, filtro_valor string, grupo_tipo string, grupo_codigo string, data string, t int, media_salario double"
START = 2015 * 12


def frame(spark, named):
    """Series by code; None leaves a month out."""
    rows = []
    for code, values in named.items():
        for i, v in enumerate(values):
            if v is not None:
                t = START + i
                rows.append(("geral", "brasil", "genero", code, f"{t // 12:04d}-{t % 12 + 1:02d}", t, float(v)))
    return spark.createDataFrame(rows, SCHEMA)


def simulate(n, seed=3, trend=0.0, season=0.0, phi=0.6):
    rng = np.random.default_rng(seed)
    y, e = np.zeros(n + 50), rng.normal(0, 20, n + 50)
    for t in range(1, n + 50):
        y[t] = phi * y[t - 1] + e[t]
    i = np.arange(n)
    return 2000 + trend * i + season * np.sin(2 * np.pi * i / 12) + y[50:]


def brute_force(values, order):
    """The documented estimator for one series without gaps, in plain numpy, on standardised values."""
    y = (np.asarray(values) - np.mean(values)) / np.std(values)
    n = len(y)
    h = min(13, n // 4)
    seasonal_ok = n >= 48

    def residuals(w, offset):
        e = np.full(n, np.nan)
        rows = [t for t in range(n) if t - h >= offset]
        x = np.array([[1.0, *[w[t - k] for k in range(1, h + 1)]] for t in rows])
        b, *_ = np.linalg.lstsq(x, w[rows], rcond=None)
        e[rows] = w[rows] - x @ b
        return e

    first = h + 1 + (12 if seasonal_ok else 2)
    w = y if order.d == 0 else np.concatenate([[np.nan], np.diff(y)])
    e = residuals(w, order.d)
    rows = list(range(first, n))
    lags_w = [1, 2][: order.p] + ([12] if order.seasonal else [])
    lags_e = [1, 2][: order.q] + ([12] if order.seasonal else [])
    x = np.array([[1.0, *[w[t - k] for k in lags_w], *[e[t - k] for k in lags_e]] for t in rows])
    b, *_ = np.linalg.lstsq(x, w[rows], rcond=None)
    rss = float(((w[rows] - x @ b) ** 2).sum())
    m, k = len(rows), x.shape[1]
    phi, theta = np.zeros(12), np.zeros(12)
    for lag, v in zip(lags_w, b[1: 1 + len(lags_w)]):
        phi[lag - 1] = v
    for lag, v in zip(lags_e, b[1 + len(lags_w):]):
        theta[lag - 1] = v
    return dict(c=b[0], phi=phi, theta=theta, sigma2=rss / (m - k), aic=m * np.log(rss / m) + 2 * (k + 1), n=m, w=w, e=e, y=y)


def brute_path(fit, d, steps, scale, centre):
    w, e = list(fit["w"]), list(fit["e"])
    level, psi, out = fit["y"][-1], [1.0], []
    for _ in range(steps):
        nxt = fit["c"] + sum(fit["phi"][j] * w[-1 - j] + fit["theta"][j] * e[-1 - j] for j in range(12))
        w.append(nxt), e.append(0.0)
        level = level + nxt if d else nxt
        out.append(level)
    for j in range(1, steps):
        psi.append(sum(fit["phi"][i] * psi[j - 1 - i] for i in range(12) if j - 1 - i >= 0) + (fit["theta"][j - 1] if j <= 12 else 0))
    weights = np.cumsum(psi) if d else np.array(psi)
    half = 1.959963984540054 * np.sqrt(fit["sigma2"] * np.cumsum(weights**2)) * scale
    return centre + scale * np.array(out), half


@pytest.fixture(scope="module")
def cases():
    return {"1": simulate(80, 1, trend=3, season=60), "3": simulate(30, 2)}


def test_every_candidate_matches_brute_force(spark, cases):
    fits = fc.fit_candidates(ts.calendar_complete(frame(spark, cases))).collect()
    assert {r["grupo_codigo"] for r in fits} == {"1", "3"}
    assert not [r for r in fits if r["grupo_codigo"] == "3" and r["sazonal"]]  # 30 months are too few
    assert len([r for r in fits if r["grupo_codigo"] == "1"]) > 20
    for r in fits:
        want = brute_force(cases[r["grupo_codigo"]], fc.Order(r["p"], r["d"], r["q"], r["sazonal"]))
        assert r["n_linhas"] == want["n"]
        assert r["aic"] == pytest.approx(want["aic"], abs=1e-6)
        assert r["phi"] == pytest.approx(list(want["phi"]), abs=1e-6)
        assert r["theta"] == pytest.approx(list(want["theta"]), abs=1e-6)
        assert r["sigma2"] == pytest.approx(want["sigma2"], rel=1e-6)


@pytest.mark.parametrize("order", [fc.Order(1, 0, 0, False), fc.Order(2, 1, 1, True), fc.Order(0, 1, 2, False)])
def test_forecast_matches_brute_force(spark, cases, order):
    # the other order keeps the common rows of the full grid
    cal = ts.calendar_complete(frame(spark, {"1": cases["1"]}))
    fits = fc.fit_candidates(cal).where(
        (F.col("p") == order.p) & (F.col("d") == order.d) & (F.col("q") == order.q) & (F.col("sazonal") == order.seasonal))
    got = fc.forecast(fits, 60).orderBy("t").collect()
    assert len(got) == 60 and got[0]["t"] == START + 80
    mean, half = brute_path(brute_force(cases["1"], order), order.d, 60, np.std(cases["1"]), np.mean(cases["1"]))
    assert [r["salario_projetado"] for r in got] == pytest.approx(list(mean), rel=1e-7)
    assert [r["salario_projetado_high"] - r["salario_projetado"] for r in got] == pytest.approx(list(half), rel=1e-6)
    assert all(b >= a - 1e-9 for a, b in zip(half, half[1:]))


def test_selection_recovers_known_processes(spark):
    long = {"1": simulate(400, 11, phi=0.7), "3": np.cumsum(np.random.default_rng(5).normal(1, 10, 400)) + 3000}
    best = {r["grupo_codigo"]: r for r in fc.fit_seasonal_ar(ts.calendar_complete(frame(spark, long))).collect()}
    assert best["1"]["d"] == 0 and np.sqrt(best["1"]["sigma2"]) * best["1"]["escala"] == pytest.approx(20, rel=0.15)
    assert np.sqrt(best["3"]["sigma2"]) * best["3"]["escala"] == pytest.approx(10, rel=0.15)
    ar1 = fc.fit_candidates(ts.calendar_complete(frame(spark, long)), [fc.Order(1, 0, 0, False)])
    assert ar1.where("grupo_codigo = '1'").first()["phi"][0] == pytest.approx(0.7, abs=0.1)


def test_gaps_keep_calendar_lags(spark):
    values = list(simulate(60, 4))
    values[20] = None
    cal = ts.calendar_complete(frame(spark, {"1": values}))
    assert cal.count() == 60 and cal.where("media_salario is null").count() == 1
    fit = fc.fit_candidates(cal, [fc.Order(1, 0, 0, False)]).first()
    pairs = [(a, b) for a, b in zip(values, values[1:]) if a is not None and b is not None]
    x, y = np.array(pairs).T
    assert fit["n_linhas"] == len(pairs)
    assert fit["phi"][0] == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-7)
    assert fc.forecast(fc.fit_seasonal_ar(cal), 3).count() == 3


def test_flat_series_does_not_stop_the_others(spark):
    data = frame(spark, {"1": [1000.0] * 30, "3": simulate(30, 9)})
    fits = fc.fit_seasonal_ar(ts.calendar_complete(data))
    short = frame(spark, {"9": [1.0] * 5})
    status = {r["grupo_codigo"]: r["status"] for r in fc.projection_status(data.unionByName(short), fits).collect()}
    assert status == {"1": "ok", "3": "ok", "9": "insufficient_history"}


def test_min_history(spark):
    data = frame(spark, {"1": [1.0] * 23, "3": [1.0] * 24})
    assert rows_of(ts.min_history(data).select("grupo_codigo").distinct()) == [("3",)]


def test_group_series_scenarios(make_cube):
    cube = make_cube([
        {"municipio": "350001", "raca_cor": "1"}, {"municipio": "430001", "raca_cor": "6", "cnae20subclasse": "0111"},
    ])
    got = ts.group_series(cube, [("geral", "brasil"), ("municipio", "*"), ("regiao", "SUL"), ("cnae", "47")], ["genero", "raca_cor"])
    assert {(r[0], r[1], r[2], r["total_admissoes_total"]) for r in got.collect()} == {
        ("geral", "brasil", "genero", 2), ("geral", "brasil", "raca_cor", 1),
        ("municipio", "350001", "genero", 1), ("municipio", "350001", "raca_cor", 1), ("municipio", "430001", "genero", 1),
        ("regiao", "SUL", "genero", 1), ("cnae", "47", "genero", 1), ("cnae", "47", "raca_cor", 1),
    }


def test_series_fold_by_scenario_not_by_place(make_cube):
    cube = make_cube([{"municipio": "130000"}])
    out = ts.group_series(cube, [("geral", "brasil"), ("municipio", "130000"), ("cnae", "4")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    keys = plan.split("Aggregate [")[2].split("]")[0]
    assert "_cenarios" in keys and "municipio" not in keys and "cnae20subclasse" not in keys


def test_project_groups_end_to_end(spark, make_cube):
    values = simulate(30, 8)
    rows = [{"data": f"{2020 + i // 12}-{i % 12 + 1:02d}", "soma_salario": float(v) * 10, "total_admissoes": 10}
            for i, v in enumerate(values)]
    weights = spark.createDataFrame([("2020-01", 0.1)], "mes string, peso_qualidade double")
    out = fc.project_groups(make_cube(rows), dimensions=["genero"], quality=weights, periods=6)
    got = out.orderBy("data").collect()
    assert len(got) == 29 + 6 and {r["grupo_valor"] for r in got} == {"MASC"}
    assert str(got[0]["data"]) == "2020-02-01" and str(got[-1]["data"]) == "2022-12-01"
    assert got[-1]["salario_real"] is None and got[0]["salario_projetado"] is None
    assert got[-1]["salario_projetado_low"] < got[-1]["salario_projetado"] < got[-1]["salario_projetado_high"]
    for name in ("1", "MASC"):
        assert fc.projection_lookup(out, "geral", "brasil", "genero", [name]).count() == 35
    assert fc.projection_lookup(out, "geral", "brasil", "genero", []).count() == 0


def test_flat_series_gets_its_exact_forecast(spark):
    flat = frame(spark, {"1": np.full(36, 1500.0), "3": simulate(36, 2)})
    fits = fc.fit_seasonal_ar(ts.calendar_complete(flat))
    assert {r["grupo_codigo"] for r in fits.collect()} == {"1", "3"}
    out = [r.asDict() for r in fc.forecast(fits.where("grupo_codigo = '1'"), 12).collect()]
    assert len(out) == 12
    numbers = [v for r in out for k, v in r.items() if isinstance(v, float)]
    assert numbers and all(v == pytest.approx(1500.0) for v in numbers)
