import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import regression as reg


def t_two_sided(t, df):
    """Two-sided p-value by integrating the density."""
    x = np.linspace(-abs(t), abs(t), 200_001)
    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    density = np.exp(c - (df + 1) / 2 * np.log1p(x * x / df))
    return 1 - float(np.sum((density[1:] + density[:-1]) / 2 * np.diff(x)))


def plain_ols(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    df = len(y) - x.shape[1]
    s2 = float(((y - x @ b) ** 2).sum() / df)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
    return b, se, [t_two_sided(t, df) for t in b / se]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(120):
        sex, race, age = rng.choice(["MASC", "FEM", "na"]), rng.choice(["1", "2", "10"]), float(rng.uniform(18, 60))
        pay = math.exp(7 + 0.2 * (sex == "MASC") - 0.1 * (race == "2") + 0.01 * age + rng.normal(0, 0.2))
        rows.append((str(sex), str(race), "one", age, pay, float(rng.integers(1, 9))))
    return rows, spark.createDataFrame(
        rows, "genero_nome string, raca_cor string, so string, idade_media double, salario_medio double, n double")


def design(rows):
    x = np.array([[1.0, s == "MASC", s == "na", r == "10", r == "2", a] for s, r, _, a, _, _ in rows], dtype=float)
    return x, np.log([r[4] for r in rows])


NAMES = ["const", "genero_nome_MASC", "genero_nome_NA", "raca_cor_10", "raca_cor_2", "idade_media"]


def test_ols_matches_plain_least_squares(sample):
    rows, df = sample
    b, se, p = plain_ols(*design(rows))
    out = reg.ols(df, categories=["genero_nome", "raca_cor", "so"], details=True).orderBy("ordem").collect()
    assert [r["variavel"] for r in out] == NAMES
    assert [r["coeficiente"] for r in out] == pytest.approx(list(b), rel=1e-8)
    assert [r["erro_padrao"] for r in out] == pytest.approx(list(se), rel=1e-7)
    assert [r["p_valor"] for r in out] == pytest.approx(p, abs=1e-8)
    assert [r["base"] for r in out] == [None, "FEM", "FEM", "1", "1", None]


def test_weighted_fit(sample):
    rows, df = sample
    x, y = design(rows)
    w = np.sqrt([r[5] for r in rows])
    b, *_ = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)
    out = reg.ols(df, categories=["genero_nome", "raca_cor"], weight_col="n").collect()
    assert [r["coeficiente"] for r in out] == pytest.approx(list(b), rel=1e-7)


def test_aliased_terms_are_null_and_the_rest_unchanged(sample):
    rows, df = sample
    twin = df.withColumn("z_copia", F.col("genero_nome")).withColumn("constante", F.lit(3.0)).withColumn(
        "dobro", F.col("idade_media") * 2)
    out = {r["variavel"]: r for r in reg.ols(
        twin, categories=["genero_nome", "raca_cor", "z_copia"], numbers=["idade_media", "constante", "dobro"]
    ).collect()}
    b, _, p = plain_ols(*design(rows))
    for name, coef, pv in zip(NAMES, b, p):
        assert out[name]["coeficiente"] == pytest.approx(coef, rel=1e-7) and out[name]["p_valor"] == pytest.approx(pv, abs=1e-7)
    for name in ("z_copia_MASC", "z_copia_NA", "constante", "dobro"):
        assert out[name]["coeficiente"] is None and out[name]["p_valor"] is None


def test_null_categories_and_ages(spark):
    rows = [("a", 30.0, 10.0), (None, None, 12.0), ("a", 31.0, 10.5), (None, 20.0, 13.0), ("a", 29.0, 9.0), ("b", 2.0, 9.5),
            ("b", 1.0, 8.0)]
    df = spark.createDataFrame(rows, "c string, idade_media double, salario_medio double")
    out = reg.ols(df, categories=["c"])
    assert out.columns == reg.COEFFICIENT_COLUMNS
    assert [r[0] for r in out.collect()] == ["const", "c_B", "c_NONE", "idade_media"]


def test_groups_relabel_after_grouping(make_cube):
    cube = make_cube([
        {"raca_cor": "9", "soma_salario": 100.0}, {"raca_cor": "7", "soma_salario": 300.0},
        {"raca_cor": "nan", "soma_salario": 500.0}, {"genero": "9", "municipio": "99"}, {"total_admissoes": 0},
    ])
    kept = reg.regression_groups(cube)
    assert rows_of(kept.where("genero_nome = 'MASC'"), "raca_cor", "salario_medio") == [
        ("9", 100.0), ("9", 300.0), ("9", 500.0)]
    assert rows_of(kept.where("genero_nome = 'NA'"), "regiao") == [("NA",)]
    merged = reg.regression_groups(cube, regroup=True).where("genero_nome = 'MASC'")
    assert rows_of(merged, "raca_cor", "salario_medio") == [("9", 300.0)]


def test_effect_table(spark):
    coefs = spark.createDataFrame(
        [("const", 7.0, 0.0), ("raca_cor_2", -0.123456, 0.04999), ("raca_cor_3", 0.05, 0.05), ("raca_cor_1", 9.9, 0.0)],
        "variavel string, coeficiente double, p_valor double")
    got = {r["categoria"]: r for r in reg.effect_table(coefs, "raca_cor").collect()}
    assert got["Branca"]["impacto_pct"] == 0.0 and got["Branca"]["p_valor"] is None and got["Branca"]["base"]
    assert got["Preta"]["impacto_pct"] == -12.35 and got["Preta"]["p_valor"] == 0.05
    assert got["Amarela"]["impacto_pct"] == 0.0 and not got["Amarela"]["significativo"]
    assert got["Preta"]["impacto_exato_pct"] == pytest.approx((math.exp(-0.123456) - 1) * 100, abs=0.005)
    assert reg.effect_table(coefs, "raca_cor").first()["categoria"] == "Preta"
    assert set(vocab.REGRESSION_COLUMNS) == set(vocab.LABELS)
    genders = {r["codigo"]: r["base"] for r in reg.effect_table(coefs, "genero").collect()}
    assert genders == {"FEM": True, "MASC": False}


@pytest.mark.parametrize("weight", [None, "n"])
def test_constant_alone_where_no_term_can_be_fitted(sample, weight):
    rows, df = sample
    got = reg.ols(df, categories=["so"], numbers=[], weight_col=weight, details=True).collect()
    y, w = np.log([r[4] for r in rows]), np.array([r[5] if weight else 1.0 for r in rows])
    mean = float((w * y).sum() / w.sum())
    error = math.sqrt(float((w * (y - mean) ** 2).sum()) / (len(y) - 1) / w.sum())
    assert [r["variavel"] for r in got] == ["const"]
    assert (got[0]["coeficiente"], got[0]["erro_padrao"], got[0]["t_valor"]) == pytest.approx((mean, error, mean / error))
    assert got[0]["p_valor"] == pytest.approx(0.0, abs=1e-12)
