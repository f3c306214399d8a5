import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import history, means, reshape

D = vocab.DISABILITY


@pytest.fixture(scope="module")
def cube(make_cube):
    return make_cube([
        {"data": "2024-12", "genero": "1", "soma_salario": 3000.0, "total_admissoes": 2},
        {"data": "2025-01", "genero": "1", "soma_salario": 4000.0, "total_admissoes": 2},
        {"data": "2025-01", "genero": "3", "soma_salario": 1500.0, "raca_cor": "2", "grau_instrucao": "10"},
        {"data": "2025-03", "genero": "9", "soma_salario": 700.0, "raca_cor": "7", "grau_instrucao": "99", D: "9"},
        {"data": "2025-03", "genero": "3", "soma_salario": 0.0, "total_admissoes": 0},
    ])


def test_weighted_mean_is_exact(cube):
    assert rows_of(means.weighted_mean(cube, ["genero"])) == [("1", 1750.0), ("3", 1500.0), ("9", 700.0)]
    assert means.overall_mean(cube).first()[0] == pytest.approx(9200 / 6)
    assert rows_of(means.monthly_mean(cube, ["2025-01"])) == [("2025-01", pytest.approx(5500 / 3))]


def test_mean_of_nothing_is_null(cube):
    assert means.overall_mean(cube.where("total_admissoes = 0")).first()[0] is None


def test_gender_gap(cube):
    got = {r["periodo"]: r for r in means.gender_gap(cube, 2025).collect()}
    assert got["2025"]["hiato_pct"] == pytest.approx(75.0) and got["2025"]["gap_pct"] == pytest.approx(25.0)
    assert got["geral"]["masc"] == 1750.0
    assert means.gender_gap(cube.where("genero = '1'")).first()["hiato_pct"] is None


def test_ratio_to_reference(cube):
    got = {r["raca_cor"]: r for r in means.ratio_to_reference(cube).collect()}
    assert set(got) == {"1", "2"} and got["1"]["razao_pct"] == 100.0
    assert got["2"]["razao_pct"] == pytest.approx(1500 / 1750 * 100) and got["2"]["nome"] == "Preta"
    assert means.ratio_to_reference(cube.where("raca_cor <> '1'")).count() == 0


def test_composition_shares_sum_to_100(cube):
    got = means.composition(cube).collect()
    assert [r["grau_instrucao"] for r in got] == ["7", "10"]
    assert sum(r["participacao_pct"] for r in got) == pytest.approx(100.0)


def test_five_number_interpolates(make_cube):
    rows = [{"data": f"2025-0{m}", "soma_salario": 100.0 * m} for m in range(1, 5)]
    got = means.five_number(make_cube(rows + [{"data": "2025-01", D: "9"}]), 2025).collect()
    assert [tuple(r) for r in got] == [("0", 100.0, 175.0, 250.0, 325.0, 400.0)]


def test_data_bounds(cube):
    assert tuple(means.data_bounds(cube).first()) == ("2024-12", "2025-03")
    assert tuple(means.data_bounds(cube.limit(0)).first()) == vocab.FALLBACK_BOUNDS


def test_pivot_keeps_months_without_the_codes(cube):
    got = {r["data"]: (r["1"], r["3"]) for r in reshape.pivot_mean(cube, "genero", ["1", "3"]).collect()}
    assert got == {"2024-12": (1500.0, None), "2025-01": (2000.0, 1500.0), "2025-03": (None, None)}


def test_grid_skips_unobserved_months_and_fills_zero(cube):
    counts = reshape.counts_by_month(cube)
    got = rows_of(reshape.month_category_grid(counts))
    assert got == [("2024-12", "10", 0), ("2024-12", "7", 2), ("2025-01", "10", 1), ("2025-01", "7", 2)]
    shares = {r[0]: r[1] for r in reshape.percent_stack(counts).groupBy("data").agg(F.sum("participacao_pct")).collect()}
    assert shares == {"2024-12": pytest.approx(100.0), "2025-01": pytest.approx(100.0)}


def test_series_arrays_align_and_drop_absent(cube):
    by_month = means.weighted_mean(cube.where("total_admissoes > 0"), ["data", "genero"])
    got = {r["nome"]: r["valores"] for r in reshape.series_arrays(by_month, "genero", ["1", "3"]).collect()}
    assert got == {"Homens": [1500.0, 2000.0, None], "Mulheres": [None, 1500.0, None]}
    men = by_month.where("genero = '1'")
    assert reshape.series_arrays(men, "genero", ["1", "3"]).count() == 1
    kept = reshape.series_arrays(men, "genero", ["1", "3"], keep_absent=True).where("ordem = 1").first()
    assert kept["valores"] == [None, None]


def test_history_and_kpis(cube):
    hist = history.history(cube, "2025-01", "2025-12")
    assert hist.count() == 3 and set(r["raca_nome"] for r in hist.collect()) == {"Branca", "Preta", "Outro"}
    k = history.kpis(hist).first()
    assert (k["total_admissoes"], k["hiato_pct"], k["salario_medio_geral"]) == (4, 75.0, 1550.0)
    assert history.kpis(hist.where("genero = '1'")).first()["hiato_pct"] is None


def test_admissions_by_all_matches_single_queries(cube):
    hist = history.history(cube, "2024-01", "2025-12")
    together = history.admissions_by_all(hist)
    for dim in ("genero_nome", "raca_nome", "grau_instrucao", D):
        one = rows_of(history.admissions_by(hist, dim))
        assert rows_of(together.where(F.col("dimensao") == dim), "data", "categoria", "total_admissoes") == one
