import pytest

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import means, repair

BASE = ["2023-05", "2023-06", "2023-07"]


@pytest.fixture(scope="module")
def cube(make_cube):
    def group(name, august, base, n=2, ages=60.0):
        rows = [{"data": m, "municipio": name, "soma_salario": float(v * n), "soma_idade": ages, "total_admissoes": n}
                for m, v in zip(BASE, base)]
        return rows + [{"data": "2023-08", "municipio": name, "soma_salario": float(august * n), "soma_idade": 99.0,
                        "total_admissoes": n}]

    return make_cube(
        group("high", 6000.0, [5000, 5000, 5000])            # above the limit only
        + group("prior", 1600.0, [1000, 1000, 1000])         # above factor x both
        + group("pooled", 1450.0, [1000, 800, 800])          # above factor x pooled mean only
        + group("fine", 1400.0, [1000, 1000, 1000])
        + group("empty", 0.0, [1000, 1000, 1000], n=0)
        + [{"data": "2023-08", "municipio": "alone", "soma_salario": 9000.0}]
        + [{"data": "2023-08", "municipio": None, "soma_salario": 9000.0},
           {"data": "2023-05", "municipio": None, "soma_salario": 100.0}]
    )


def month(cube, *names):
    return cube.where(cube.data.isin(list(names)))


def test_each_rule(cube):
    out = repair.repair_month(month(cube, "2023-08"), month(cube, *BASE), audit=True)
    got = {r["municipio"]: r for r in out.collect()}
    assert {k for k, r in got.items() if r["apply_fix"]} == {"high", "prior", "pooled", "alone", None}
    assert got["high"]["soma_salario"] == 10000.0 and got["high"]["soma_idade"] == 60.0
    assert got["prior"]["soma_salario"] == 2000.0
    assert got["pooled"]["soma_salario"] == pytest.approx(2 * 2600 / 3)
    assert got["fine"]["soma_salario"] == 2800.0 and got["fine"]["soma_idade"] == 99.0
    assert got["empty"]["soma_salario"] == 0.0
    assert got["alone"]["no_baseline"] and got["alone"]["soma_salario"] == 9000.0
    assert got[None]["soma_salario"] == 100.0  # null keys match each other


def test_strict_mode_and_counts(cube):
    target = month(cube, "2023-08")
    out = repair.repair_month(target, month(cube, *BASE), strict=True)
    assert out.columns == target.columns
    assert out.where("municipio = 'alone'").first()["soma_salario"] is None
    assert rows_of(out, "municipio", "total_admissoes") == rows_of(target, "municipio", "total_admissoes")


def test_coarse_keys_keep_the_disability(make_cube):
    d = vocab.DISABILITY
    cube = make_cube([
        {"data": "2023-05", d: "0", "soma_salario": 1000.0}, {"data": "2023-05", d: "1", "soma_salario": 3000.0},
        {"data": "2023-08", d: "0", "soma_salario": 9000.0}, {"data": "2023-08", d: "1", "soma_salario": 2500.0},
    ])
    out = repair.repair_month(month(cube, "2023-08"), month(cube, "2023-05"), keys=repair.COARSE_KEYS)
    assert rows_of(out, d, "soma_salario") == [("0", 2000.0), ("1", 2500.0)]


def test_sequence_uses_repaired_months(make_cube):
    cube = make_cube([{"data": m, "soma_salario": 1000.0} for m in BASE]
                     + [{"data": "2023-08", "soma_salario": 8000.0}, {"data": "2023-09", "soma_salario": 1600.0}])
    plan = {"2023-08": BASE, "2023-09": ["2023-06", "2023-07", "2023-08"]}
    fixed = repair.repair_months_in_sequence(cube, plan)
    whole = repair.apply_repairs(cube, fixed)
    assert rows_of(whole, "data", "soma_salario")[-2:] == [("2023-08", 1000.0), ("2023-09", 1000.0)]
    assert rows_of(means.monthly_mean(whole, ["2023-08"])) == [("2023-08", 1000.0)]
    # with the unrepaired August, September would have passed
    lone = repair.repair_month(month(cube, "2023-09"), month(cube, "2023-06", "2023-07", "2023-08"))
    assert lone.first()["soma_salario"] == 1600.0


def test_plans_of_a_long_sequence_stay_small(make_cube):
    months = [f"2023-{m:02d}" for m in range(1, 13)]
    cube = make_cube([{"data": m} for m in months])
    plan = {m: months[i:i + 3] for i, m in enumerate(months[3:11])}
    fixed = repair.repair_months_in_sequence(cube, plan)
    joins = [fixed[m]._jdf.queryExecution().analyzed().toString().count("Join ") for m in plan]
    assert max(joins) <= 3
