import json

from conftest import rows_of
from hirecube.plans import jobs
from hirecube.sources import tables
from hirecube.streaming.ingest import CubeStore, ingest_new_months
from test_raw import line, write


def test_ingest_with_and_without_clean_data(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    write(landing, "MOV202105.txt", [line(), line(city="", dis=""), line(kind="31")], "cp1252")
    write(landing, "MOV202106.txt", [line(month="202106", pay="100,00")])
    cubes = []
    for name, clean in (("direct", None), ("staged", str(tmp_path / "clean"))):
        jobs.ingest(spark, str(landing), str(tmp_path / name), clean)
        cubes.append(rows_of(tables.read_cube(spark, str(tmp_path / name))))
    assert cubes[0] == cubes[1] and len(cubes[0]) == 3
    jobs.ingest(spark, str(landing), str(tmp_path / "one"), months=["202106"])
    assert tables.read_cube(spark, str(tmp_path / "one")).count() == 1


def test_ingest_lists_rejected_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    write(landing, "MOV202105.txt", [line(), line(kind="31")], "cp1252")
    (landing / "MOV202106.txt").write_text("a;b\n1;2\n")
    audit = str(tmp_path / "audit")
    jobs.ingest(spark, str(landing), str(tmp_path / "cube"), audit_path=audit)
    batches = ingest_new_months(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "progress"))
    assert batches.exception() is None
    for found in (spark.read.parquet(audit), CubeStore(spark, str(tmp_path / "store")).audit()):
        got = {r["arquivo"][-10:]: (r["accepted"], r["motivo"], r["linhas"], r["no_cubo"]) for r in found.collect()}
        assert got == {"202105.txt": (True, None, 2, 1), "202106.txt": (False, "header not recognised", None, None)}


def cube_of(make_cube, months=26):
    rows = []
    for i in range(months):
        for sex, race, pay in (("1", "1", 2000.0), ("3", "2", 1800.0), ("1", "2", 1900.0)):
            rows.append({
                "data": f"{2020 + i // 12}-{i % 12 + 1:02d}", "genero": sex, "raca_cor": race,
                "soma_salario": pay + 7 * i + (i * 37 % 11) * 5, "soma_idade": 30.0 + i % 5,
                "cnae20subclasse": f"{10 + i % 7}00",
            })
    return make_cube(rows)


def test_models_are_stored_and_a_failing_stage_is_reported(spark, tmp_path, make_cube):
    cube = cube_of(make_cube)
    root = str(tmp_path / "models")
    assert jobs.fit_models(spark, cube, root, periods=6) == {"coefficients": "ok", "projections": "ok"}
    stored = tables.VersionedTable(spark, f"{root}/projecoes_salariais")
    n = stored.read().count()
    jobs.fit_models(spark, cube, root, periods=6)
    assert stored.read().count() == n and stored.read().where("salario_projetado is not null").count() > 0
    assert "const" in [r[0] for r in tables.VersionedTable(spark, f"{root}/coeficientes_regressao").read().collect()]
    outcome = jobs.fit_models(spark, cube.limit(0), str(tmp_path / "none"))
    assert outcome["coefficients"].startswith("failed") and outcome["projections"] == "ok"


def test_dashboard_and_charts(spark, tmp_path, make_cube):
    cube = cube_of(make_cube, 3)
    frames = jobs.dashboard(cube, "2020-01", "2020-02")
    assert frames["kpis"].first()["total_admissoes"] == 6 and frames["by_gender"].count() == 4
    jobs.write_charts(cube, str(tmp_path / "viz"))
    read = {n: json.loads(spark.read.text(str(tmp_path / "viz" / n)).first()[0])
            for n in ("genero", "raca", "deficiencia", "escolaridade")}
    assert [s["name"] for s in read["genero"]["series"]] == ["Homens", "Mulheres"]
    assert len(read["deficiencia"]["series"]) == 8
    assert read["deficiencia"]["series"][1]["data"] == [None] * 3
    assert read["escolaridade"]["series"] == [
        {"type": "column", "name": "Superior completo", "data": [3, 3, 3], "color": "#4e79a7"}]
    assert read["raca"]["series"][0]["color"] == "#4e79a7"


def test_stored_cube_repair(spark, tmp_path, make_cube):
    table = tables.VersionedTable(spark, str(tmp_path / "cube"))
    table.write(make_cube([{"data": m} for m in ("2023-05", "2023-06")] + [{"data": "2023-08", "soma_salario": 9000.0}]), "data")
    report = jobs.repair_cube(table, {"2023-08": ["2023-05", "2023-06"]})
    assert rows_of(table.read(schema=tables.CUBE_SCHEMA), "data", "soma_salario")[-1] == ("2023-08", 1000.0)
    assert rows_of(report) == [("2023-08", 9000.0, 1000.0)]
