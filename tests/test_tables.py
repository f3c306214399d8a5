import pytest

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import clean as cl
from hirecube.operators import cube as cubes
from hirecube.sources import charts, tables

D = vocab.DISABILITY


def clean_rows(spark, *months):
    rows = [(m, "355030", "47", "52", "07", 31, "3", "1", 1850.4, "20", "1", "0") for m in months]
    return spark.createDataFrame(rows, tables.CLEAN_SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_clean_round_trip_replaces_only_its_months(spark, tmp_path, fmt):
    path = str(tmp_path / "clean")
    tables.write_clean(clean_rows(spark, "202105", "202106", "202106"), path, fmt)
    tables.write_clean(clean_rows(spark, "202106"), path, fmt)
    got = tables.read_clean(spark, path, fmt)
    assert rows_of(got, "competencia_mov", "grau_instrucao", "salario", "idade", D) == [
        ("202105", "07", 1850.4, 31, "0"), ("202106", "07", 1850.4, 31, "0")]
    assert tables.read_clean(spark, path, fmt, months=["202105"]).count() == 1


def test_clean_csv_skips_long_lines_and_pads_short_ones(spark, tmp_path):
    head = "competencia_mov,municipio,cnae20subclasse,grau_instrucao,genero,raca_cor,salario,idade,Deficiencia"
    (tmp_path / "c.csv").write_text("\n".join([
        head, "202105,1,47,7,1,3,100.5,31,1.0", "202105,2,47,7,1,3,100.5,31,0,surplus", "202105,3,47,7,1,3,100.5",
    ]) + "\n")
    got = tables.read_clean(spark, str(tmp_path), "csv")
    assert rows_of(got, "municipio", "salario", "idade", D) == [("1", 100.5, 31, "1"), ("3", 100.5, None, None)]


def test_cube_is_partitioned_and_pruned(spark, tmp_path, make_cube):
    path = str(tmp_path / "cube")
    tables.write_cube(make_cube([{"data": "2023-01"}, {"data": "2023-02", "soma_salario": 5.0}]), path)
    cube = tables.read_cube(spark, path)
    assert cube.columns == [*vocab.CUBE_KEYS, *vocab.CUBE_MEASURES] or set(cube.columns) == set(
        [*vocab.CUBE_KEYS, *vocab.CUBE_MEASURES])
    plan = cube.where("data = '2023-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data" in plan
    tables.write_cube(make_cube([{"data": "2023-02", "soma_salario": 7.0}]), path, dynamic=True)
    assert rows_of(tables.read_cube(spark, path), "data", "soma_salario") == [("2023-01", 1000.0), ("2023-02", 7.0)]


def test_empty_cube_round_trip(spark, tmp_path):
    path = str(tmp_path / "cube")
    cubes.empty_cube(spark).write.parquet(path)
    assert tables.read_cube(spark, path).count() == 0


def test_versions_restore_and_replace(spark, tmp_path, make_cube):
    table = tables.VersionedTable(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(make_cube([{"data": "2023-01"}, {"data": "2023-02"}]), "data")
    table.replace_months(make_cube([{"data": "2023-02", "soma_salario": 9.0}]), ["2023-02"])
    read = lambda: rows_of(table.read(schema=cubes.CUBE_SCHEMA), "data", "soma_salario")
    assert read() == [("2023-01", 1000.0), ("2023-02", 9.0)]
    table.restore(1)
    assert read() == [("2023-01", 1000.0), ("2023-02", 1000.0)] and len(table.versions()) == 3


def test_failed_write_leaves_the_old_version(spark, tmp_path, make_cube):
    table = tables.VersionedTable(spark, str(tmp_path / "v"))
    table.write(make_cube([{"data": "2023-01"}]), "data")
    broken = make_cube([{"data": "2023-02"}]).selectExpr("*", "cast(raise_error('lost') as string) AS x")
    with pytest.raises(Exception):
        table.write(broken, "data")
    assert rows_of(table.read(), "data") == [("2023-01",)]


def test_upsert(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "u"))
    schema = "k string, v int"
    table.upsert(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), ["k"])
    table.upsert(spark.createDataFrame([("a", 9), ("c", 4)], schema), ["k"])
    assert rows_of(table.read()) == [("a", 9), ("b", 3), ("c", 4)]


def test_quality_file_is_optional(spark, tmp_path):
    assert tables.read_quality(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "q.csv").write_text("mes;peso_qualidade;x\n2023-01;0.5;1\n2023-02;;1\n")
    assert rows_of(tables.read_quality(spark, str(tmp_path / "q.csv"))) == [("2023-01", 0.5), ("2023-02", None)]


def test_result_tables(spark):
    tables.ensure_result_tables(spark, "t_")
    assert spark.table("t_projecoes_salariais").count() == 0
    assert spark.table("t_coeficientes_regressao").columns == ["variavel", "coeficiente", "p_valor"]
    tables.publish_table(spark.createDataFrame([("const", 1.0, 0.5)], tables.COEFFICIENT_SCHEMA), "t_coeficientes_regressao")
    assert spark.table("t_coeficientes_regressao").count() == 1
    for name in ("t_projecoes_salariais", "t_coeficientes_regressao"):
        spark.sql(f"DROP TABLE {name}")


def test_payload_is_valid_json(spark, tmp_path):
    import json

    series = spark.createDataFrame(
        [(1, "Preta", ["2023-01", "2023-02"], [float("nan"), 2.5]), (0, "Branca", ["2023-01", "2023-02"], [1.0, None])],
        "ordem int, nome string, meses array<string>, valores array<double>")
    payload = charts.chart_payload(series, "Título", "s", "R$", palette=["#a", "#b"], series_type="column",
                                   chart={"seriesType": "column", "grouping": False})
    charts.write_payload(payload, str(tmp_path / "chart"))
    text = spark.read.text(str(tmp_path / "chart")).first()[0]
    assert json.loads(text) == {
        "title": "Título", "subtitle": "s", "yAxisTitle": "R$", "categories": ["2023-01", "2023-02"],
        "series": [{"type": "column", "name": "Branca", "data": [1.0, None], "color": "#a"},
                   {"type": "column", "name": "Preta", "data": [None, 2.5], "color": "#b"}],
        "chart": {"seriesType": "column", "grouping": False},
    }
    empty = json.loads(charts.chart_payload(series.limit(0), "t", "s", "y").first()[0])
    assert empty["categories"] == [] and empty["series"] == []


def test_output_names_cover_clean_schema(spark):
    assert clean_rows(spark).columns == list(cl.OUTPUT_NAMES.values())


def _files(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet") if "/store/" in str(p)}


def test_replacing_a_month_writes_only_its_folders(spark, tmp_path, make_cube):
    table = tables.VersionedTable(spark, str(tmp_path / "m"))
    table.write(make_cube([{"data": m} for m in ("2023-01", "2023-02", "2023-03")]), "data")
    before = _files(tmp_path / "m")
    table.replace_months(make_cube([{"data": "2023-02", "soma_salario": 5.0}]), ["2023-02"])
    added = _files(tmp_path / "m") - before
    assert before <= _files(tmp_path / "m") and added and all("data=2023-02/" in f for f in added)
    read = lambda v=None: rows_of(table.read(v, schema=cubes.CUBE_SCHEMA), "data", "soma_salario")
    assert read() == [("2023-01", 1000.0), ("2023-02", 5.0), ("2023-03", 1000.0)]
    assert read(1) == [("2023-01", 1000.0), ("2023-02", 1000.0), ("2023-03", 1000.0)]
    assert [v for v, _ in table.manifest()] == ["2023-01", "2023-02", "2023-03"]
    gone = table.collect_unused(keep=1)
    assert len(gone) == 1 and gone[0].startswith("data=2023-02/lote=w000001")
    assert read() == [("2023-01", 1000.0), ("2023-02", 5.0), ("2023-03", 1000.0)]


def test_upsert_rewrites_only_the_values_it_holds(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "p"))
    schema = "k string, v int, part string"
    table.write(spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y")], schema), "part")
    before = _files(tmp_path / "p")
    table.upsert(spark.createDataFrame([("a", 9, "x"), ("d", 4, "x")], schema), ["part", "k"])
    added = _files(tmp_path / "p") - before
    assert added and all("part=x/" in f for f in added)
    assert rows_of(table.read(), "k", "v", "part") == [("a", 9, "x"), ("b", 2, "x"), ("c", 3, "y"), ("d", 4, "x")]
    assert rows_of(table.read(1), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]


def test_empty_partitioned_version_keeps_its_schema(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "e"))
    table.write(spark.createDataFrame([], "k string, part string"), "part")
    assert table.read().count() == 0 and table.read().columns == ["k", "part"]
