from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import cube as cubes
from hirecube.operators import filters
from hirecube.operators.joins import join_quality, lookup_join

D = vocab.DISABILITY
CLEAN = f"data string, municipio string, cnae20subclasse string, grau_instrucao string, genero string, raca_cor string, `{D}` string, salario double, idade int"


def clean(spark, rows):
    return spark.createDataFrame(rows, CLEAN)


def test_build_cube_sums_and_keeps_null_keys_together(spark):
    rows = [
        ("2023-01", "350001", "47", None, "1", "1", "0", 1000.0, 30),
        ("2023-01", "350001", "47", None, "1", "1", "0", 2000.0, 40),
        ("2023-01", " 350001 ", "47", None, "1", "1", "0", 500.5, 20),
        ("2023-01", "350001", "47", "7", "1", "1", "0", 100.0, 50),
    ]
    got = rows_of(cubes.build_cube(clean(spark, rows)), "grau_instrucao", *vocab.CUBE_MEASURES)
    assert got == [("7", 100.0, 50.0, 1), ("nan", 3500.5, 90.0, 3)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("13"), st.sampled_from(["2023-01", "2023-02"]),
                          st.integers(1, 10**6), st.integers(14, 80), st.booleans()), min_size=1, max_size=30))
def test_cube_of_parts_adds_up(spark, moves):
    rows = [(m, "350001", "47", "7", g, "1", "0", cents / 100, age) for g, m, cents, age, _ in moves]
    left = [r for r, move in zip(rows, moves) if move[4]]
    right = [r for r, move in zip(rows, moves) if not move[4]]
    whole = cubes.build_cube(clean(spark, rows), snap=2)
    merged = cubes.merge_cube(
        cubes.build_cube(clean(spark, left)), cubes.build_cube(clean(spark, right)), snap=2
    )
    assert rows_of(whole) == rows_of(merged)


def test_with_disability_spellings(spark):
    base = spark.createDataFrame([("1.0",)], "v string")
    for name in ("tipodedeficiência", "TipoDeDeficiencia", "tipo_deficiencia", "Deficiencia"):
        out = cubes.with_disability(base.withColumnRenamed("v", name))
        assert out.columns == [D] and out.first()[0] == "1"
    assert cubes.with_disability(base).select(D).first()[0] == "9"


def test_empty_cube_has_the_schema(spark):
    assert cubes.empty_cube(spark).schema == cubes.merge_cube(cubes.empty_cube(spark)).schema


def test_only_admissions(spark):
    rows = [("10", None), ("20.0", None), (" 25 ", None), ("31", None), ("Admissão", None), ("READMISSÃO", "-1"),
            ("31", "1"), ("31", "1,0"), (None, None), ("x", "-1")]
    df = spark.createDataFrame(rows, f"tipo_movimentacao string, `{vocab.BALANCE}` string")
    got = [tuple(r) for r in filters.only_admissions(df).collect()]
    assert sorted(got, key=repr) == sorted(
        [rows[0], rows[1], rows[2], rows[4], rows[5], rows[6]], key=repr)
    assert filters.only_admissions(df.drop(vocab.BALANCE)).count() == 5


def test_quality_bounds_edges(spark):
    ages = [13, 14, 80, 81]
    pays = [0.0, 0.01, 199999.99, 200000.0]
    df = spark.createDataFrame([(a, 1000.0) for a in ages] + [(30, p) for p in pays], "idade int, salario double")
    got = rows_of(filters.quality_bounds(df))
    assert got == sorted([(14, 1000.0), (80, 1000.0), (30, 0.01), (30, 199999.99)], key=repr)


def test_scenarios_and_groups(make_cube):
    cube = make_cube([
        {"municipio": "350001", "cnae20subclasse": "4711302"}, {"municipio": "430001", "cnae20subclasse": "4600000"},
        {"municipio": "990001", "cnae20subclasse": "0111301", "raca_cor": "9"},
        {"total_admissoes": 0, "soma_salario": 0.0},
    ])
    count = lambda kind, value: filters.scenario_filter(cube, kind, value).count()
    assert [count("geral", "brasil"), count("municipio", "430001"), count("regiao", "SUDESTE"), count("regiao", "NA"),
            count("cnae", "47"), count("cnae", "4")] == [4, 1, 2, 1, 2, 3]
    assert filters.positive_weight(cube, salary_too=True).count() == 3
    assert filters.known_groups(cube, "raca_cor").count() == 3
    assert filters.year_filter(cube, 2023).count() == 4 and filters.year_filter(cube, 2024).count() == 0


def test_quality_weights_join(spark):
    series = spark.createDataFrame([("2023-01", 1), ("2023-02", 2), ("2023-03", 3)], "data string, v int")
    weights = spark.createDataFrame([("2023-01", 0.59), ("2023-02", 0.60)], "mes string, peso_qualidade double")
    kept = filters.quality_filter(join_quality(series, weights))
    assert rows_of(kept, "data") == [("2023-02",), ("2023-03",)]


def test_lookup_join_is_the_same_when_salted(spark):
    facts = spark.range(500).withColumn("k", F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 20))
    lookup = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        small = lookup_join(facts, lookup, "k", how)
        large = lookup_join(facts, lookup, "k", how, max_rows=3, salts=5, spread_by=["id"])
        heavy = lookup_join(facts, lookup, "k", how, max_bytes=10, salts=3)
        assert rows_of(small, "id", "k", "v") == rows_of(large, "id", "k", "v") == rows_of(heavy, "id", "k", "v")
