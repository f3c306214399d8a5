import pytest
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims, months, numbers, text


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_name(spark):
    given = [" Município ", "RAÇA/COR", "saldo_movimentação", "grau de instrução", "ﬁm", "açúcar", "nº 1", None]
    assert apply(spark, given, text.norm_name)[:4] == [
        "municipio", "racacor", "saldo_movimentacao", "graudeinstrucao"]
    assert apply(spark, given, text.norm_name)[5:] == ["acucar", "no1", None]


def test_parse_decimal_comma(spark):
    given = ["1.850,40", " 1850,4 ", "1850", "abc", "", None, "1d", "NaN", "-3,5", "1.234.567,89"]
    assert apply(spark, given, numbers.parse_decimal_comma) == [
        1850.4, 1850.4, 1850.0, None, None, None, None, None, -3.5, 1234567.89]


def test_numbers_and_integers(spark):
    given = ["31", " 31 ", "31.0", "31.5", "x", "1e1", "+7", "0x1F", "1f", ".5", "5."]
    assert apply(spark, given, numbers.to_number_or_null) == [
        31, 31, 31, 31.5, None, 10, 7, None, None, 0.5, 5]
    assert apply(spark, given, numbers.to_integer_or_null) == [31, 31, 31, None, None, 10, 7, None, None, None, 5]


@pytest.mark.parametrize("raw,competence,month", [
    ("202105", "202105", "2021-05"),
    (" 2021/05 ", "202105", "2021-05"),
    ("20211", "020211", None),      # padded, and then no plausible year
    ("202113", "202113", None),
    ("20210501", "20210501", None),  # never cut
    (None, "000000", None),
    ("226201", "226201", None),
])
def test_competence_and_month(spark, raw, competence, month):
    df = spark.createDataFrame([(raw,)], "v string").select(months.norm_competence(F.col("v")).alias("c"))
    row = df.select("c", months.month_of(F.col("c")).alias("m")).first()
    assert (row["c"], row["m"]) == (competence, month)


def test_month_arithmetic(spark):
    given = ["1999-12", "2000-01", "2021-08"]
    index = apply(spark, given, lambda c: months.month_index(c))
    assert index == [1999 * 12 + 11, 2000 * 12, 2021 * 12 + 7]
    assert apply(spark, index, months.month_text, "int") == given
    assert [str(d) for d in apply(spark, index, months.month_date, "int")] == [g + "-01" for g in given]
    assert [str(d) for d in apply(spark, given, months.first_of_month)] == [g + "-01" for g in given]


def test_key_text_gathers_nulls(spark):
    assert apply(spark, [None, " 1 ", "\t2\xa0"], text.key_text) == ["nan", "1", "2"]


def test_disability_code_loses_float_tail(spark):
    assert apply(spark, ["1.0", " 1", "10", "x.0", None], text.disability_code) == ["1", "1", "10", "x.0", None]


def test_upper_category_names_nulls(spark):
    assert apply(spark, [None, "sul"], text.upper_category) == ["NONE", "SUL"]


def test_report_round_is_half_even_on_scaled_values(spark):
    given = [0.125, 0.375, 2.665, 2.675, 49456.994999999995, -0.125]
    import numpy as np
    assert apply(spark, given, lambda c: numbers.report_round(c, 2), "double") == [float(np.round(v, 2)) for v in given]


def test_safe_ratio_and_finite(spark):
    row = spark.sql("SELECT 1.0D a, 0L z, double('nan') n, double('inf') i").select(
        numbers.safe_ratio(F.col("a"), F.col("z")), numbers.finite_or_null(F.col("n")),
        numbers.finite_or_null(F.col("i")), numbers.finite_or_null(F.col("a")),
    ).first()
    assert list(row) == [None, None, None, 1.0]


def test_labels_regions_and_buckets(spark):
    assert apply(spark, ["1", "3", "9", None], dims.gender_name) == ["MASC", "FEM", "NA", "NA"]
    assert apply(spark, ["7", "77", None], lambda c: dims.label(c, "grau_instrucao", "chart", "Código {}")) == [
        "Superior completo", "Código 77", None]
    assert apply(spark, ["355030", "999999", None], dims.region) == ["SUDESTE", "NA", "NA"]
    assert apply(spark, ["355030", "999999"], dims.state) == ["SP", "NA"]
    assert apply(spark, ["1", "7", None], lambda c: dims.bucket_unknown(c, vocab.VALID_RACES)) == ["1", "9", "9"]
    assert apply(spark, ["4711302"], dims.activity_division) == ["47"]


def test_natural_order(spark):
    df = spark.createDataFrame([("10",), ("2",), ("1",)], "v string")
    assert [r[0] for r in df.orderBy(*text.natural_order(F.col("v"))).collect()] == ["1", "2", "10"]


def test_dimension_tables(spark):
    labels = dims.dim_labels(spark)
    assert labels.where("dim = 'grau_instrucao' and not include_flag").count() == 2
    assert labels.where("dim = 'genero'").select("label_factor").distinct().count() == 2
    assert dims.dim_uf(spark).count() == 27
