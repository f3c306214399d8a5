import itertools

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from hirecube import vocab
from hirecube.operators import clean as cl
from hirecube.session import checkpoint
from hirecube.sources import raw

D = vocab.DISABILITY
HEADER = ("competênciamov;município;subclasse;cbo2002ocupação;graudeinstrução;idade;raça/cor;sexo;salário;"
          "tipomovimentação;saldomovimentação;tipodedeficiência")


def line(**over):
    cells = {
        "month": "202105", "city": "355030", "act": "4711302", "job": "521110", "edu": "7", "age": "31", "race": "3",
        "sex": "1", "pay": "1.850,40", "kind": "20", "balance": "-1", "dis": "0",
    }
    return ";".join({**cells, **over}.values())


def write(folder, name, lines, encoding="utf-8", header=HEADER):
    data = "\n".join([header, *lines]) + "\n"
    (folder / name).write_bytes(data.encode(encoding))


def read(spark, folder, **options):
    return raw.read_movements(spark, str(folder), **options)


LINES = [
    line(),
    line(kind="31"),                             # not an admission
    line(kind="Admissão", city="111111"),
    line(kind="31", balance="1", city="222222"),
    line(pay="abc"), line(age="x"), line(age="31.5"),
    line(age="13", city="13"), line(age="14", city="14"), line(age="80", city="80"), line(age="81", city="81"),
    line(pay="0", city="p0"), line(pay="199999,99", city="p1"), line(pay="200000", city="p2"),
    line(month="202113", city="m1"), line(month="20211", city="m2"), line(month="2021/06", city="m3"),
    line(dis="", city="nulldis"),
    "202105;short;4711302",                      # short: null-padded, and no admission
    line(city="long") + ";x", line(city="long by one empty") + ";",
    "", "   ",
    '202105;"quo;ted";4711302;521110;7;31;3;1;100,00;20;-1;0',
    line(city="NA", sex=" 3 "),
]
TRAILER = "total;;;;;;;;;20;1;"
IN_CUBE = {"355030", "111111", "222222", "14", "80", "p1", "m3", "nulldis", "quo;ted", "nan"}


@pytest.mark.parametrize("encoding,detected", [("utf-8", "utf-8"), ("cp1252", "cp1252"), ("latin-1", "latin-1")])
def test_lines_of_every_kind(spark, tmp_path, encoding, detected):
    extra = [line(city="€uro")] if encoding == "cp1252" else [line(city="\x81")] if encoding == "latin-1" else []
    write(tmp_path, "CAD202105.txt", LINES + extra + [TRAILER], encoding)
    profile = raw.profile_files(raw.raw_lines(spark, str(tmp_path)))
    row = profile.first()
    assert (row["encoding"], row["accepted"], row["bad_trailer"], row["long_lines"]) == (detected, True, True, 2)
    rows = checkpoint(read(spark, tmp_path))
    assert rows.count() == len(LINES) - 4 + len(extra)  # two long, two blank; the trailer is gone
    clean = cl.clean_movements(rows)
    cube = cl.to_cube(clean)
    expected = IN_CUBE | ({"€uro"} if encoding == "cp1252" else {"\x81"} if encoding == "latin-1" else set())
    # 0x81 is a control character, no white space: it stays
    assert {r["municipio"] for r in cube.collect()} == expected
    assert {r["municipio"]: r[D] for r in cube.collect()}["nulldis"] == "nan"
    assert clean.where("municipio = 'm2'").first()["competencia_mov"] == "020211"
    assert clean.where("municipio is null").first()["genero"] == "3"
    audit = cl.ingest_audit(rows).first()
    assert audit["no_cubo"] == cube.agg(F.sum("total_admissoes")).first()[0]
    assert audit["salario_ilegivel"] == 1 and audit["idade_ilegivel"] == 2


def test_bad_row_counts_as_trailer_only_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "COPIES_PER_TASK", 2)
    bad = line(city="")  # required cell missing, would pass everything else
    write(tmp_path, "a202105.txt", [bad, bad, bad, bad, bad, line(), bad])
    write(tmp_path, "b202105.txt", [bad, line()])
    rows = read(spark, tmp_path)
    got = {r["f"]: r["n"] for r in rows.where("`município` is null").groupBy(
        F.substring_index("arquivo", "/", -1).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a202105.txt": 5, "b202105.txt": 1}
    assert rows.count() == 8


def test_many_splits_give_the_same(spark, tmp_path):
    lines = [line(city=f"{i:06d}") for i in range(400)] + [TRAILER]
    write(tmp_path, "x202105.txt", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines_df = raw.raw_lines(spark, str(tmp_path))
        assert lines_df.rdd.getNumPartitions() > 5
        assert {r[0] for r in read(spark, tmp_path).select("`município`").collect()} == {f"{i:06d}" for i in range(400)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_header_variants_and_rejections(spark, tmp_path):
    other = "Competência Mov;cod_municipio;CNAE20Subclasse;CBO;Grau_de_Instrução;Idade;Raca_Cor;Sexo;Valor_Salario;Tipo_Movimentacao"
    write(tmp_path, "v1_202105.txt", [line().rsplit(";", 2)[0]], header=other)
    write(tmp_path, "v2_202105.txt", [line()])
    write(tmp_path, "bad_header.txt", ["1;2"], header="a;b")
    write(tmp_path, "no_pay_202105.txt", [line()], header=HEADER.replace("salário", "outro"))
    audit = {r["arquivo"].rsplit("/", 1)[1]: r for r in cl.file_audit(
        raw.profile_files(raw.raw_lines(spark, str(tmp_path)))).collect()}
    # the first variant has three of the seven markers only
    assert {k for k, r in audit.items() if r["accepted"]} == {"v2_202105.txt"}
    assert audit["no_pay_202105.txt"]["motivo"] == "missing columns: salário"
    assert audit["bad_header.txt"]["motivo"] == "header not recognised"


def test_absent_disability_and_order_of_spellings(spark, tmp_path):
    head = HEADER.rsplit(";", 1)[0].replace("subclasse", "subclasse;cnae20subclasse")
    cells = line().rsplit(";", 1)[0].split(";")
    cells.insert(3, "canonical wins")
    write(tmp_path, "f202105.txt", [";".join(cells)], header=head)
    row = read(spark, tmp_path).first()
    assert row["cnae20subclasse"] == "canonical wins" and row[D] == "9"


def test_month_subset(spark, tmp_path):
    for month in ("202105", "202106", "202203"):
        write(tmp_path, f"MOV{month}.txt", [line(month=month)])
    rows = read(spark, tmp_path, months=["202105", "202203", "junk"])
    assert rows_of(rows, "`competênciamov`") == [("202105",), ("202203",)]


def brute_force_fields(text):
    import csv
    return next(csv.reader([text], delimiter=";"))


def test_quote_aware_split(spark):
    cells = ["a", '"b;c"', "", '"x""y"', "d"]
    texts = [";".join(p) for p in itertools.permutations(cells, 3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", raw.split_fields(F.col("t")).alias("f"), raw.count_fields(F.col("t")).alias("n")).collect():
        assert r["f"] == brute_force_fields(r["t"]) and r["n"] == len(r["f"])
