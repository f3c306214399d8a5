import pytest
from pyspark.sql import functions as F
from conftest import rows_of
from hirecube import vocab
from hirecube.streaming.ingest import CubeStore, fold_lines, ingest_new_months
from hirecube.sources.raw import raw_lines
from test_raw import line, write


def key(store):
    return rows_of(store.read(snap=2), "data", "municipio", *vocab.CUBE_MEASURES)


def test_runs_add_up_and_take_files_once(spark, tmp_path):
    landing, store, progress = (tmp_path / n for n in ("landing", "store", "progress"))
    landing.mkdir()
    args = (spark, str(landing), str(store), str(progress))
    write(landing, "MOV202105.txt", [line(), line(pay="100,00")])
    write(landing, "MOV202106.txt", [line(month="202106")], "cp1252")
    ingest_new_months(*args, max_files_per_batch=1)
    cube = CubeStore(spark, str(store))
    first = key(cube)
    assert first == [("2021-05", "355030", 1950.4, 62.0, 2), ("2021-06", "355030", 1850.4, 31.0, 1)]
    ingest_new_months(*args)
    assert key(cube) == first
    # a late file for an old month
    write(landing, "MOV202105_late.txt", [line(pay="50,00"), "fim;;;;;;;;;;;"])
    ingest_new_months(*args)
    assert key(cube)[0] == ("2021-05", "355030", 2000.4, 93.0, 3)
    assert cube.compact() is not None and cube.compact() is None
    assert key(cube)[0] == ("2021-05", "355030", 2000.4, 93.0, 3)
    write(landing, "MOV202107.txt", [line(month="202107")])
    ingest_new_months(*args)
    batch = rows_of(fold_lines(raw_lines(spark, str(landing))), "data", "municipio", *vocab.CUBE_MEASURES)
    assert [(r[0], r[1], round(r[2], 2), *r[3:]) for r in batch] == key(cube)
    assert rows_of(cube.read(["2021-07"]), "data") == [("2021-07",)]


def test_months_leave_other_files_for_later(spark, tmp_path):
    landing, store, progress = (tmp_path / n for n in ("landing", "store", "progress"))
    landing.mkdir()
    args = (spark, str(landing), str(store), str(progress))
    write(landing, "MOV202101.txt", [line(month="202101")])
    write(landing, "MOV202102.txt", [line(month="202102")])
    ingest_new_months(*args, months=["202101"])
    cube = CubeStore(spark, str(store))
    assert rows_of(cube.read(), "data") == [("2021-01",)]
    ingest_new_months(*args)
    assert rows_of(cube.read(), "data") == [("2021-01",), ("2021-02",)]


def test_repairs_and_restores_between_batches_lose_nothing(spark, tmp_path, make_cube):
    cube = CubeStore(spark, str(tmp_path / "store"))
    cube.put(make_cube([{"data": "2023-01"}]), 0)
    cube.put(make_cube([{"data": "2023-02"}]), 1)
    first = cube.compact()
    cube.base.replace_months(make_cube([{"data": "2023-01", "soma_salario": 7.0}]), ["2023-01"])
    cube.put(make_cube([{"data": "2023-03", "total_admissoes": 5}]), 2)
    want = [("2023-01", 7.0, 1), ("2023-02", 1000.0, 1), ("2023-03", 1000.0, 5)]
    assert rows_of(cube.read(), "data", "soma_salario", "total_admissoes") == want
    assert cube.compact() is not None
    assert rows_of(cube.read(), "data", "soma_salario", "total_admissoes") == want
    # the first base holds batches 0 and 1 only, so batch 2 counts again beside it
    cube.base.restore(first)
    assert rows_of(cube.read(), "data", "soma_salario", "total_admissoes") == [("2023-01", 1000.0, 1), *want[1:]]
    cube.put(make_cube([{"data": "2023-04"}]), 3)
    assert [r[0] for r in rows_of(cube.read(), "data")] == ["2023-01", "2023-02", "2023-03", "2023-04"]


def test_two_writers_of_one_version(spark, tmp_path, make_cube):
    cube = CubeStore(spark, str(tmp_path / "store"))
    cube.base.write(make_cube([{"data": "2023-01"}]), "data")
    with pytest.raises(RuntimeError, match="another writer"):
        cube.base._point(1, "other", None)


def test_replayed_batch_replaces_itself(spark, tmp_path, make_cube):
    cube = CubeStore(spark, str(tmp_path / "store"))
    assert cube.read().count() == 0 and cube.compact() is None
    delta = make_cube([{"data": "2023-01"}])
    for _ in range(2):
        cube.put(delta, 0)
    cube.put(delta, 1)
    assert rows_of(cube.read(), "soma_salario", "total_admissoes") == [(2000.0, 2)]
    cube.compact()
    cube.put(delta, 1)  # replay of a batch that is in the base already
    assert rows_of(cube.read(), "soma_salario", "total_admissoes") == [(2000.0, 2)]
    cube.put(delta, 2)
    assert rows_of(cube.read(), "soma_salario", "total_admissoes") == [(3000.0, 3)]


def test_two_progress_folders_lose_and_double_nothing(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    write(landing, "MOV202101.txt", [line(month="202101")])
    ingest_new_months(spark, str(landing), store, str(tmp_path / "p1"))
    write(landing, "MOV202102.txt", [line(month="202102")])
    ingest_new_months(spark, str(landing), store, str(tmp_path / "p2"))
    cube = CubeStore(spark, store)
    assert rows_of(cube.read(), "data", "total_admissoes") == [("2021-01", 1), ("2021-02", 1)]
    ingest_new_months(spark, str(landing), store, str(tmp_path / "p1"))
    assert rows_of(cube.read(), "data", "total_admissoes") == [("2021-01", 1), ("2021-02", 1)]
    assert rows_of(cube.ledger(), "arquivo", "batch_id")[-1][1] == 1


def test_reissued_file_replaces_its_own_delta(spark, tmp_path):
    import os
    landing, store, progress = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "p")
    landing.mkdir()
    write(landing, "MOV202103.txt", [line(month="202103"), line(month="202103")])
    write(landing, "MOV202104.txt", [line(month="202104")])
    ingest_new_months(spark, str(landing), store, progress)
    cube = CubeStore(spark, store)
    assert cube.compact() is not None
    write(landing, "MOV202103.txt", [line(month="202103")])
    os.utime(landing / "MOV202103.txt", (2_000_000_000, 2_000_000_000))
    ingest_new_months(spark, str(landing), store, str(tmp_path / "other"))
    assert rows_of(cube.read(), "data", "total_admissoes") == [("2021-03", 1), ("2021-04", 1)]
    assert cube.compact() is not None
    assert rows_of(cube.read(), "data", "total_admissoes") == [("2021-03", 1), ("2021-04", 1)]


def test_one_parse_gives_delta_and_audit(spark, tmp_path):
    """Rows left out of the cube are counted beside it, and the audit equals that of a parse of its own."""
    from hirecube.operators import clean as cl
    from hirecube.sources import raw

    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    header = "competênciamov;município;subclasse;cbo2002ocupação;graudeinstrução;idade;raça/cor;sexo;salário;tipomovimentação"
    lines = [f"202101;35000{i % 3};4711302;411010;7;{a};1;1;{p};{k}" for i, (a, p, k) in enumerate([
        ("30", "1000,50", "10"), ("x", "900,00", "10"), ("31", "?", "Admissão"), ("10", "800,00", "20"), ("40", "2,00", "31"), ("90", "700,00", "10"),
        ("25", "600,00", "10"), ("25", "600,00", "10")])]
    for name in ("202101.txt", "202102.txt"):
        (landing / name).write_bytes("\n".join([header, *lines]).encode("latin-1"))
    ingest_new_months(spark, str(landing), store, str(tmp_path / "progress"), min_age=5, max_age=95)
    kept = CubeStore(spark, store)
    profile = raw.profile_files(raw.raw_lines(spark, str(landing)))
    want = cl.outcome_of_ingest(profile, raw.read_movements(spark, str(landing)))
    assert rows_of(kept.audit(), *want.columns) == rows_of(want)
    folded = fold_lines(raw.raw_lines(spark, str(landing)), min_age=5, max_age=95)
    assert rows_of(kept.read(), *vocab.CUBE_KEYS, *vocab.CUBE_MEASURES) == rows_of(folded, *vocab.CUBE_KEYS, *vocab.CUBE_MEASURES)
    # no pay or age, or no admission: in cells of their own, not in the cube
    cells = kept.cells(0)
    assert cells.agg(F.sum("total_admissoes")).first()[0] == want.agg(F.sum("linhas")).first()[0]
    assert kept.deltas().agg(F.sum("total_admissoes")).first()[0] == folded.agg(F.sum("total_admissoes")).first()[0] < 2 * len(lines)


def test_merging_deltas_sums_after_the_shuffle_only(spark, make_cube, tmp_path):
    """Deltas are folded already: a task that reads them must not hold its whole split in a hash map."""
    kept = CubeStore(spark, str(tmp_path / "store"))
    kept.put(make_cube([{"data": "2023-01"}, {"data": "2023-02"}]), 0)
    above, below = kept.read()._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM", 1)
    assert "partial_sum(soma_salario" in above and "partial_sum(soma_salario" not in below
