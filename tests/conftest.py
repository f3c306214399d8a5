import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hirecube.session import get_session

    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_cube(spark):
    """Cube rows from dicts; keys left out get a default."""
    from hirecube import vocab
    from hirecube.operators.cube import CUBE_SCHEMA

    defaults = {
        "data": "2023-01", "municipio": "350001", "cnae20subclasse": "4711302", "grau_instrucao": "7",
        "genero": "1", "raca_cor": "1", vocab.DISABILITY: "0", "soma_salario": 1000.0, "soma_idade": 30.0,
        "total_admissoes": 1,
    }
    names = [*vocab.CUBE_KEYS, *vocab.CUBE_MEASURES]

    def make(rows):
        return spark.createDataFrame([tuple({**defaults, **r}[n] for n in names) for r in rows], CUBE_SCHEMA)

    return make


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
