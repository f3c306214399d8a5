"""The benchmark tables read as labour movements.

Each line item is one movement; its order and customer supply the profile. The
same mapping is written twice, as DataFrame code and as SQL for cross-checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirecube import vocab
from hirecube.operators.cube import build_cube, cube_rows
from hirecube.operators.filters import quality_bounds

# pay in these tables averages about 53,000, so the upper bound is lowered until it bites
MAX_SALARY = 100_000.0
PREFIXES = list(vocab.STATES)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table. Its schema is read from the files once per process, not once per query."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements with the columns of the clean data set."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    prefixes = ", ".join(f"'{p}'" for p in PREFIXES)
    return rows.selectExpr(
        "date_format(l_shipdate, 'yyyyMM') AS competencia_mov",
        f"get(array({prefixes}), c_nationkey) || lpad(c_custkey % 100, 4, '0') AS municipio",
        "lpad(l_partkey % 90, 2, '0') || '00' AS cnae20subclasse",
        "lpad(l_suppkey % 10000, 6, '0') AS cbo2002ocupacao",
        "substring(o_orderpriority, 1, 1) AS grau_instrucao",
        "int(l_quantity) + 11 AS idade",
        """CASE c_mktsegment WHEN 'MACHINERY' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'AUTOMOBILE' THEN '3'
           WHEN 'FURNITURE' THEN '4' ELSE '5' END AS raca_cor""",
        "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '3' ELSE '9' END AS genero",
        "l_extendedprice AS salario",
        """CASE WHEN l_linestatus = 'F' THEN '10' WHEN l_linenumber % 2 = 0 THEN 'Admissão' ELSE '31' END
           AS tipo_movimentacao""",
        f"if(l_linenumber = 7, '1', '-1') AS `{vocab.BALANCE}`",
        f"CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '9' END AS `{vocab.DISABILITY}`",
        "date_format(l_shipdate, 'yyyy-MM') AS data",
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bounds(movements(spark, sf_dir), max_salary=MAX_SALARY)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungrouped cube rows: enough for every query that only adds."""
    return cube_rows(clean(spark, sf_dir))


def cube(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    return build_cube(clean(spark, sf_dir), keys, snap=2)


_PREFIX_SQL = "[" + ", ".join(f"'{p}'" for p in PREFIXES) + "]"

MOVEMENTS_SQL = f"""
movements AS (
  SELECT strftime(l_shipdate, '%Y%m') AS competencia_mov,
    list_extract({_PREFIX_SQL}, c_nationkey + 1) || lpad(CAST(c_custkey % 100 AS VARCHAR), 4, '0') AS municipio,
    lpad(CAST(l_partkey % 90 AS VARCHAR), 2, '0') || '00' AS cnae20subclasse,
    lpad(CAST(l_suppkey % 10000 AS VARCHAR), 6, '0') AS cbo2002ocupacao,
    substr(o_orderpriority, 1, 1) AS grau_instrucao,
    CAST(trunc(l_quantity) AS INTEGER) + 11 AS idade,
    CASE c_mktsegment WHEN 'MACHINERY' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'AUTOMOBILE' THEN '3'
      WHEN 'FURNITURE' THEN '4' ELSE '5' END AS raca_cor,
    CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '3' ELSE '9' END AS genero,
    l_extendedprice AS salario,
    CASE WHEN l_linestatus = 'F' THEN '10' WHEN l_linenumber % 2 = 0 THEN 'Admissão' ELSE '31' END
      AS tipo_movimentacao,
    CASE WHEN l_linenumber = 7 THEN '1' ELSE '-1' END AS "saldomovimentação",
    CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '9' END AS "tipodedeficiência",
    strftime(l_shipdate, '%Y-%m') AS data
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
clean AS (
  SELECT * FROM movements WHERE idade BETWEEN 14 AND 80 AND salario > 0 AND salario < {MAX_SALARY:.1f}
),
cube_rows AS (
  SELECT data, municipio, cnae20subclasse, grau_instrucao, genero, raca_cor, "tipodedeficiência",
    salario AS soma_salario, CAST(idade AS DOUBLE) AS soma_idade, CAST(1 AS BIGINT) AS total_admissoes
  FROM clean
)"""


def cube_sql(keys: list[str] | None = None) -> str:
    cols = ", ".join(f'"{k}"' for k in (keys or vocab.CUBE_KEYS))
    return (
        f"cube AS (SELECT {cols}, round(sum(soma_salario), 2) AS soma_salario, "
        "round(sum(soma_idade), 2) AS soma_idade, CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes "
        f"FROM cube_rows GROUP BY {cols})"
    )


def with_sql(body: str, *ctes: str) -> str:
    """SQL with the movement tables in front."""
    return "WITH " + ",\n".join([MOVEMENTS_SQL.strip(), *ctes]) + "\n" + body.strip()
