"""The cube itself: building, merging, joining baselines, repairing months."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.operators import cube as cubes
from hirecube.operators import means, repair
from hirecube.plans import bindings as b
from hirecube.plans.catalog import register
from hirecube.session import checkpoint

COARSE = ["data", "grau_instrucao", "genero", "raca_cor"]
GROUP = COARSE[1:]


@register("build_cube", b.with_sql("SELECT * FROM cube", b.cube_sql()))
def _build_cube(spark, sf):
    return b.cube(spark, sf)


@register("build_cube_coarse", b.with_sql("SELECT * FROM cube", b.cube_sql(COARSE)))
def _build_coarse(spark, sf):
    return b.cube(spark, sf, COARSE)


@register("merge_cube", b.with_sql("SELECT * FROM cube", b.cube_sql(COARSE)))
def _merge_cube(spark, sf):
    """Two cubes over disjoint halves of the movements add up to the cube of all."""
    clean = b.clean(spark, sf)
    old = cubes.build_cube(clean.where(F.col("idade") < 30), COARSE)
    delta = cubes.build_cube(clean.where(F.col("idade") >= 30), COARSE)
    return cubes.merge_cube(old, delta, keys=COARSE, snap=2)


BASE_MONTHS = ["1998-05", "1998-06", "1998-07"]
BASE_SQL = """base AS (
  SELECT grau_instrucao, genero, raca_cor, round(sum(soma_salario), 2) / sum(total_admissoes) AS mean_sal_base,
    round(sum(soma_idade), 2) / sum(total_admissoes) AS mean_idd_base,
    max(soma_salario / total_admissoes) AS prior_max_mean_sal
  FROM cube WHERE data IN ('1998-05', '1998-06', '1998-07') GROUP BY ALL
)"""


def _month(spark, sf, months):
    """Coarse cube of some months only; the month filter goes below the aggregation."""
    return b.cube(spark, sf, COARSE).where(F.col("data").isin(months))


@register("pooled_means", b.with_sql("SELECT * FROM base", b.cube_sql(COARSE), BASE_SQL))
def _pooled(spark, sf):
    return means.pooled_means(_month(spark, sf, BASE_MONTHS), GROUP, snap=2)


@register("prior_max_mean", b.with_sql(
    "SELECT grau_instrucao, genero, raca_cor, prior_max_mean_sal FROM base", b.cube_sql(COARSE), BASE_SQL))
def _prior_max(spark, sf):
    return means.prior_max_mean(_month(spark, sf, BASE_MONTHS), GROUP)


@register("join_baseline", b.with_sql("""
SELECT t.*, mean_sal_base, mean_idd_base, prior_max_mean_sal FROM (SELECT * FROM cube WHERE data = '1998-08') t
LEFT JOIN base USING (grau_instrucao, genero, raca_cor)
""", b.cube_sql(COARSE), BASE_SQL))
def _join_baseline(spark, sf):
    cube = checkpoint(_month(spark, sf, ["1998-08", *BASE_MONTHS]))
    target, baseline = cube.where("data = '1998-08'"), cube.where(F.col("data").isin(BASE_MONTHS))
    return repair.join_baseline(target, baseline, GROUP, snap=2)


LIMIT, FACTOR = 60_000.0, 1.1


def _fixed_sql(month: str, base_months: list[str], source: str, name: str) -> list[str]:
    months = ", ".join(f"'{m}'" for m in base_months)
    return [
        f"""{name}_base AS (
  SELECT grau_instrucao, genero, raca_cor, round(sum(soma_salario), 2) / sum(total_admissoes) AS mb,
    round(sum(soma_idade), 2) / sum(total_admissoes) AS ib, max(soma_salario / total_admissoes) AS pm
  FROM {source} WHERE data IN ({months}) GROUP BY ALL
)""",
        f"""{name} AS (
  SELECT t.data, t.grau_instrucao, t.genero, t.raca_cor,
    CASE WHEN fix THEN mb * total_admissoes ELSE soma_salario END AS soma_salario,
    CASE WHEN fix THEN ib * total_admissoes ELSE soma_idade END AS soma_idade, total_admissoes, fix
  FROM (
    SELECT c.*, mb, ib, mb IS NOT NULL AND (
      coalesce(soma_salario / total_admissoes > {LIMIT}, false)
      OR coalesce(soma_salario / total_admissoes > {FACTOR} * pm, false)
      OR coalesce(soma_salario / total_admissoes > {FACTOR} * mb, false)) AS fix
    FROM cube c LEFT JOIN {name}_base USING (grau_instrucao, genero, raca_cor) WHERE c.data = '{month}'
  ) t
)""",
    ]


AUGUST_SQL = _fixed_sql("1998-08", BASE_MONTHS, "cube", "aug")
SEPTEMBER_SQL = [
    """after_aug AS (
  SELECT data, grau_instrucao, genero, raca_cor, soma_salario, soma_idade, total_admissoes FROM cube
  WHERE data <> '1998-08' UNION ALL BY NAME SELECT * EXCLUDE (fix) FROM aug
)""",
    *_fixed_sql("1998-09", ["1998-06", "1998-07", "1998-08"], "after_aug", "sep"),
]


def _rounded(df):
    # repaired sums are means times counts, no longer whole cents
    return df.select(
        *[c for c in df.columns if not c.startswith("soma_")],
        F.round("soma_salario", 6).alias("soma_salario"),
        F.round("soma_idade", 6).alias("soma_idade"),
    )


ROUNDED = "* REPLACE (round(soma_salario, 6) AS soma_salario, round(soma_idade, 6) AS soma_idade)"


@register("repair_month", b.with_sql(
    f"SELECT {ROUNDED} FROM (SELECT * EXCLUDE (fix), fix AS apply_fix FROM aug)", b.cube_sql(COARSE), *AUGUST_SQL))
def _repair_month(spark, sf):
    cube = checkpoint(_month(spark, sf, ["1998-08", *BASE_MONTHS]))
    out = repair.repair_month(
        cube.where("data = '1998-08'"), cube.where(F.col("data").isin(BASE_MONTHS)), GROUP, LIMIT, FACTOR, audit=True, snap=2
    )
    return _rounded(out.select(*COARSE, *vocab.CUBE_MEASURES, (F.col("apply_fix") & ~F.col("no_baseline"))
                               .alias("apply_fix")))


PLAN = {"1998-08": BASE_MONTHS, "1998-09": ["1998-06", "1998-07", "1998-08"]}


@register("repair_months_in_sequence", b.with_sql(
    f"SELECT {ROUNDED} FROM (SELECT * EXCLUDE (fix) FROM aug UNION ALL BY NAME SELECT * EXCLUDE (fix) FROM sep)",
    b.cube_sql(COARSE), *AUGUST_SQL, *SEPTEMBER_SQL))
def _repair_sequence(spark, sf):
    cube = checkpoint(_month(spark, sf, sorted({*BASE_MONTHS, *PLAN})))
    fixed = repair.repair_months_in_sequence(cube, PLAN, keys=GROUP, limit=LIMIT, factor=FACTOR, snap=2)
    return _rounded(fixed["1998-08"].unionByName(fixed["1998-09"]))


@register("repaired_cube_monthly_mean", b.with_sql(
    """SELECT data, round(sum(soma_salario) / sum(total_admissoes), 4) AS salario_medio FROM (
  SELECT * FROM after_aug WHERE data <> '1998-09' UNION ALL BY NAME SELECT * EXCLUDE (fix) FROM sep
) WHERE data IN ('1998-07', '1998-08', '1998-09') GROUP BY data""",
    b.cube_sql(COARSE), *AUGUST_SQL, *SEPTEMBER_SQL))
def _repaired_mean(spark, sf):
    cube = checkpoint(b.cube(spark, sf, COARSE))
    fixed = repair.repair_months_in_sequence(cube, PLAN, keys=GROUP, limit=LIMIT, factor=FACTOR, snap=2)
    out = means.monthly_mean(repair.apply_repairs(cube, fixed), ["1998-07", "1998-08", "1998-09"])
    return out.select("data", F.round("salario_medio", 4).alias("salario_medio"))
