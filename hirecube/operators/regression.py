"""Log-linear least squares of mean pay on profile dummies, fitted with Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.numbers import log_target, report_round, weighted
from hirecube.functions.text import upper_category
from hirecube.operators.filters import positive_weight

COEFFICIENT_COLUMNS = ["variavel", "coeficiente", "p_valor"]


def regression_groups(cube: DataFrame, regroup: bool = False, snap: int | None = None) -> DataFrame:
    """Mean pay and age per profile: gender, race, activity division, education, disability, region.

    Races outside the valid codes become ``9`` after grouping, so that several
    observations may share a profile; ``regroup`` relabels first instead.
    """
    race = dims.bucket_unknown(F.col("raca_cor"), vocab.VALID_RACES)
    rows = positive_weight(cube, salary_too=True).select(
        dims.gender_name(F.col("genero")).alias("genero_nome"),
        (race if regroup else F.col("raca_cor")).alias("raca_cor"),
        dims.activity_division(F.col("cnae20subclasse")).alias("cnae_divisao"),
        "grau_instrucao",
        F.col(vocab.DISABILITY).alias("tipo_def"),
        dims.region(F.col("municipio")).alias("regiao"),
        *vocab.CUBE_MEASURES,
    )
    groups = rows.groupBy(*vocab.REGRESSION_CATEGORIES).agg(
        weighted("soma_salario", "total_admissoes", snap).alias("salario_medio"),
        weighted("soma_idade", "total_admissoes", snap).alias("idade_media"),
        F.sum("total_admissoes").alias("total_admissoes"),
    )
    return groups.withColumn("raca_cor", dims.bucket_unknown(F.col("raca_cor"), vocab.VALID_RACES))


def dummy_encode(df: DataFrame, categories: list[str], numbers: list[str]):
    """(frame with a ``features`` vector, feature names, base level per category).

    Indexing levels in descending order and dropping the last slot drops the
    alphabetically first level. A category with one level only has no dummy.
    """
    frame, names, bases, parts = df, [], {}, []
    if categories:
        indexed = [f"_i_{c}" for c in categories]
        indexer = StringIndexer(
            inputCols=categories, outputCols=indexed, stringOrderType="alphabetDesc", handleInvalid="error"
        ).fit(df)
        levels = dict(zip(categories, indexer.labelsArray))
        used = [c for c in categories if len(levels[c]) > 1]
        bases = {c: levels[c][-1] for c in categories}
        frame = indexer.transform(df)
        if used:
            encoder = OneHotEncoder(
                inputCols=[f"_i_{c}" for c in used], outputCols=[f"_v_{c}" for c in used], dropLast=True
            )
            frame = encoder.fit(frame).transform(frame)
            parts = [f"_v_{c}" for c in used]
            names = [f"{c}_{level}" for c in used for level in levels[c][:-1]]
    frame = VectorAssembler(inputCols=[*parts, *numbers], outputCol="features").transform(frame)
    return frame, [*names, *numbers], bases


def aliased_columns(frame: DataFrame, order: list[int], tolerance: float = 1e-9) -> set[int]:
    """Columns that are linear combinations of earlier ones (in ``order``) and the constant.

    Executors fold the rows to variances and a correlation matrix, one entry per
    pair of model terms; the sequential elimination on that matrix is model-sized.
    """
    variance = frame.select(Summarizer.variance(F.col("features"))).first()[0].toArray()
    corr = Correlation.corr(frame, "features").first()[0].toArray()
    kept: list[int] = []
    dropped: set[int] = set()
    for j in order:
        if variance[j] <= 0.0:  # an alias of the constant
            dropped.add(j)
            continue
        if kept:
            block, cross = corr[np.ix_(kept, kept)], corr[kept, j]
            left = 1.0 - cross @ np.linalg.solve(block, cross)
            if left < tolerance:
                dropped.add(j)
                continue
        kept.append(j)
    return dropped


def _constant_only(design: DataFrame, weighted: bool) -> tuple[float | None, ...]:
    """Mean, standard error, t and p value of a constant without any other term."""
    w = F.col("_w") if weighted else F.lit(1.0)
    sums = design.agg(F.count("_y"), F.sum(w), F.sum(w * F.col("_y"))).first()
    n, whole, total = sums
    if not n or not whole:
        return None, None, None, None
    mean = total / whole
    if n < 2:
        return mean, None, None, None
    rss = design.agg(F.sum(w * F.pow(F.col("_y") - F.lit(mean), 2))).first()[0]
    error = (rss / (n - 1) / whole) ** 0.5
    if not error:
        return mean, 0.0, None, None
    t = mean / error
    tail = design.sparkSession._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 1))
    return mean, error, t, 2 * tail.cumulativeProbability(-abs(t))


def ols(
    df: DataFrame,
    y: str = "salario_medio",
    categories: list[str] | None = None,
    numbers: list[str] | None = None,
    log_y: bool = True,
    weight_col: str | None = None,
    details: bool = False,
) -> DataFrame:
    """Coefficients and two-sided p-values: constant, dummies, numbers.

    The fit is unweighted over the rows unless ``weight_col`` is given. Aliased
    terms are reported with null numbers. ``details`` adds standard error,
    t value and the base level the term is measured against.
    """
    categories = vocab.REGRESSION_CATEGORIES if categories is None else categories
    numbers = ["idade_media"] if numbers is None else numbers
    target = log_target(F.col(y)) if log_y else F.col(y).cast("double")
    design = df.select(
        *[upper_category(F.col(c)).alias(c) for c in categories],
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in numbers],
        target.alias("_y"),
        *([F.col(weight_col).cast("double").alias("_w")] if weight_col else []),
    )
    frame, names, bases = dummy_encode(design, categories, numbers)
    # encoded once; every later pass reads this
    frame = frame.select("features", *[c for c in design.columns if c.startswith("_")]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rank = {c: i for i, c in enumerate([*categories, *numbers])}

        def place(i: int):
            owner = max((c for c in rank if names[i] == c or names[i].startswith(f"{c}_")), key=len)
            return rank[owner], names[i]

        order = sorted(range(len(names)), key=place)
        dropped = aliased_columns(frame, order) if names else set()
        kept = [i for i in order if i not in dropped]
        by_term = {} if kept else {"const": _constant_only(frame, weight_col is not None)}
        if kept:
            sliced = VectorSlicer(inputCol="features", outputCol="terms", indices=kept).transform(frame)
            options = {"weightCol": "_w"} if weight_col else {}
            model = LinearRegression(
                featuresCol="terms", labelCol="_y", solver="normal", regParam=0.0, **options
            ).fit(sliced)
            summary = model.summary
            estimates = [*map(float, model.coefficients), float(model.intercept)]
            stats = zip(
                estimates, map(float, summary.coefficientStandardErrors), map(float, summary.tValues),
                map(float, summary.pValues),
            )
            by_term = dict(zip([*kept, "const"], stats))
    finally:
        frame.unpersist()

    def base(i: int):
        owner = max((c for c in bases if names[i].startswith(f"{c}_")), key=len, default=None)
        return bases.get(owner)

    terms = [("const", "const", None), *[(i, names[i], base(i)) for i in order]]
    rows = []
    for position, (key, name, level) in enumerate(terms):
        b, se, t, p = by_term.get(key, (None, None, None, None))
        rows.append((position, name, b, p, se, t, level))
    out = df.sparkSession.createDataFrame(
        rows,
        "ordem int, variavel string, coeficiente double, p_valor double, erro_padrao double, t_valor double, "
        "base string",
    )
    return out if details else out.select(*COEFFICIENT_COLUMNS)


def report_coefficients(coefs: DataFrame) -> DataFrame:
    """Coefficients x 100 with 2 digits and p-values with 4, as shown in reports."""
    return coefs.select(
        "variavel",
        report_round(F.col("coeficiente") * 100, 2).alias("coeficiente"),
        report_round(F.col("p_valor"), 4).alias("p_valor"),
    )


def effect_table(coefs: DataFrame, dim: str, significance: float = 0.05) -> DataFrame:
    """Effect of each category against its base, smallest first.

    The base is the first category in natural order and shows 0, as do categories
    without a coefficient. ``impacto_pct`` is the log approximation;
    ``impacto_exato_pct`` is (exp(b) - 1) x 100.
    """
    prefix, table = vocab.REGRESSION_COLUMNS[dim], vocab.LABELS[dim]["factor"]
    base = sorted(table, key=lambda c: (len(c), c))[0]
    lines = [(code, name, f"{prefix}_{code}") for code, name in table.items()]
    categories = coefs.sparkSession.createDataFrame(lines, "codigo string, categoria string, variavel string")
    rounded = report_coefficients(coefs).withColumnRenamed("coeficiente", "impacto").join(
        coefs.select("variavel", "coeficiente"), "variavel"
    )
    joined = categories.join(rounded, "variavel", "left")
    is_base = F.col("codigo") == base
    p = F.when(~is_base, F.col("p_valor"))
    return joined.select(
        "codigo",
        "categoria",
        F.when(is_base, F.lit(0.0)).otherwise(F.coalesce("impacto", F.lit(0.0))).alias("impacto_pct"),
        p.alias("p_valor"),
        (F.coalesce(p, F.lit(1.0)) < significance).alias("significativo"),
        F.when(is_base, F.lit(0.0))
        .otherwise(report_round((F.exp(F.coalesce("coeficiente", F.lit(0.0))) - 1) * 100, 2))
        .alias("impacto_exato_pct"),
        is_base.alias("base"),
    ).orderBy("impacto_pct", "codigo")
