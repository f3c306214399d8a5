"""Repair of outlier months against a pooled baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions.numbers import safe_ratio
from hirecube.operators.means import pooled_means

COARSE_KEYS = [k for k in vocab.GROUP_KEYS if k != vocab.DISABILITY]


def join_baseline(target: DataFrame, baseline: DataFrame, keys: list[str], snap: int | None = None) -> DataFrame:
    """Target rows with pooled means and largest prior mean of their group; null keys match.

    Both baseline numbers come from one aggregate, so the baseline is shuffled
    once and joined once.
    """
    means = pooled_means(baseline, keys, snap)
    base = means.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in means.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    return target.join(base, same, "left").drop(*[f"_b_{k}" for k in keys])


def flag_outliers(
    joined: DataFrame, limit: float = vocab.OUTLIER_MEAN, factor: float = vocab.OUTLIER_FACTOR
) -> DataFrame:
    """Three tests on the mean of a row; a test against a missing number is false."""
    mean = safe_ratio(F.col("soma_salario"), F.col("total_admissoes"))
    tests = [mean > limit, mean > factor * F.col("prior_max_mean_sal"), mean > factor * F.col("mean_sal_base")]
    flag = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    return joined.withColumn("mean_sal", mean).withColumn("apply_fix", flag)


def repair_month(
    target: DataFrame,
    baseline: DataFrame,
    keys: list[str] | None = None,
    limit: float = vocab.OUTLIER_MEAN,
    factor: float = vocab.OUTLIER_FACTOR,
    strict: bool = False,
    audit: bool = False,
    snap: int | None = None,
) -> DataFrame:
    """Replace the sums of outlier groups by baseline mean x count; counts stay.

    A flagged group without a baseline keeps its sums, or loses them to null in
    ``strict`` mode. ``audit`` adds the flags and the baseline numbers.
    """
    keys = vocab.GROUP_KEYS if keys is None else keys
    rows = flag_outliers(join_baseline(target, baseline, keys, snap), limit, factor)
    no_baseline = F.col("apply_fix") & F.col("mean_sal_base").isNull()
    fix = F.col("apply_fix") if strict else F.col("apply_fix") & ~no_baseline

    def replaced(old: str, mean: str):
        return F.when(fix, F.col(mean) * F.col("total_admissoes")).otherwise(F.col(old))

    out = (
        rows.withColumn("no_baseline", no_baseline)
        .withColumn("soma_salario", replaced("soma_salario", "mean_sal_base"))
        .withColumn("soma_idade", replaced("soma_idade", "mean_idd_base"))
    )
    extra = ["apply_fix", "no_baseline", "mean_sal", "mean_sal_base", "prior_max_mean_sal"] if audit else []
    return out.select(*target.columns, *extra)


def repair_months_in_sequence(
    cube: DataFrame, plan: dict[str, list[str]], **options
) -> dict[str, DataFrame]:
    """Repair months in order; a month repaired earlier enters later baselines in repaired form.

    ``plan`` maps each month to its baseline months. A month that a later one
    uses is checkpointed in the session's shared folder, so each month is
    repaired once and no plan holds another month's; the rest stay lazy.
    """
    from hirecube.session import checkpoint

    fixed: dict[str, DataFrame] = {}
    order = list(plan)
    for done, (month, baseline_months) in enumerate(plan.items(), start=1):
        later = {m for after in order[done:] for m in plan[after]}
        untouched = [m for m in baseline_months if m not in fixed]
        baseline = cube.where(F.col("data").isin(untouched))
        for earlier in baseline_months:
            if earlier in fixed:
                baseline = baseline.unionByName(fixed[earlier])
        out = repair_month(cube.where(F.col("data") == month), baseline, **options)
        fixed[month] = checkpoint(out) if month in later else out
    return fixed


def apply_repairs(cube: DataFrame, fixed: dict[str, DataFrame]) -> DataFrame:
    """The cube with the repaired months in place of the old ones."""
    kept = cube.where(~F.col("data").isin(list(fixed)))
    return reduce(DataFrame.unionByName, [kept, *fixed.values()])
