"""Statistics of tensors and the profile of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C

METRICS = ("l2", "mean_kurtosis", "max_abs")
OUTLIER_STDS = 6.0


def is_finite(x: Column) -> Column:
    """Neither NaN nor infinite; null stays null."""
    return ~(F.isnan(x) | x.isin(float("inf"), float("-inf")))


def partial_moments(values: DataFrame, keys: list[str], value: str = "value", *also: Column) -> DataFrame:
    """Mergeable state of long-form values by ``keys``, from built-in aggregates, with any others in ``also``."""
    x = F.col(value).cast("double")
    fin = F.when(is_finite(x), x)
    return values.groupBy(*keys).agg(
        F.count(fin).alias("n"),
        F.count_if(F.isnan(x)).alias("nan_count"),
        F.count_if(x.isin(float("inf"), float("-inf"))).alias("inf_count"),
        F.count_if(fin == 0).alias("zeros"),
        F.min(fin).alias("min"),
        F.max(fin).alias("max"),
        F.max(F.abs(fin)).alias("max_abs"),
        F.avg(fin).alias("mean"),
        F.coalesce(F.var_pop(fin) * F.count(fin), F.lit(0.0)).alias("m2"),
        F.coalesce(F.skewness(fin) * F.pow(F.var_pop(fin), 1.5) * F.count(fin), F.lit(0.0)).alias("m3"),
        F.coalesce((F.kurtosis(fin) + 3) * F.pow(F.var_pop(fin), 2) * F.count(fin), F.lit(0.0)).alias("m4"),
        *also,
    )


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One state by ``keys`` from partial states, by the pairwise formulas about the common mean."""
    sums = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean")
    )
    d, n = F.coalesce("mean", F.lit(0.0)) - F.col("_mean"), F.col("n")
    shifted = parts.join(sums, keys).withColumns(
        {
            "_m2": F.when(n > 0, F.col("m2") + n * d * d),
            "_m3": F.when(n > 0, F.col("m3") + 3 * d * F.col("m2") + n * d * d * d),
            "_m4": F.when(n > 0, F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d),
        }
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return shifted.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "nan_count", "inf_count", "zeros")],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.max("max_abs").alias("max_abs"),
        F.first("_mean", True).alias("mean"),
        zero("_m2").alias("m2"),
        zero("_m3").alias("m3"),
        zero("_m4").alias("m4"),
    )


def describe(moments: DataFrame, element_count: str = "element_count") -> DataFrame:
    """``moments`` with std, l2_norm, rms, kurtosis and sparsity; null where nothing is finite, but sparsity 0."""
    n, m2 = F.col("n"), F.greatest(F.col("m2"), F.lit(0.0))
    some = n > 0
    sum_sq = F.greatest(m2 + n * F.col("mean") * F.col("mean"), F.lit(0.0))
    return moments.withColumns(
        {
            "std": F.when(some, F.sqrt(m2 / n)),
            "l2_norm": F.when(some, F.sqrt(sum_sq)),
            "rms": F.when(some, F.sqrt(sum_sq) / F.sqrt(n)),
            "kurtosis": F.when(some, F.when(m2 > 0, n * F.col("m4") / (m2 * m2) - 3).otherwise(0.0)),
            "sparsity": F.when(some, F.col("zeros") / F.greatest(F.col(element_count), F.lit(1))).otherwise(0.0),
        }
    )


def tensor_stats(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """All statistics of long-form values by ``keys``; element_count is the number of rows.

    The outlier mass needs the standard deviation first and so a second pass:
    the share of finite values more than six of them from zero.
    """
    first = describe(partial_moments(values, keys, value, F.count(F.lit(1)).alias("element_count")))
    x = F.col(value).cast("double")
    second = values.join(first.select(*keys, "std"), keys).groupBy(*keys).agg(F.count_if(is_finite(x) & (F.col("std") > 0) & (F.abs(x) > OUTLIER_STDS * F.col("std"))).alias("_out"))
    return first.join(second, keys).withColumn("outlier_mass", F.when(F.col("n") > 0, F.col("_out") / F.col("n"))).drop("_out")


def layer_profile(stats: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Layers of each of ``keys`` from per-tensor statistics: l2, mean_kurtosis, max_abs, params, sparsity."""
    layered = stats.withColumn("layer", C.layer_index(F.col(name))).where("layer is not null")
    n = F.col("element_count")
    return layered.groupBy(*keys, "layer").agg(
        F.sqrt(F.coalesce(F.sum(F.col("l2_norm") * F.col("l2_norm")), F.lit(0.0))).alias("l2"),
        F.coalesce(F.avg("kurtosis"), F.lit(0.0)).alias("mean_kurtosis"),
        F.greatest(F.coalesce(F.max("max_abs"), F.lit(0.0)), F.lit(0.0)).alias("max_abs"),
        F.sum(n).cast("bigint").alias("params"),
        F.coalesce(F.sum(F.coalesce("sparsity", F.lit(0.0)) * n) / F.nullif(F.sum(n).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("sparsity"),
    )


def robust_spread(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``points`` with ``med`` and ``mad`` of ``value`` by ``keys``; the mean deviation where the median one vanishes."""
    med = points.groupBy(*keys).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("n_points"))
    dev = points.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = dev.groupBy(*keys).agg(F.median("_dev").alias("_mad"), F.avg("_dev").alias("_mean_dev"))
    return dev.join(mad, keys).withColumn("mad", F.when(F.col("_mad") <= K.EPSILON, F.col("_mean_dev")).otherwise(F.col("_mad"))).drop("_dev", "_mad", "_mean_dev")


def layer_anomalies(profile: DataFrame, keys: list[str], mad_k: float = 5.0) -> DataFrame:
    """Layers that stand out from the others of the same ``keys``: layer, metric, value, mads, severity.

    Two-sided, for groups of four layers at least; of several metrics the one
    that is furthest out counts, of equal ones the first.
    """
    order = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    long = profile.unpivot([*keys, "layer"], list(METRICS), "metric", "value")
    spread = robust_spread(long, [*keys, "metric"], "value").where((F.col("n_points") >= 4) & (F.col("mad") > K.EPSILON))
    out = spread.withColumn("mads", F.abs(F.col("value") - F.col("med")) / F.col("mad")).where(F.col("mads") > mad_k)
    first = Window.partitionBy(*keys, "layer").orderBy(F.desc("mads"), order)
    return (
        out.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(*keys, "layer", "metric", "value", "mads", F.when(F.col("mads") >= 2 * mad_k, "medium").otherwise("low").alias("severity"))
    )
