"""Comparison of two models: alignment, drift of tensors and layers, ties, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C
from weightscope.operators import stats

SAME = 1e-6


def align(subject: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full outer join of tensors (name, shape, decodable) on canonical name.

    Where canonical names collide on one side the last in order counts. Gives
    canonical_name, kind (shape_mismatch, deferred, drift, only_in_subject,
    only_in_baseline) and both sides' columns.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        order = [F.desc("ord")] if "ord" in df.columns else [F.desc("name")]
        last = Window.partitionBy("canonical_name").orderBy(*order)
        one = df.withColumn("canonical_name", C.canonical_name(F.col("name"))).withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
        return one.select("canonical_name", *[F.col(c).alias(f"{tag}_{c}") for c in ("name", "shape", "decodable")])

    both = side(subject, "s").join(side(baseline, "b"), "canonical_name", "full_outer")
    kind = (
        F.when(F.col("b_name").isNull(), "only_in_subject")
        .when(F.col("s_name").isNull(), "only_in_baseline")
        .when(F.col("s_shape") != F.col("b_shape"), "shape_mismatch")
        .when(~(F.col("s_decodable") & F.col("b_decodable")), "deferred")
        .otherwise("drift")
    )
    return both.withColumn("kind", kind)


def pair_sums(pairs: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Mergeable sums of value pairs (s, b) by ``keys``; NaN takes part, as in any sum."""
    s, b = F.col("s").cast("double"), F.col("b").cast("double")
    d = s - b
    clean = lambda x: F.when(~F.isnan(x), F.abs(x))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(s * b).alias("dot"),
        F.sum(d * d).alias("diff2"),
        F.count_if(~F.isnan(d) & (F.abs(d) > eps)).alias("changed"),
        *[F.sum(F.pow(x, k)).alias(f"{t}{k}") for t, x in (("s", s), ("b", b)) for k in (1, 2, 3, 4)],
        F.max(clean(s)).alias("max_s"),
        F.max(clean(b)).alias("max_b"),
    )


def tensor_drift(sums: DataFrame) -> DataFrame:
    """Metrics of drift from ``pair_sums``: cosine, rel_l2, changed_frac and the deltas."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    nan0 = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.greatest(c, F.lit(0.0)))  # noqa: E731  a norm with NaN counts as none
    ss, bb = nan0(F.col("s2")), nan0(F.col("b2"))

    def moments(t: str) -> tuple:
        m = F.col(f"{t}1") / n
        m2 = F.col(f"{t}2") / n - m * m
        m4 = F.col(f"{t}4") / n - 4 * m * F.col(f"{t}3") / n + 6 * m * m * F.col(f"{t}2") / n - 3 * m * m * m * m
        return F.sqrt(F.greatest(m2, F.lit(0.0))), F.when(m2 > 0, m4 / (m2 * m2) - 3).otherwise(0.0)

    (std_s, kurt_s), (std_b, kurt_b) = moments("s"), moments("b")
    cosine = F.when((ss > 0) & (bb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot") / (F.sqrt(ss) * F.sqrt(bb))))).otherwise(1.0)
    return sums.withColumns(
        {
            "bb": bb,
            "cosine": cosine,
            "rel_l2": relative(F.col("diff2"), bb),
            "changed_frac": F.col("changed") / n,
            "delta_max_abs": F.coalesce("max_s", F.lit(0.0)) - F.coalesce("max_b", F.lit(0.0)),
            "delta_rms": F.sqrt(ss / n) - F.sqrt(bb / n),
            "delta_std": std_s - std_b,
            "delta_kurtosis": kurt_s - kurt_b,
        }
    )


def relative(diff2, bb):
    """The norm of a difference against the baseline's; infinite if only the latter is none."""
    return F.when(bb > 0, F.sqrt(diff2) / F.sqrt(bb)).when(diff2 > 0, float("inf")).otherwise(0.0)


def layer_drift(drift: DataFrame, keys: list[str], mad_k: float = 5.0, name: str = "name") -> DataFrame:
    """Drift of layers from that of tensors (name, canonical_name, diff2, bb): rel_l2, mads, severity, dominant tensor.

    Only spikes above the other layers count, in any number of layers; the
    severity follows the size of the change.
    """
    layered = drift.withColumn("layer", C.layer_index(F.col(name))).where("layer is not null")
    first = Window.partitionBy(*keys, "layer").orderBy(F.desc("diff2"), "canonical_name")
    top = layered.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*keys, "layer", F.when(F.col("diff2") > 0, F.col(name)).alias("dominant"))
    sums = layered.groupBy(*keys, "layer").agg(F.sum("diff2").alias("d2"), F.sum("bb").alias("bb"))
    points = sums.withColumn("rel_l2", relative(F.col("d2"), F.col("bb")))
    spread = stats.robust_spread(points, keys, "rel_l2") if keys else stats.robust_spread(points.withColumn("_all", F.lit(1)), ["_all"], "rel_l2").drop("_all")
    mads = F.when(F.col("mad") > K.EPSILON, (F.col("rel_l2") - F.col("med")) / F.col("mad")).otherwise(0.0)
    odd = (F.col("mads") > mad_k) & (F.col("rel_l2") > F.col("med"))
    size = F.when(F.col("rel_l2") >= 1, "high").when(F.col("rel_l2") >= 0.3, "medium").otherwise("low")
    return spread.withColumn("mads", mads).withColumn("severity", F.when(odd, size)).join(top, [*keys, "layer"]).select(*keys, "layer", "rel_l2", "mads", "severity", "dominant")


def tied(aligned: DataFrame, same: DataFrame) -> DataFrame:
    """Which tensors that one side lacks are tied to another on the side that has them.

    ``aligned`` of ``align``; ``same``: pairs (side, name, other) of tensors of
    that side with equal shape and values. The first candidate that exists
    decides. Gives canonical_name, side, name and tied_to.
    """
    spark = aligned.sparkSession
    table = spark.createDataFrame([(a, i, c) for a, cs in K.TIED.items() for i, c in enumerate(cs)], "canonical_name string, k int, candidate string")
    out = []
    for side, kind in (("s", "only_in_subject"), ("b", "only_in_baseline")):
        has = aligned.where(F.col(f"{side}_name").isNotNull()).select(F.col("canonical_name").alias("candidate"), F.col(f"{side}_name").alias("other"))
        lone = aligned.where(F.col("kind") == kind).select("canonical_name", F.col(f"{side}_name").alias("name"))
        first = Window.partitionBy("canonical_name").orderBy("k")
        out.append(lone.join(F.broadcast(table), "canonical_name").join(has, "candidate").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("canonical_name", F.lit(side).alias("side"), "name", "other"))
    found = out[0].union(out[1])
    return found.join(same, ["side", "name", "other"], "left_semi").select("canonical_name", "side", "name", F.col("other").alias("tied_to"))


def summary(drift: DataFrame, structural: DataFrame) -> DataFrame:
    """One row: matched, identical_fraction, structural, worst_drift, identical."""
    finite = F.when(~F.isnan("rel_l2"), F.col("rel_l2"))
    a = drift.agg(
        F.count(F.lit(1)).alias("matched"),
        F.coalesce(F.count_if(F.col("rel_l2") < SAME) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("identical_fraction"),
        F.greatest(F.coalesce(F.max(finite), F.lit(0.0)), F.lit(0.0)).alias("worst_drift"),
    )
    b = structural.agg(F.count(F.lit(1)).alias("structural"))
    return a.join(b).withColumn("identical", (F.col("structural") == 0) & (F.col("matched") > 0) & (F.col("worst_drift") < SAME))
