"""Byte accounting: every byte of a container must belong to a tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C


def unclaimed(intervals: DataFrame, sizes: DataFrame, key: str = "artifact") -> DataFrame:
    """Regions (key, begin, len, placement, idx) that no interval (key, name, begin, end) covers.

    ``sizes``: key and seg_len of every container; one without intervals is one
    region. Regions are numbered from 0 by place.
    """
    before = Window.partitionBy(key).orderBy("begin", "name").rowsBetween(Window.unboundedPreceding, -1)
    gaps = intervals.withColumn("_cursor", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("begin") > F.col("_cursor"))
    gaps = gaps.select(key, F.col("_cursor").alias("begin"), (F.col("begin") - F.col("_cursor")).alias("len"))
    ends = intervals.groupBy(key).agg(F.max("end").alias("_end"))
    tails = sizes.join(ends, key, "left").withColumn("_end", F.coalesce("_end", F.lit(0))).where(F.col("seg_len") > F.col("_end"))
    tails = tails.select(key, F.col("_end").alias("begin"), (F.col("seg_len") - F.col("_end")).alias("len"))
    regions = gaps.union(tails).join(sizes.select(key, "seg_len"), key)
    place = F.when(F.col("begin") + F.col("len") == F.col("seg_len"), "after the last tensor").otherwise("between tensors")
    number = F.row_number().over(Window.partitionBy(key).orderBy("begin")) - 1
    return regions.select(key, "begin", "len", place.alias("placement"), number.alias("idx"))


def overlaps(intervals: DataFrame, key: str = "artifact") -> DataFrame:
    """Neighbours by begin (key, name_a, end_a, name_b, begin_b) that overlap."""
    w = Window.partitionBy(key).orderBy("begin", "name")
    pairs = intervals.withColumns({"end_a": F.lag("end").over(w), "name_a": F.lag("name").over(w)})
    return pairs.where(F.col("begin") < F.col("end_a")).select(key, "name_a", "end_a", F.col("name").alias("name_b"), F.col("begin").alias("begin_b"))


def judge_regions(regions: DataFrame) -> DataFrame:
    """Severity of safetensors regions from all_zero and magic (what the bytes begin, or null)."""
    return regions.withColumn("severity", F.when(F.col("all_zero"), "low").when(F.col("magic").isNotNull(), "high").otherwise("medium"))


def cap_regions(judged: DataFrame, key: str = "artifact", most: int = K.MAX_REGIONS) -> tuple[DataFrame, DataFrame]:
    """The regions that are listed, and (key, hidden, hidden_bytes) where more than that many hide bytes."""
    hidden = judged.where(~F.col("all_zero")).groupBy(key).agg(F.count(F.lit(1)).alias("hidden"), F.sum("len").alias("hidden_bytes"))
    return judged.where(F.col("idx") < most), hidden.where(F.col("hidden") > most)


def ggml_table(spark) -> DataFrame:
    """The block types, a table of two dozen rows."""
    return spark.createDataFrame(K.GGML_TYPES, "type_id int, type_name string, decode string, block_elements int, block_bytes int")


def byte_lengths(tensors: DataFrame) -> DataFrame:
    """GGUF tensors (type_id, dims) with type_name, decode and byte_len; null where the layout isn't known."""
    joined = tensors.join(F.broadcast(ggml_table(tensors.sparkSession)), "type_id", "left")
    n = F.aggregate("dims", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    even = n % F.col("block_elements") == 0
    return joined.withColumns(
        {
            "type_name": F.coalesce("type_name", F.lit("UNKNOWN")),
            "byte_len": F.when(even, (n / F.col("block_elements") * F.col("block_bytes"))).cast("bigint"),
        }
    )


def contradictions(sized: DataFrame, sizes: DataFrame, key: str = "artifact") -> DataFrame:
    """GGUF tensors (key, name, offset, byte_len, ord) whose computed size runs into the next one or past the end.

    Gives key, name, offset, byte_len, next_name (null for the end) and ord.
    """
    w = Window.partitionBy(key).orderBy("offset", "ord")
    ahead = sized.withColumns({"next_offset": F.lead("offset").over(w), "next_name": F.lead("name").over(w)}).join(sizes.select(key, "seg_len"), key)
    limit = F.coalesce("next_offset", "seg_len")
    return ahead.where(F.col("offset") + F.col("byte_len") > limit).select(key, "name", "offset", "byte_len", "next_name", "next_offset", "ord")


def judge_gguf_regions(regions: DataFrame) -> DataFrame:
    """Severity of GGUF regions from all_zero, magic, len and alignment; rows of plain padding go."""
    kept = regions.where(~(F.col("all_zero") & (F.col("len") < F.greatest(F.col("alignment"), F.lit(1)))))
    return kept.withColumn("severity", F.when(F.col("magic").isNotNull(), "high").when(F.col("all_zero"), "low").otherwise("medium"))


def available(tensors: DataFrame, sizes: DataFrame, key: str = "artifact") -> DataFrame:
    """GGUF tensors with avail_len: bytes up to the next larger offset, or the segment's end."""
    w = Window.partitionBy(key).orderBy("offset", "ord")
    return tensors.withColumn("_next", F.lead("offset").over(w)).join(sizes.select(key, "seg_len"), key).withColumn("avail_len", F.greatest(F.coalesce("_next", "seg_len") - F.col("offset"), F.lit(0))).drop("_next", "seg_len")


def check_specs(tensors: DataFrame) -> DataFrame:
    """Status of safetensors specs (dtype, shape, begin, end, seg_len): the first check that fails.

    ok, reversed, out_of_bounds, size_mismatch or unknown_dtype; expected is
    the size that dtype and shape imply, an empty shape or a zero counting as 1.
    """
    spark = tensors.sparkSession
    table = spark.createDataFrame(list(K.DTYPE_SIZES.items()), "dtype string, elem_bytes int")
    n = F.aggregate("shape", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    sized = tensors.join(F.broadcast(table), "dtype", "left").withColumn("expected", F.greatest(n, F.lit(1).cast("decimal(38,0)")) * F.col("elem_bytes"))
    status = (
        F.when(F.col("begin") > F.col("end"), "reversed")
        .when(F.col("end") > F.col("seg_len"), "out_of_bounds")
        .when(F.col("elem_bytes").isNull(), "unknown_dtype")
        .when(F.col("expected") != F.col("end") - F.col("begin"), "size_mismatch")
        .otherwise("ok")
    )
    return sized.withColumn("status", status)


def aligned_start(info_end, alignment):
    """Where tensor data starts behind the header."""
    return C.align_up(info_end, alignment)
