"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash. A bucket that holds more
than its bytes is split on the next bit, others stay as they are, so buckets
have depths of their own and every shard fits the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import boxed, new_path, stored

LIMIT = 64 << 20  # bytes of text in a shard
WORD = 60  # bits in each of the hash's three numbers
FIRST, NEXT, MOST = 3, 8, 20  # bits that a round adds: beyond the expected depth, later, and at most


def _word(text: Column) -> Column:
    """60 leading bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_h`` (three numbers of 60 bits) and ``_bytes``.

    The first number is of the doc_id; the second, of the text, parts rows of
    one doc_id; the third, of the row's place in the table, parts equal rows.
    """
    return docs.withColumns(
        {
            "_h": F.array(
                _word(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
                _word(F.coalesce(text, F.lit(""))),
                _word(F.monotonically_increasing_id().cast("string")),
            ),
            "_bytes": F.octet_length(F.coalesce(text, F.lit(""))).cast("long"),
        }
    )


def _prefix(depth: int) -> Column:
    """The leading ``depth`` bits of ``_h`` as a string of 0 and 1."""
    out, left = [], depth
    for i in range(3):
        n = min(WORD, left)
        left -= n
        if n:
            out.append(F.lpad(F.bin(F.shiftright(F.col("_h")[i], WORD - n)), n, "0"))
    return F.concat(*out) if out else F.lit("")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Rounds of the directory: how many bits index it, and a table (_key, shard, depth, shard_bytes, shard_rows).

    Each round makes a histogram of as many leading bits as it should need, sums
    it for every depth, and gives each entry the least depth at which its
    bucket fits, which is where splitting bit by bit would have stopped. Rows
    in entries that don't fit at the round's full depth go on to the next; one
    row is never split.
    """
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    done, depth, out = 0, min(MOST, max(1, (total // limit).bit_length() + FIRST)), []
    while True:
        cells = stored(rows.groupBy(_prefix(depth).alias("_key")).agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "cells")
        levels = cells.select("_key", "bytes", "n", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("depth"))
        buckets = levels.groupBy("depth", F.expr("substring(_key, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
        entries = levels.select("_key", "depth", F.expr("substring(_key, 1, depth)").alias("shard")).join(fits, ["depth", "shard"])
        best = entries.groupBy("_key").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("e")).select("_key", "e.shard", "e.depth", "e.shard_bytes", "e.shard_rows")
        best = stored(best, "directory")
        out.append((depth, best))
        if depth >= 3 * WORD or best.count() == cells.count():
            return out
        rows = rows.withColumn("_key", _prefix(depth)).join(best.select("_key"), "_key", "left_anti").drop("_key")
        done, depth = depth, min(3 * WORD, depth + NEXT)


def assign(rows: DataFrame, rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` of ``hashed`` with shard, depth, shard_bytes and shard_rows."""
    kept = rows.columns
    for k, (bits, table) in enumerate(rounds):
        rows = rows.withColumn("_key", _prefix(bits)).join(table.withColumnsRenamed({c: f"_{c}{k}" for c in ("shard", "depth", "shard_bytes", "shard_rows")}), "_key", "left").drop("_key")
    pick = lambda c: reduce(lambda a, b: F.coalesce(a, b), [F.col(f"_{c}{k}") for k in range(len(rounds))]).alias(c)
    return rows.select(*kept, pick("shard"), pick("depth"), pick("shard_bytes"), pick("shard_rows"))


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Which shard each row of ``docs`` (doc_id, text) goes to.

    Returns a row per row: doc_id, doc_bytes, shard (the bucket's hash prefix,
    '' if one shard holds all), depth, shard_bytes, shard_rows. A null text has
    no bytes, a null doc_id hashes as the empty string; rows that repeat are
    parted by their texts and then their places, so no key is too hot to split;
    a text longer than the limit gets a shard of its own. An empty table gives
    an empty one. Other columns are ignored.

    Only hashes and sizes move; the histogram has some eight entries a shard.
    """
    rows = stored(hashed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "_h", "_bytes"), "sizes")
    placed = assign(rows, directory(rows, limit))
    return placed.select("doc_id", F.col("_bytes").alias("doc_bytes"), "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> str:
    """Write ``docs`` with all its columns, a folder ``shard=...`` of Parquet a shard; returns the path.

    The column ``shard`` is the writer's: one of that name in ``docs`` is
    replaced. Rows are hashed once and stored, since the place that parts equal
    rows may be another when it is computed again; then one shuffle deals them
    out. Nulls, repeated rows and empty tables as in ``shard_documents``.
    """
    path = path or new_path(docs.sparkSession, "shards")
    kept = docs.drop("shard")
    inner, text = boxed(kept)
    rows = stored(hashed(inner, f"c{kept.columns.index('doc_id')}", text), "hashed")
    placed = assign(rows, directory(rows.select("_h", "_bytes"), limit))
    placed = placed.select(*inner.columns, F.concat(F.lit("b"), "shard").alias("shard")).toDF(*kept.columns, "shard")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    return path


ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS b,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
buckets AS (
  SELECT 0 AS depth, 0::BIGINT AS p, sum(b)::BIGINT AS bytes, count(*) AS n FROM rows
  UNION ALL
  SELECT u.depth + 1, r.h >> (59 - u.depth), sum(r.b)::BIGINT, count(*)
  FROM buckets u JOIN rows r ON (r.h >> (60 - u.depth)) = u.p
  WHERE u.bytes > {LIMIT} AND u.n > 1 AND u.depth < 60
  GROUP BY u.depth, r.h >> (59 - u.depth))
SELECT r.doc_id, r.b AS doc_bytes,
       CASE WHEN u.depth = 0 THEN '' ELSE right(lpad(bin(u.p), 60, '0'), u.depth) END AS shard,
       u.depth, u.bytes AS shard_bytes, u.n AS shard_rows
FROM rows r JOIN buckets u ON (r.h >> (60 - u.depth)) = u.p
WHERE u.bytes <= {LIMIT} OR u.n <= 1
"""
