"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope.sources.tables import HOT_SHARE, join_hot, new_path, stored

__all__ = ["boxed", "join_hot", "join_salted", "map_batches", "Memo", "new_path", "pieces", "short_batches", "stored"]

#: Rows in one Arrow batch. Texts are long, so a batch is kept short: its
#: memory is this many times the mean text, not 10,000 times.
ARROW_ROWS = 512

#: Entries that a worker's memo of distinct words may hold before it starts
#: anew. About 100 to 200 bytes an entry.
MEMO_ENTRIES = 300_000


#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def join_salted(left: DataFrame, right: DataFrame, key: str, count: str, by: str) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row a key and in ``count`` the rows of ``left`` that have it.

    For rows too large to be handled twice: a key with over one in
    ``HOT_SHARE`` of the rows that ``right`` counts is dealt out by column
    ``by`` to ``SALTS`` parts, each with a copy of its row of ``right``, so that
    one shuffle is even. Which keys those are is broadcast: fewer than
    ``HOT_SHARE``. Adds no columns but those of ``right`` without ``count``.
    """
    most = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] // HOT_SHARE
    hot = right.where(F.col(count) > max(1, most)).select(key, F.lit(True).alias("_hot"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.col(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col(count) > max(1, most), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(salts)), [key, "_salt"], "left").drop("_salt", "_hot", count)


def boxed(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with its columns named c0, c1 and so on, and what ``text`` is called there.

    Columns that an operator adds for itself then clash with none of the
    caller's, whatever those are called; ``toDF`` gives the names back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{df.columns.index(text)}"


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on single batches, in short batches."""
    short_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


class Memo:
    """Values of distinct words, in a dict that starts anew when it is full."""

    def __init__(self, fill: Callable[[list], list], entries: int = MEMO_ENTRIES):
        self.fill, self.entries = fill, entries
        self.known: dict = {}  # a plain dict: sets subtract nothing else fast

    def learn(self, words: Iterable) -> None:
        """Make sure that every one of ``words`` is held."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.entries:
            self.known.clear()
            new = set(words)
        if new:
            new = list(new)
            self.known.update(zip(new, self.fill(new), strict=True))


def pieces(texts: list, most: int = 1 << 20) -> Iterator[range]:
    """Runs of positions in ``texts`` with about ``most`` characters each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
