"""Scanning artifacts as they arrive in a folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weightscope import constants as K
from weightscope.plans import report, scan


def watch(spark: SparkSession, folder: str, checkpoint: str, on_report: Callable[[report.Report], None], **options) -> StreamingQuery:
    """Scan each new artifact of ``folder`` once and hand on a report for each.

    A file stream of names drives the batch scan, one scan for all that a batch
    brings. Code, configurations and templates of the folder have their reports
    with every batch. What has been seen is in the
    stream's checkpoint, so a restart goes on where it stopped.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.{" + ",".join(K.EXTENSIONS) + "}").load(folder).select("path")

    def work(batch: DataFrame, _: int) -> None:
        new = sorted(os.path.abspath(row["path"].removeprefix("file:")) for row in batch.collect())
        if new:
            for found in report.collect(scan.run(spark, os.path.abspath(folder.removeprefix("file:")), only=new, **options)).artifacts:
                on_report(report.Report([found]))

    return names.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
