"""Incremental intake of candidate points.

Points of a stream are checked against static targets in every micro-batch; what
stands is added to a table of occupied places that the next batch is checked
against.  The batch counterpart is ``plans.placement.plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import geometry as G
from ..operators import grid, planning, rules


def stream_checks(points: DataFrame, targets: DataFrame, rule_rows: DataFrame, out: str, checkpoint: str, spacing: float) -> StreamingQuery:
    """Append decided points (id, plant_type, x, y, status) to the Parquet folder ``out``.

    A batch is written under its number, so a batch that is run again after a
    failure replaces itself.
    """

    def intake(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = planning.pack(batch.select("id", "plant_type", "x", "y"), spacing)
        decided = rules.decisions(rules.point_checks(own, rule_rows, targets)).join(own.select("id", "x", "y"), "id").select("id", "plant_type", "x", "y", "status")
        try:
            earlier = spark.read.parquet(out).filter(F.col("batch") < number).filter("status <> 'rejected'")
            taken = earlier.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
            free = grid.semi_within(decided, taken, spacing, anti=True)
        except Exception as first:  # the folder appears with the first batch
            if "PATH_NOT_FOUND" not in str(first) and "UNABLE_TO_INFER" not in str(first):
                raise
            free = decided
        free.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(intake).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tile_counts(points: DataFrame, size: float, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of stream points (ts, x, y) per tile and time window, with a watermark."""
    at = points.withWatermark("ts", delay).withColumn("i", G.cell(F.col("x"), size)).withColumn("j", G.cell(F.col("y"), size))
    return at.groupBy(F.window("ts", window), "i", "j").agg(F.count(F.lit(1)).alias("n"))
