"""Streams of query clonotypes and recombination events against static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mass
from ..operators.fuzzy import fuzzy_join


def annotate_stream(queries: DataFrame, records: DataFrame, path: str, checkpoint: str, scope: str = "1"):
    """Start a query that writes each batch's hits (stream-static similarity join) as Parquet."""
    targets = records.select(F.col("gene").alias("locus"), "cdr3").distinct().cache()

    def batch(df: DataFrame, n: int) -> None:
        fuzzy_join(df, targets, scope, ["locus"]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def distinct_events(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each recombination event once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["donor", "v", "j", "junction_nt"])


def matched_events(events: DataFrame, cognate: DataFrame, radius: int = 1, time: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Windowed counts of distinct events inside the neighbourhoods of cognate CDR3s."""
    near = mass.ball(cognate, radius, keep=("epitope",)).select("epitope", F.col("member").alias("junction_aa")).distinct()
    return distinct_events(events, time, late).join(near, "junction_aa").groupBy(F.window(time, window), "epitope").count()
