"""ST1 as a stream: each finding's run days, kept by key across micro-batches.

Input rows are (kb, path, message, run, day); a run's rows arrive together or
later than the ones before. A finding that misses a run loses its clock: the
state holds the last run, and a gap in the run numbers starts it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.operators.state import ESCALATE, KEEP_DAYS
from lectern.session import ship

STATE = "run long, days array<string>"
OUT = "kb string, path string, message string, run long, days array<string>, escalated boolean"


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    run, days = (state.get[0], list(state.get[1])) if state.exists else (None, [])
    rows = pd.concat(list(frames)).sort_values(["run", "day"])
    for number, day in rows[["run", "day"]].drop_duplicates().itertuples(index=False):
        if run is not None and number > run + 1:
            days = []
        if day not in days:
            days = [*days, day][-KEEP_DAYS:]
        run = int(number)
    state.update((run, days))
    yield pd.DataFrame({"kb": [key[0]], "path": [key[1]], "message": [key[2]], "run": [run], "days": [days], "escalated": [len(days) >= ESCALATE]})


def finding_clock(findings: DataFrame) -> DataFrame:
    """The clock of every finding after each micro-batch, as an update stream."""
    ship(findings.sparkSession)
    return findings.groupBy("kb", "path", "message").applyInPandasWithState(_advance, OUT, STATE, "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Findings a window and kind, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))


def refresh_stream(spark, root: str) -> DataFrame:
    """ST8: new or changed files of a folder as a stream of (path, modified)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"))
