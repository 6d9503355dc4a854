"""Jobs as a stream: the latest job of each session wins, with state in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session long, job long, stage string, stale boolean"


def _latest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    newest = state.get[0] if state.exists else -1
    for rows in parts:
        rows = rows.sort_values(["at", "job"])
        seen = rows["job"].cummax().clip(lower=newest)
        newest = max(newest, int(rows["job"].max()))
        yield pd.DataFrame({"session": key[0], "job": rows["job"], "stage": rows["stage"], "stale": rows["job"] < seen})
    state.update((newest,))


def supersede(stream: DataFrame) -> DataFrame:
    """(session, job, stage, at) -> each row with stale: a later job of the session was seen before it. State: one number for each session."""
    return stream.groupBy("session").applyInPandasWithState(_latest, OUT, "newest long", "append", GroupStateTimeout.NoTimeout)


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Extra: rows for each day and stage, by event time, with a watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "stage").agg(F.count("*").alias("n"))


def keep_history(stream: DataFrame, path: str, checkpoint: str, now, most: int = 12, days: int = 30):
    """Sink: each micro-batch is merged into the history at path and pruned.

    A batch writes a new version beside the last and is told apart by its number, so
    that a repeated batch does no harm.
    """
    from lumenframe.operators.jobs import newest, upserted

    def merge(rows: DataFrame, number: int) -> None:
        old = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/v{number - 1}") if number else rows.limit(0)
        newest(upserted(old, rows), now, most, days).drop("rank").write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
