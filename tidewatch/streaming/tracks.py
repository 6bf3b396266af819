"""Extension: position feeds as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import POSITIONS

BRACKETS = "mmsi string, ts timestamp, lat double, lon double, sog_ms double, cog_deg double, next_ts timestamp, next_lat double, next_lon double, next_sog_ms double, next_cog_deg double"


def read_positions(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of positions as they arrive in a folder."""
    return spark.readStream.schema(POSITIONS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def dedup(positions: DataFrame, late: str = "11 minutes") -> DataFrame:
    """One of each (mmsi, ts, lat, lon) that comes within ``late`` of the others."""
    return positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts", "lat", "lon"])


def counts(positions: DataFrame, width: str = "10 minutes", late: str = "11 minutes") -> DataFrame:
    """Positions and vessels (approximate) by window and source; windows close once they are late."""
    w = F.window("ts", width)
    return positions.withWatermark("ts", late).groupBy(w, "source").agg(F.count(F.lit(1)).alias("positions"), F.approx_count_distinct("mmsi").alias("vessels"))


def brackets(positions: DataFrame) -> DataFrame:
    """Each report with its successor on the vessel's track; the last report of each vessel is kept as state."""
    state = "ts timestamp, lat double, lon double, sog_ms double, cog_deg double"
    columns = ["ts", "lat", "lon", "sog_ms", "cog_deg"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.DataFrame([held.get], columns=columns) if held.exists else None
        rows = pd.concat([f[columns] for f in frames]).sort_values(["ts", "lat", "lon"])
        if last is not None:
            rows = pd.concat([last, rows[rows["ts"] >= last["ts"].iloc[0]]])
        ahead = rows.shift(-1).add_prefix("next_")
        out = pd.concat([rows, ahead], axis=1).iloc[:-1]
        held.update(tuple(rows.iloc[-1]))
        out.insert(0, "mmsi", key[0])
        yield out

    return positions.groupBy("mmsi").applyInPandasWithState(run, BRACKETS, state, "append", GroupStateTimeout.NoTimeout)
