"""What trips need of the live logs, kept up from new log folders only.

The state holds one row per forecast moment (the newest copy of it), the
incident counts, and which folders of the logs it has taken in. A refresh reads
the folders that the logs' manifest lists and the state does not know, merges
them and commits the result as one change. If a folder it has taken in is gone,
because retention cut it or a batch replaced it, the state is made anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.operators.live import forecast_moments, incident_summary
from tripflow.schemas import FORECAST_LOG, INCIDENT_LOG
from tripflow.sources.commits import Leaf, live_leaves, read_leaves, read_table, write_batch

FORECASTS, INCIDENTS = "forecasts", "incidents"
MOMENTS = "at long, row struct<_newest: timestamp, description: string, bump: double>"
SUMMARY = "events long, any_lane boolean, two_lanes boolean"


@dataclass(frozen=True)
class LiveState:
    """``moments`` and the one-row ``summary`` of the logs; ``taken`` are the log folders that this refresh read."""

    moments: DataFrame
    summary: DataFrame
    taken: list[str]


def _log_rows(spark: SparkSession, logs: str, leaves: list[Leaf]) -> tuple[DataFrame, DataFrame]:
    forecasts = read_leaves(spark, logs, [x for x in leaves if x.table == FORECASTS], FORECAST_LOG)
    incidents = read_leaves(spark, logs, [x for x in leaves if x.table == INCIDENTS], INCIDENT_LOG)
    return forecast_moments(forecasts), incident_summary(incidents)


def refresh_live_state(spark: SparkSession, logs: str, root: str) -> LiveState:
    """The state of the logs below ``logs`` as they are now, kept in tables below ``root``."""
    listed = {x.path: x for x in live_leaves(spark, logs)[1] if x.table in (FORECASTS, INCIDENTS)}
    known = {r["path"] for r in read_table(spark, root, "taken", "path string").collect()}
    fresh = known <= set(listed)
    new = [x for path, x in listed.items() if not fresh or path not in known]
    moments, summary = read_table(spark, root, "moments", MOMENTS), read_table(spark, root, "summary", SUMMARY)
    if fresh and known and not new:
        return LiveState(moments, summary, [])
    more_moments, more_summary = _log_rows(spark, logs, new)
    if fresh and known:
        more_moments = moments.unionByName(more_moments).groupBy("at").agg(F.max("row").alias("row"))
        both = summary.unionByName(more_summary)
        more_summary = both.agg(*[f.alias(c) for f, c in ((F.sum("events"), "events"), (F.bool_or("any_lane"), "any_lane"), (F.bool_or("two_lanes"), "two_lanes"))])
    taken = spark.createDataFrame([(p,) for p in sorted(listed)], "path string")
    write_batch(root, {"moments": (more_moments, []), "summary": (more_summary, []), "taken": (taken, [])}, "state", "live")
    moments, summary = read_table(spark, root, "moments", MOMENTS), read_table(spark, root, "summary", SUMMARY)
    return LiveState(moments, summary, [x.path for x in new])
