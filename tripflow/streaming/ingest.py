"""Landed collector runs to the four logs, exactly once, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tripflow.operators.live import heartbeat_rows
from tripflow.schemas import ALERT_LOG, FORECAST_LOG, HEARTBEAT_LOG, INCIDENT_LOG, RUN_RECORD
from tripflow.session import spread
from tripflow.sources.logs import append_logs, stream_id
from tripflow.sources.payloads import feature_rows, incident_rows, object_rows, parsed_runs, period_rows

LOG_SCHEMAS = {
    "forecasts": FORECAST_LOG,
    "alerts": ALERT_LOG,
    "incidents": INCIDENT_LOG,
    "heartbeats": HEARTBEAT_LOG,
}


def log_rows(records: DataFrame) -> dict[str, DataFrame]:
    """The rows a set of runs contributes to each log.

    A source that failed has an error text instead of a body: no rows, but
    still a heartbeat. Every body is parsed once, for all of them.
    """
    runs = parsed_runs(records)
    return {
        "forecasts": period_rows(runs),
        "alerts": feature_rows(runs),
        "incidents": incident_rows(object_rows(runs)),
        "heartbeats": heartbeat_rows(runs),
    }


def landed_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUN_RECORD).json(path)


def ingest_stream(runs: DataFrame, log_folder: str, checkpoint: str) -> StreamingQuery:
    """Start a run that takes everything landed so far and then stops.

    The logs of a batch appear together, in place of what an earlier try of the
    batch wrote, so a batch repeated after a failure leaves no duplicates. A
    batch of few files is dealt over all cores.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        logs = {name: (rows, LOG_SCHEMAS[name]) for name, rows in log_rows(spread(batch)).items()}
        append_logs(logs, log_folder, batch_id, stream_id(batch))

    return (
        runs.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
