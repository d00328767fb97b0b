"""Raw request bodies to results, rejects and unscored trips, as one job.

Each micro-batch parses its bodies once. What is accepted is scored and written
in one pass, dealt into trips with a result and trips no station was in reach
of; what is refused is written with the reason. The three appear as one commit,
so no reader sees a batch in part, and a batch that runs again replaces what an
earlier try left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripflow.operators.nearest_station import StationIndex
from tripflow.plans.trips import score_trips, trip_records
from tripflow.schemas import REJECT_RECORD, REQUEST_BODY, TRIP_RECORD
from tripflow.session import spread
from tripflow.sources.commits import read_table, write_batch
from tripflow.sources.logs import stream_id
from tripflow.sources.requests import parse_requests

TRIPS, REJECTS = "trips", "rejects"


def landed_bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_BODY).json(path)


def serve_requests(
    bodies: DataFrame,
    stations: StationIndex,
    root: str,
    checkpoint: str,
    forecast_log: Callable[[], DataFrame] | None = None,
    incident_log: Callable[[], DataFrame] | None = None,
    routes: Callable[[], DataFrame] | None = None,
    region: str = "UTC",
    model: str | None = None,
) -> StreamingQuery:
    """Answer all requests landed so far and stop; tables lie below ``root``.

    Logs and routes are read anew for every batch. Streams may share a root.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_requests(spread(batch)).persist()
        try:
            trips = score_trips(
                parsed.where("reason is null").drop("reason"),
                stations,
                forecast_log() if forecast_log else None,
                incident_log() if incident_log else None,
                routes() if routes else None,
                region=region,
            )
            records = trip_records(trips, model)
            scored = F.col("speed.probability_after_all_adjustments").isNotNull()
            rejects = parsed.where("reason is not null").select("trip_id", "request_ts", "reason")
            tables = {TRIPS: (records.withColumn("scored", scored), ["scored"]), REJECTS: (rejects, [])}
            write_batch(root, tables, stream_id(batch), batch_id)
        finally:
            parsed.unpersist()

    started = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).start()


def results(spark: SparkSession, root: str) -> DataFrame:
    """Trips with a probability and an ETA."""
    return read_table(spark, root, TRIPS, TRIP_RECORD, lambda leaf: leaf.key == "true")


def unscored(spark: SparkSession, root: str) -> DataFrame:
    """Accepted trips that no station was in reach of."""
    return read_table(spark, root, TRIPS, TRIP_RECORD, lambda leaf: leaf.key == "false")


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """Requests that were refused, with the reason."""
    return read_table(spark, root, REJECTS, REJECT_RECORD)
