"""Continuous trip scoring: a stream of requests against the current logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripflow.operators.nearest_station import StationIndex
from tripflow.plans.trips import score_trips, trip_records
from tripflow.session import spread
from tripflow.sources.logs import replace_batch, stream_id
from tripflow.streaming.live_state import LiveState


def score_stream(
    requests: DataFrame,
    stations: StationIndex,
    results: str,
    checkpoint: str,
    forecast_log: Callable[[], DataFrame] | None = None,
    incident_log: Callable[[], DataFrame] | None = None,
    region: str = "UTC",
    routes: Callable[[], DataFrame] | None = None,
    live: Callable[[], LiveState] | None = None,
) -> StreamingQuery:
    """Score all requests available now and append the result records.

    The station index is built once. Logs and routes are read anew for every
    batch, so each batch sees the live state of its time; with ``live``, a
    refresh of the kept state, a batch reads only what the logs got since. A repeated batch
    replaces its own partition, and streams may share a result folder. A batch of
    few files is dealt over all cores.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        state = live() if live else None
        trips = score_trips(
            spread(batch),
            stations,
            forecast_log() if forecast_log else None,
            incident_log() if incident_log else None,
            routes() if routes else None,
            region=region,
            live=(state.moments, state.summary) if state else None,
        )
        records = trip_records(trips).withColumns({"writer": F.lit(stream_id(batch)), "batch_id": F.lit(batch_id)})
        replace_batch(records, results, ["writer", "batch_id"])

    return (
        requests.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
