"""Append-only log tables (parquet, partitioned by snapshot day) and result tables.

A log is a table below a root folder that takes changes by commits, so streams
can append to it, a batch that runs again can replace its rows, and retention
can drop days, all at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.sources.commits import Leaf, commit, live_leaves, read_leaves, read_table, write_batch, write_leaves

DAY = "snapshot_date"


def _fields(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def to_log(df: DataFrame, schema: str) -> DataFrame:
    """Fixed column order; columns the rows do not have are null, extra ones dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in _fields(schema)
        ]
    )


def _place(path: str) -> tuple[str, str]:
    """Root folder and table of a log's path."""
    root, _, table = path.rstrip("/").rpartition("/")
    return root, table


def read_log(spark: SparkSession, path: str, schema: str, since=None) -> DataFrame:
    """The log at ``path``; an empty table when nothing was written there yet.

    With ``since``, a timestamp, folders of days before it are not read; its own
    day is read whole.
    """
    root, table = _place(path)
    if since is None:
        return read_table(spark, root, table, schema)
    day = spark.range(1).select(F.to_date(since).cast("string")).first()[0]
    return read_table(spark, root, table, schema, lambda leaf: leaf.key >= day and leaf.key[0].isdigit())


def append_logs(logs: dict[str, tuple[DataFrame, str]], root: str, batch_id: int | None = None, writer: str = "stream") -> None:
    """Append rows to several logs below ``root``, (rows, schema) by name, as one commit.

    A streaming batch passes its id and its stream's: a batch that is run again
    after a failure replaces its first try and no other stream's rows, whatever
    retention did meanwhile. Without a batch id rows are added beside those there.
    """
    if batch_id is None:
        writer, batch_id = "append", uuid.uuid4().hex
    tables = {name: (to_log(rows, schema).withColumn(DAY, F.to_date("snapshot_utc")), [DAY]) for name, (rows, schema) in logs.items()}
    write_batch(root, tables, writer, batch_id)


def append_log(df: DataFrame, path: str, schema: str, batch_id: int | None = None, writer: str = "stream") -> None:
    """Append rows to one log."""
    root, table = _place(path)
    append_logs({table: (df, schema)}, root, batch_id, writer)


def replace_batch(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write ``rows``, in place of what their partitions held."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def stream_id(batch: DataFrame) -> str:
    """The id of the stream whose batch function is running; it is kept in the stream's checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def union_logs(*parts: DataFrame) -> DataFrame:
    """Append by column name; columns a part does not have become null."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def keep_recent(df: DataFrame, ts: str, now, days: int = 90) -> DataFrame:
    """Rows of the last ``days`` days; rows whose time does not parse are dropped.

    ``now`` is a timestamp literal or column. Comparing the bare column keeps
    the filter pushable to the scan.
    """
    if isinstance(df.schema[ts].dataType, T.StringType):
        moment = F.try_to_timestamp(F.col(ts))
    else:
        moment = F.col(ts)
    return df.where(moment >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def prune_log(spark: SparkSession, path: str, schema: str, now, days: int = 90, before_commit: Callable[[], None] | None = None) -> None:
    """Keep the last ``days`` days of a log; rows without a day go.

    Days before the cutoff are dropped from the manifest, days after it are left
    as they are, and only the cutoff's own day is written anew. Its rows stay
    with their writers and batches. What other writers commit meanwhile stays,
    too; rows of theirs that are too old go next time. ``before_commit`` is
    called when everything is written.
    """
    root, table = _place(path)
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    day = spark.range(1).select(F.to_date(cutoff).cast("string")).first()[0]
    own = [x for x in live_leaves(spark, root)[1] if x.table == table]
    cut = [x for x in own if x.key == day]
    old = {x.path for x in own if x.key < day or not x.key[0].isdigit()}
    rows = read_leaves(spark, root, cut, f"{schema}, {DAY} date, writer string, batch_id string")
    kept = write_leaves(keep_recent(rows, "snapshot_utc", now, days), root, table, [DAY]) if cut else []
    parts: dict[tuple[str, str], list[Leaf]] = {}
    for x in cut:
        parts.setdefault((x.writer, x.batch), []).append(x)

    def change(live: list[Leaf]) -> list[Leaf]:
        there = {x.path for x in live}
        # a part that was replaced since is no longer what was read
        still = {k for k, xs in parts.items() if all(x.path in there for x in xs)}
        gone = old | {x.path for k in still for x in parts[k]}
        return [x for x in live if x.path not in gone] + [x for x in kept if (x.writer, x.batch) in still]

    if before_commit:
        before_commit()
    commit(spark, root, change)


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Nested trip result records as parquet or JSON lines."""
    results.write.mode(mode).format(fmt).save(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """A one-row JSON table: the feature contract, the metrics."""
    line = spark.createDataFrame([(json.dumps(record),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict(recursive=True)
