"""Tables that change by commits, so that writers, retention and readers can run together.

Below a root folder every table is a folder of Parquet leaves, one for each
value of its partition columns, writer, batch and commit. A leaf counts once a
numbered manifest lists it. A change writes its leaves first and then the next
manifest, which appears in one step: readers see all tables before the change or
all after it. If another change was quicker, the list is made anew from that
one's. A batch that runs again lists its new leaves in place of its old ones.

The file system must rename in one step and not onto a file that is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Leaf:
    """A folder of rows, relative to the root, and whose they are; ``key`` is the text of its first partition column."""

    table: str
    path: str
    key: str | None
    writer: str
    batch: str


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def live_leaves(spark: SparkSession, root: str) -> tuple[int, list[Leaf]]:
    """The number of the last manifest and what it lists; 0 and nothing without one."""
    files, folder = _folder(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return 0, []
    last = max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=0)
    if not last:
        return 0, []
    stream = files.open(_folder(spark, f"{root}/{MANIFESTS}/{last}")[1])
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return last, [Leaf(**x) for x in json.loads(text)]


def commit(spark: SparkSession, root: str, change: Callable[[list[Leaf]], list[Leaf]]) -> int:
    """Make ``change`` of the live leaves the next manifest; it may be asked again with a newer list."""
    files, _ = _folder(spark, root)
    while True:
        last, leaves = live_leaves(spark, root)
        own = _folder(spark, f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")[1]
        stream = files.create(own, False)
        stream.write(bytearray(json.dumps([asdict(x) for x in change(leaves)]).encode()))
        stream.close()
        to = _folder(spark, f"{root}/{MANIFESTS}/{last + 1}")[1]
        if not files.exists(to) and files.rename(own, to):
            return last + 1
        files.delete(own, False)


def write_leaves(rows: DataFrame, root: str, table: str, partitions: list[str], writer: str | None = None, batch: str | None = None) -> list[Leaf]:
    """Write rows as leaves that do not count yet.

    Without ``writer`` the rows bring their own columns ``writer`` and ``batch_id``.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    if writer is not None:
        rows = rows.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch)})
    columns = [*partitions, "writer", "batch_id", "commit"]
    rows.withColumn("commit", F.lit(name)).write.mode("append").partitionBy(*columns).parquet(f"{root}/{table}")
    files, pattern = _folder(spark, f"{root}/{table}/{'*/' * (len(columns) - 1)}commit={name}")
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    leaves = []
    for status in files.globStatus(pattern) or []:
        steps = status.getPath().toString().split("/")[-len(columns) :]
        values = dict((unescaped(x) for x in step.split("=", 1)) for step in steps)
        key = values[partitions[0]] if partitions else None
        leaves.append(Leaf(table, f"{table}/{'/'.join(steps)}", key, values["writer"], values["batch_id"]))
    return leaves


def write_batch(root: str, tables: dict[str, tuple[DataFrame, list[str]]], writer: str, batch: int | str) -> int:
    """Write all ``tables`` (rows, partition columns) of a batch as one commit, in place of what it wrote before."""
    leaves = [x for name, (rows, columns) in tables.items() for x in write_leaves(rows, root, name, columns, writer, str(batch))]
    spark = next(iter(tables.values()))[0].sparkSession

    def change(live: list[Leaf]) -> list[Leaf]:
        return [x for x in live if x.table not in tables or (x.writer, x.batch) != (writer, str(batch))] + leaves

    return commit(spark, root, change)


def read_leaves(spark: SparkSession, root: str, leaves: list[Leaf], schema: str) -> DataFrame:
    """The rows of ``leaves`` of one table with the columns of ``schema``, partition columns among them if it names them."""
    if not leaves:
        return spark.createDataFrame([], schema)
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    rows = spark.read.schema(schema).option("basePath", f"{root}/{leaves[0].table}").parquet(*[f"{root}/{x.path}" for x in leaves])
    return rows.select(*names)


def read_table(spark: SparkSession, root: str, table: str, schema: str, where: Callable[[Leaf], bool] = lambda leaf: True) -> DataFrame:
    """The live rows of a table; only leaves for which ``where`` holds are listed and read."""
    return read_leaves(spark, root, [x for x in live_leaves(spark, root)[1] if x.table == table and where(x)], schema)
