"""Versioned tables in a folder: immutable segments, a log of commits, a latest-wins view.

A commit writes the rows of its batch, and no others, as Parquet into a new segment (one
folder, a subfolder a table), and then one row into the log; only with that row do all tables
of the commit become visible together. A stop before it leaves the old state as it was. Rows
carry the commit's ``version``; readers take, for each key, the rows of the greatest one.
A compaction writes what a reader sees into one segment that replaces those it read; commits
that came meanwhile stay. Commits are told by (run, batch), so that a repeated one is
skipped. The driver holds one row a segment that no compaction has replaced.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "version long, run string, batch long, segment string, tables array<string>, replaces array<string>"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:  # nothing was committed yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


@dataclass(frozen=True)
class Snapshot:
    """The state of a store at one moment; later commits don't change what it reads."""

    spark: SparkSession
    path: str
    segments: list[tuple[str, list[str]]]
    version: int

    def table(self, name: str) -> DataFrame | None:
        """All rows of a table, superseded ones too; null where an old segment lacks a column."""
        folders = [f"{self.path}/segments/{segment}/{name}" for segment, tables in self.segments if name in tables]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def latest(self, name: str, *keys: str) -> DataFrame | None:
        """One row a key: the newest, with its ``version``."""
        rows = self.table(name)
        if rows is None:
            return None
        others = [c for c in rows.columns if c not in (*keys, "version")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("newest"), F.max("version").alias("version")).select(*keys, "newest.*", "version")


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    log = _log(spark, path)
    live = log.join(log.select(F.explode("replaces").alias("segment")), "segment", "left_anti")
    rows = sorted(live.select("version", "segment", "tables").collect())
    return Snapshot(spark, path, [(segment, tables) for _, segment, tables in rows], rows[-1][0] if rows else 0)


def is_committed(spark: SparkSession, path: str, run: str, batch: int) -> bool:
    return not _log(spark, path).where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty()


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], run: str | None = None, batch: int = 0, replaces: list[str] = ()) -> int | None:
    """Write ``tables`` as one version; its number, or None if (run, batch) is there already.

    Rows that have a ``version`` keep it. Versions are microseconds, and above all before them.
    """
    if run is not None and is_committed(spark, path, run, batch):
        return None
    last = _log(spark, path).agg(F.max("version")).first()[0] or 0
    version, segment = max(last + 1, time.time_ns() // 1000), uuid.uuid4().hex
    for name, rows in tables.items():
        rows = rows if "version" in rows.columns else rows.withColumn("version", F.lit(version).cast("long"))
        rows.write.option("compression", "zstd").parquet(f"{path}/segments/{segment}/{name}")
    row = spark.createDataFrame([(version, run or segment, batch, segment, list(tables), list(replaces))], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def compact(spark: SparkSession, path: str, current: Callable[[Snapshot], dict[str, DataFrame | None]]) -> int | None:
    """One segment with the ``current`` rows of a snapshot's tables in place of all that it has.
    The rows must bring their versions, so that commits which come meanwhile still count after."""
    now = snapshot(spark, path)
    if len(now.segments) < 2:
        return None
    tables = {name: rows for name, rows in current(now).items() if rows is not None}
    if bare := [name for name, rows in tables.items() if "version" not in rows.columns]:
        raise ValueError(f"rows without a version: {', '.join(bare)}")
    return commit(spark, path, tables, replaces=[segment for segment, _ in now.segments])


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete replaced segments. Snapshots from before the compaction can't be read afterwards."""
    for row in _log(spark, path).select(F.explode("replaces").alias("segment")).distinct().toLocalIterator():
        delete_folder(spark, f"{path}/segments/{row['segment']}")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Graph:
    """What a snapshot holds of the papers' graphs; deleted documents are not in it."""

    at: Snapshot

    @cached_property
    def _marked(self) -> DataFrame | None:
        """Every version of every document, with the newest one's number."""
        rows = self.at.table("documents")
        return None if rows is None else rows.withColumn("newest", F.max("version").over(Window.partitionBy("doc_id")))

    def _current(self, name: str) -> DataFrame | None:
        rows = self.at.table(name)
        if rows is None:
            return None
        # sorted ids take next to no bytes in a file: by its size Spark would send millions of them through the driver
        old = self._marked.where("version < newest").select("doc_id", "version")
        return rows.join(old.hint("merge"), ["doc_id", "version"], "left_anti")

    @property
    def documents(self) -> DataFrame | None:
        """doc_id, doc_key, status, version."""
        rows = self._marked
        return None if rows is None else rows.where("version = newest and status != 'deleted'").drop("newest")

    @property
    def nodes(self) -> DataFrame | None:
        return self._current("nodes")

    @property
    def edges(self) -> DataFrame | None:
        return self._current("edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(snapshot(spark, path))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, documents: DataFrame | None = None, run: str | None = None, batch: int = 0) -> int | None:
    """Replace whole documents: those of ``documents`` (doc_id, doc_key), or all that have a
    row here. Only these rows are written, by as many tasks as they come in."""
    if documents is None:
        documents = nodes.select("doc_id").unionByName(edges.select("doc_id")).distinct().withColumn("doc_key", F.col("doc_id").cast("string"))
    ready = documents.select("doc_id", "doc_key", F.lit("ready").alias("status"))
    return commit(nodes.sparkSession, path, {"documents": ready, "nodes": nodes, "edges": edges}, run, batch)


def delete_from_graph(ids: DataFrame, path: str, run: str | None = None, batch: int = 0) -> int | None:
    """A tombstone for each document listed (doc_id) that the store has; unknown ids do nothing."""
    spark = ids.sparkSession
    known = read_graph(spark, path).documents
    if known is None:
        return None
    gone = known.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "doc_key", F.lit("deleted").alias("status"))
    return commit(spark, path, {"documents": gone}, run, batch)


def compact_graph(spark: SparkSession, path: str) -> int | None:
    """One segment in the order of documents in place of all; old versions, deleted documents
    and their tombstones go. Rows keep their versions."""
    dealt = lambda rows, *by: rows.repartitionByRange(*by).sortWithinPartitions(*by)

    def current(now: Snapshot) -> dict[str, DataFrame | None]:
        graph = Graph(now)
        tables = {"documents": dealt(graph.documents, "doc_id")}
        for name, rows, also in (("nodes", graph.nodes, "node_ord"), ("edges", graph.edges, "target_anchor")):
            if rows is not None:
                tables[name] = dealt(rows, "doc_id", *[c for c in (also,) if c in rows.columns])
        return tables

    return compact(spark, path, current)
