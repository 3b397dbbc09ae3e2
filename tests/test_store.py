"""The versioned store: commits, views, compaction, tombstones, streams into it."""

import os

import pytest
from pyspark.sql import functions as F

from papergraph.sources import store
from papergraph.streaming import jobs

NODE, EDGE, DOC = "doc_id long, node_ord long, kind string", "doc_id long, target_anchor string", "doc_id long, doc_key string"


def graph_of(spark, ids, tag, n=2):
    nodes = spark.createDataFrame([(i, k, tag) for i in ids for k in range(n)], NODE)
    return nodes, spark.createDataFrame([(i, tag) for i in ids], EDGE), spark.createDataFrame([(i, f"k{i}") for i in ids], DOC)


def state(spark, path):
    g = store.read_graph(spark, path)
    kinds = sorted((r["doc_id"], r["kind"], r["count"]) for r in g.nodes.groupBy("doc_id", "kind").count().collect())
    return kinds, sorted((r["doc_id"], r["target_anchor"]) for r in g.edges.collect()), sorted(r["doc_key"] for r in g.documents.collect())


def rows_written(spark, path):
    """Rows of each segment and table, oldest first."""
    return [{name: spark.read.parquet(f"{path}/segments/{segment}/{name}").count() for name in tables} for segment, tables in store.snapshot(spark, path).segments]


def test_overlapping_commits_write_their_batch_and_replace_whole_documents(spark, tmp_path):
    path = str(tmp_path)
    assert store.read_graph(spark, path).nodes is None and store.compact_graph(spark, path) is None
    assert store.delete_from_graph(spark.createDataFrame([(1,)], "doc_id long"), path) is None
    store.write_graph(*graph_of(spark, range(50), "a")[:2], path)
    n, e, d = graph_of(spark, [3, 4], "b", n=1)
    store.write_graph(n, e.where("doc_id = 3"), path, d)
    assert rows_written(spark, path) == [{"documents": 50, "nodes": 100, "edges": 50}, {"documents": 2, "nodes": 2, "edges": 1}]
    kinds, edges, _ = state(spark, path)
    assert [k for k in kinds if k[0] in (2, 3, 4)] == [(2, "a", 2), (3, "b", 1), (4, "b", 1)]
    assert [x for x in edges if x[0] in (2, 3, 4)] == [(2, "a"), (3, "b")]
    # a document that has nothing any more is empty, not old
    store.write_graph(n.limit(0), e.limit(0), path, d.where("doc_id = 4"))
    assert not [k for k in state(spark, path)[0] if k[0] == 4] and "k4" in state(spark, path)[2]


def test_nothing_shows_before_the_log_and_a_repeat_is_skipped(spark, tmp_path):
    path = str(tmp_path)
    n, e, d = graph_of(spark, [1, 2], "a")
    store.write_graph(n, e, path, d, "run", 0)
    old = state(spark, path)
    n2, e2, d2 = graph_of(spark, [2, 3], "b")
    broken = e2.withColumn("target_anchor", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):  # nodes are written, edges are not
        store.write_graph(n2, broken, path, d2, "run", 1)
    assert state(spark, path) == old and not store.is_committed(spark, path, "run", 1)
    before = store.read_graph(spark, path)
    assert store.write_graph(n2, e2, path, d2, "run", 1) > before.at.version
    assert store.write_graph(n2, e2, path, d2, "run", 1) is None
    assert state(spark, path)[0] == [(1, "a", 2), (2, "b", 2), (3, "b", 2)]
    assert before.nodes.count() == 4  # an open reading keeps its state


def test_deletes_and_compaction(spark, tmp_path):
    path = str(tmp_path)
    for k, ids in enumerate(([1, 2, 3], [2, 4], [5])):
        n, e, d = graph_of(spark, ids, f"t{k}")
        store.write_graph(n, e, path, d, "run", k)
    store.delete_from_graph(spark.createDataFrame([(1,), (4,), (99,), (1,)], "doc_id long"), path)
    now = state(spark, path)
    assert now == ([(2, "t1", 2), (3, "t0", 2), (5, "t2", 2)], [(2, "t1"), (3, "t0"), (5, "t2")], ["k2", "k3", "k5"])
    snapshot = store.snapshot(spark, path)
    n, e, d = graph_of(spark, [1], "again")
    store.compact_graph(spark, path)
    assert state(spark, path) == now and rows_written(spark, path) == [{"documents": 3, "nodes": 6, "edges": 3}]
    assert store.is_committed(spark, path, "run", 1) and len(os.listdir(f"{path}/segments")) == 5
    store.write_graph(n, e, path, d)  # a deleted document may come back
    store.vacuum(spark, path)
    assert len(os.listdir(f"{path}/segments")) == 2
    assert state(spark, path)[0][0] == (1, "again", 2) and store.snapshot(spark, path).version > snapshot.version


def test_commits_during_a_compaction_stay(spark, tmp_path):
    path = str(tmp_path)
    for k in range(2):
        n, e, d = graph_of(spark, [k], "a")
        store.write_graph(n, e, path, d)
    read = store.read_graph(spark, path)
    n, e, d = graph_of(spark, [0, 7], "late")
    store.write_graph(n, e, path, d)
    store.commit(spark, path, {"documents": read.documents, "nodes": read.nodes, "edges": read.edges}, replaces=[s for s, _ in read.at.segments])
    assert state(spark, path)[0] == [(0, "late", 2), (1, "a", 2), (7, "late", 2)]


def test_later_columns_and_latest_rows(spark, tmp_path):
    path = str(tmp_path)
    for k, (row, kind) in enumerate((((1, "a"), "k long, x string"), ((2, "b"), "k long, x string"), ((1, "c", 9), "k long, x string, y int"))):
        store.commit(spark, path, {"t": spark.createDataFrame([row], kind)}, "r", k)
    assert sorted(map(tuple, store.snapshot(spark, path).latest("t", "k").select("k", "x", "y").collect())) == [(1, "c", 9), (2, "b", None)]


def test_what_comes_during_a_compaction_stays_the_newest(spark, tmp_path):
    path, kind = str(tmp_path), "chat_id long, question_count long, updated_at timestamp"
    put = lambda k, chat, n: store.commit(spark, path, {"summaries": spark.createDataFrame([(chat, n, None)], kind)}, "r", k)
    put(0, 1, 1)
    put(1, 2, 1)

    def current(now):
        put(2, 1, 5)  # another writer, after the snapshot and before the compaction's commit
        return {"summaries": now.latest("summaries", "chat_id"), "none": now.table("none")}

    assert store.compact(spark, path, current)
    found = lambda: sorted((r["chat_id"], r["question_count"]) for r in jobs.thread_table(spark, path).collect())
    assert found() == [(1, 5), (2, 1)] and rows_written(spark, path) == [{"summaries": 1}, {"summaries": 2}]
    jobs.compact_thread_table(spark, path)
    assert found() == [(1, 5), (2, 1)] and rows_written(spark, path) == [{"summaries": 2}] and jobs.compact_thread_table(spark, path) is None
    with pytest.raises(ValueError, match="version"):
        put(3, 9, 9)
        store.compact(spark, path, lambda now: {"summaries": now.table("summaries").drop("version")})
    assert found() == [(1, 5), (2, 1), (9, 9)]


def test_two_streams_keep_all_keys(spark, tmp_path):
    path = str(tmp_path / "store")

    def build(papers):
        built.append(sorted(r["doc_key"] for r in papers.select("doc_key").collect()))
        return papers.select("doc_id", F.lit(0).cast("long").alias("node_ord"), F.lit("section").alias("kind")), papers.select("doc_id", F.lit("x").alias("target_anchor")).where("doc_id > 1")

    built = []
    kind = "doc_id long, doc_key string"
    for run, rows in enumerate(([(1, "a"), (2, "b")], [(3, "c"), (4, "a")], [(5, "a"), (6, "d")])):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / f"in{run}"))
        landing = spark.readStream.schema(kind).parquet(str(tmp_path / f"in{run}"))
        jobs.stream_ingest(landing, path, str(tmp_path / f"check{run}"), build).awaitTermination()
    assert built == [["a", "b"], ["c"], ["d"]]
    assert [x[0] for x in state(spark, path)[0]] == [1, 2, 3, 6] and state(spark, path)[2] == ["a", "b", "c", "d"]
    # the first stream goes on from its checkpoint, in a batch with a number that other streams had too
    spark.createDataFrame([(7, "e")], kind).write.mode("append").parquet(str(tmp_path / "in0"))
    landing = spark.readStream.schema(kind).parquet(str(tmp_path / "in0"))
    jobs.stream_ingest(landing, path, str(tmp_path / "check0"), build).awaitTermination()
    assert built[3:] == [["e"]] and state(spark, path)[2] == ["a", "b", "c", "d", "e"]


def test_thread_summaries_write_changes_only(spark, tmp_path):
    path, check, kind = str(tmp_path / "store"), str(tmp_path / "check"), "chat_id long, role string, ts timestamp"
    assert jobs.thread_table(spark, path).count() == 0

    def run(rows):
        spark.createDataFrame(rows, "chat_id long, role string, s long").select("chat_id", "role", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_thread_table(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), path, check).awaitTermination()
        return sorted((r[0], r[1], r[2]) for r in jobs.thread_table(spark, path).select("chat_id", "question_count", F.unix_timestamp("updated_at")).collect())

    assert run([(c, "user", c) for c in range(40)]) == [(c, 1, c) for c in range(40)]
    assert run([(3, "user", 100), (3, "assistant", 101), (50, "assistant", 7)])[3] == (3, 2, 101)
    assert [x["summaries"] for x in rows_written(spark, path)] == [40, 2]
    now = store.snapshot(spark, path)
    changed = spark.createDataFrame([(3, 99, None)], "chat_id long, question_count long, updated_at timestamp")
    assert store.commit(spark, path, {"summaries": changed}, jobs.run_id(spark, check), 1) is None  # the batch comes again
    jobs.compact_thread_table(spark, path)
    assert rows_written(spark, path) == [{"summaries": 41}] and jobs.thread_table(spark, path).where("chat_id = 3").first()["question_count"] == 2
    assert store.snapshot(spark, path).version > now.version
