"""Stateful streams against their batch counterparts, under cuts into batches and restarts."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papergraph.operators import generation, threads
from papergraph.sources import landed, store
from papergraph.streaming import jobs

LINE = "reply_id long, pos long, line string"


@pytest.fixture
def no_idle_batches(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def run(spark, batches, kind, build, folder):
    """Each batch put into the source's folder and run by a stream of its own, which goes on
    from the checkpoint: its whole output."""
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(kind).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def said(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def test_streamed_replies_equal_batch_under_any_cut(spark, tmp_path, no_idle_batches):
    rng = random.Random(6)
    lines = []
    for r in range(12):
        parts = [said(rng.choice(["a ", "é", "\n", '"', ""])) if rng.random() < 0.7 else rng.choice(["", ": ping", "data: {broken", 'data: {"choices": []}', "event: x"]) for _ in range(rng.randrange(8))]
        lines += [(r, k, x) for k, x in enumerate([*parts, "data: [DONE]", said("late")])]
    want = sorted(map(tuple, generation.decode_reply_stream(spark.createDataFrame(lines, LINE)).collect()))
    mixed = lines + rng.sample(lines, 10)  # some lines come twice
    rng.shuffle(mixed)
    cuts = [0, *sorted(rng.sample(range(1, len(mixed)), 3)), len(mixed)]
    got = run(spark, [mixed[a:b] for a, b in zip(cuts, cuts[1:])], LINE, jobs.stream_replies, str(tmp_path))
    assert sorted((r["reply_id"], r["reply"]) for r in got.collect()) == want
    assert all(r["finished"] for r in got.collect())


def test_cut_off_replies_go_out_after_a_while(spark, tmp_path, no_idle_batches):
    slow = lambda lines: jobs.stream_replies(lines, timeout_ms=1)
    batches = [[(1, 0, said("half"))], [(2, 0, said("x")), (2, 1, "data: [DONE]")], [(1, 1, said(" more")), (3, 0, "data: [DONE]")]]
    got = run(spark, batches, LINE, slow, str(tmp_path))
    time.sleep(0.01)
    assert sorted(map(tuple, got.collect())) == [(1, "half", False), (2, "x", True), (3, "", True)]


def test_threads_are_created_once(spark, tmp_path, no_idle_batches):
    kind = "request_id long, doc_id long, selection string, section_anchor string"
    rng = random.Random(2)
    asked = [(k, rng.randrange(4), f"s{rng.randrange(3)}", rng.choice(["S1", "S2"])) for k in range(60)]
    documents = spark.createDataFrame([(d,) for d in range(3)] + [(0,)], "doc_id long")
    chats = spark.createDataFrame([(5, 0, "s0", "S1"), (6, 1, "s2", "S2"), (7, 1, "s2", "S2")], "chat_id long, doc_id long, selection string, section_anchor string")
    batch = threads.open_threads(spark.createDataFrame(asked, kind), chats, documents).where("created")
    want = sorted((r["chat_id"], r["doc_id"], r["selection"], r["section_anchor"]) for r in batch.collect())
    got = run(spark, [asked[:3], asked[3:20], asked[20:]], kind, lambda r: jobs.stream_open_threads(r, documents, chats), str(tmp_path))
    assert sorted((r["chat_id"], r["doc_id"], r["selection"], r["section_anchor"]) for r in got.collect()) == want
    first = {}
    for k, *key in asked:
        first.setdefault(tuple(key), k)
    assert all(first[r["doc_id"], r["selection"], r["section_anchor"]] == r["request_id"] for r in got.collect()) and len(want) == 16


def test_turns_are_numbered_over_batches(spark, tmp_path):
    kind = "chat_id long, turn long, role string, content string, ts timestamp"
    rng = random.Random(3)
    stamp = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m) if m is not None else None
    # one chat holds most rows, some of them the same; stamps tie, and some are unknown
    made = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([0, 1, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None]), rng.choice([None, *range(5)])) for _ in range(400)]
    made += [(1, 0, "user", "same", 2)] * 100 + [(None, 0, "user", "lost", 1)]
    rng.shuffle(made)
    cuts, seen, want = [0, 250, 251, len(made)], {}, []
    last = lambda v: (v is None, v or 0)
    for a, b in zip(cuts, cuts[1:]):
        rows = [(c, t, r, x, stamp(m)) for c, t, r, x, m in made[a:b]]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_thread_turns(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
        for c, t, _, _, m in sorted((x for x in made[a:b] if x[0]), key=lambda x: (x[0], last(x[4]), last(x[1]))):
            want.append((c, seen.setdefault(c, 0)))
            seen[c] += 1
    got = jobs.thread_turns(spark, str(tmp_path / "store")).collect()
    assert sorted((r["chat_id"], r["turn"]) for r in got) == sorted(want)
    assert sorted((r["chat_id"], str(r["role"]), str(r["content"])) for r in got) == sorted((c, str(r), str(x)) for c, _, r, x, _ in made if c)
    asked = {}
    for r in sorted(got, key=lambda r: (r["chat_id"], r["turn"])):
        asked[r["chat_id"]] = asked.get(r["chat_id"], 0) + (r["role"] == "user")
        assert r["question_count"] == asked[r["chat_id"]]
    # the batch again changes nothing, and the large chat stands in several pieces
    commits = spark.read.parquet(str(tmp_path / "store/log")).count()
    jobs.stream_thread_turns(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert commits == spark.read.parquet(str(tmp_path / "store/log")).count() == 3
    jobs.compact_thread_turns(spark, str(tmp_path / "store"))
    assert sorted(map(str, jobs.thread_turns(spark, str(tmp_path / "store")).collect())) == sorted(map(str, got))
    spark.createDataFrame([(1, 0, "user", "after", None)], kind).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.stream_thread_turns(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert jobs.thread_turns(spark, str(tmp_path / "store")).where("content = 'after'").first()["turn"] == seen[1]
    dealt = threads.deal_turns(spark.createDataFrame([(1, 0, "user", "same", None)] * 1000, kind).repartition(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt.write.parquet(str(tmp_path / "dealt"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(str(tmp_path / "dealt"))
    assert kept.select("piece").distinct().count() > 1
    turns, counters = threads.number_turns(kept)
    assert sorted(r["turn"] for r in turns.collect()) == list(range(1000)) and tuple(counters.first()) == (1, 1000, 1000)
    assert threads.number_turns(kept.limit(0))[0].count() == 0 and jobs.thread_turns(spark, str(tmp_path / "none")) is None


def test_requests_meet_the_graph_of_their_batch(spark, tmp_path):
    from papergraph.operators.graph import DATA

    graph, out, kind = str(tmp_path / "graph"), str(tmp_path / "answers"), "request_id long, doc_id long, selection string"
    nodes = lambda text: spark.createDataFrame([(1, 1, "section", "Tides", "S1", "S1", text)], "doc_id long, node_ord long, kind string, label string, html_anchor string, definition_anchor string, excerpt string").withColumn("data", F.lit(None).cast(DATA))
    edges = spark.createDataFrame([], "doc_id long, target_anchor string")

    def ask(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_retrieval(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), graph, out, str(tmp_path / "check")).awaitTermination()
        return {r["request_id"]: r["content"] for r in store.snapshot(spark, out).table("answers").collect()}

    assert ask([(1, 1, "tides")]) == {1: None}
    store.write_graph(nodes("old"), edges, graph)
    assert ask([(2, 1, " Tides. "), (3, 1, "other")]) == {1: None, 2: "old", 3: None}
    store.write_graph(nodes("new"), edges, graph)
    assert ask([(4, 1, "tides")])[4] == "new"
    store.delete_from_graph(spark.createDataFrame([(1,)], "doc_id long"), graph)
    assert ask([(5, 1, "tides")]) == {1: None, 2: "old", 3: None, 4: "new", 5: None}


def test_assets_by_content(spark):
    png, svg = b"\x89PNG\r\n\x1a\nrest", b'\xef\xbb<?xml version="1.0"?>\n<svg/>'[2:]
    manifest = spark.createDataFrame([(1, "a.png"), (1, "a.png"), (1, "b"), (2, "a.png"), (2, "gone"), (2, "empty"), (3, "w"), (3, "r"), (3, "s")], "doc_id long, path string")
    files = [(1, "a.png", png), (1, "b", b"\xff\xd8\xff\xe0"), (2, "a.png", png), (2, "empty", b""), (2, "extra", b"not asked"), (3, "w", b"RIFF0000WEBPx"), (3, "r", b"RIFF0000WAVEx"), (3, "s", svg), (3, "s", svg), (None, "n", b"1")]
    assets, payloads, missing = landed.stored_assets(manifest, spark.createDataFrame(files, "doc_id long, path string, content binary"))
    got = sorted((r["doc_id"], r["path"], r["content_type"], bytes(r["data"])) for r in landed.assets_with_data(assets, payloads).collect())
    assert got == [(1, "a.png", "image/png", png), (1, "b", "image/jpeg", b"\xff\xd8\xff\xe0"), (2, "a.png", "image/png", png), (3, "r", "application/octet-stream", b"RIFF0000WAVEx"), (3, "s", "image/svg+xml", svg), (3, "w", "image/webp", b"RIFF0000WEBPx")]
    assert payloads.count() == 5 and sorted(map(tuple, missing.collect())) == [(2, "empty"), (2, "gone")]
