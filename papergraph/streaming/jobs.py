"""Incremental ingestion, threads and reading events (Structured Streaming)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from papergraph.operators.admission import plan_ingest
from papergraph.operators.generation import reply_pieces
from papergraph.operators.retrieval import retrieve_selections
from papergraph.operators.threads import KEY, deal_turns, number_turns
from papergraph.sources.landed import first_per_key
from papergraph.sources.store import commit, compact, delete_folder, is_committed, read_graph, snapshot, write_graph

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to. It outlives restarts; a new checkpoint,
    even at an old place, has another. Batches are told apart by it and their number."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_ingest(landing: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> StreamingQuery:
    """Continuous ingestion of papers (doc_id, doc_key, ...) into the graph store ``path``.

    Each batch skips keys that are ready there, builds the graph of the others with ``build``
    (papers to nodes and edges) and commits documents, nodes and edges as one version. A batch
    that was stopped leaves nothing visible; one that comes again after its commit is skipped.
    """

    def batch(papers: DataFrame, number: int) -> None:
        spark = papers.sparkSession
        run = run_id(spark, checkpoint)
        if is_committed(spark, path, run, number):
            return
        known = read_graph(spark, path).documents
        known = spark.createDataFrame([], "doc_key string, status string") if known is None else known.select("doc_key", "status")
        papers = papers.persist()
        wanted = plan_ingest(papers.select("doc_key", F.lit(False).alias("force")), known)
        todo = first_per_key(papers.join(wanted.select("doc_key"), "doc_key", "left_semi"), ["doc_key"], [F.col("doc_id")]).persist()
        if not todo.isEmpty():
            write_graph(*build(todo), path, todo, run, number)
        todo.unpersist()
        papers.unpersist()

    return landing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_thread_summaries(messages: DataFrame) -> DataFrame:
    """chat_id, question_count, updated_at, kept by streaming aggregation (update mode)."""
    return messages.groupBy("chat_id").agg(F.count_if(F.col("role") == "user").alias("question_count"), F.max("ts").alias("updated_at"))


def stream_thread_table(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Thread summaries kept in the store ``path``: a batch writes the threads that it touched,
    and one that comes again after its commit writes nothing."""

    def batch(changed: DataFrame, number: int) -> None:
        commit(changed.sparkSession, path, {"summaries": changed}, run_id(changed.sparkSession, checkpoint), number)

    return stream_thread_summaries(messages).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary of each thread."""
    found = snapshot(spark, path).latest("summaries", "chat_id")
    return spark.createDataFrame([], "chat_id long, question_count long, updated_at timestamp") if found is None else found.drop("version")


def compact_thread_table(spark: SparkSession, path: str) -> int | None:
    """One segment with the newest summaries in place of all."""
    return compact(spark, path, lambda now: {"summaries": now.latest("summaries", "chat_id")})


def stream_thread_turns(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Durable append of turns to the store ``path``, however many of them one thread has.

    A batch sorts its messages over ranges, numbers the pieces on from the threads' counters
    and commits turns and counters as one version; one that comes again after its commit
    writes nothing. One stream at a time writes a store.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark, run = new.sparkSession, run_id(new.sparkSession, checkpoint)
        if is_committed(spark, path, run, number):
            return
        scratch = f"{path}/dealt/{run}-{number}"
        dealt = deal_turns(new)
        dealt.write.mode("overwrite").parquet(scratch)
        turns, counters = number_turns(spark.read.schema(dealt.schema).parquet(scratch), snapshot(spark, path).latest("counters", "chat_id"))
        commit(spark, path, {"turns": turns, "counters": counters}, run, number)
        delete_folder(spark, scratch)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_turns(spark: SparkSession, path: str) -> DataFrame | None:
    """chat_id, turn, role, content, question_count: all turns appended, or None."""
    turns = snapshot(spark, path).table("turns")
    return None if turns is None else turns.drop("version")


def compact_thread_turns(spark: SparkSession, path: str) -> int | None:
    """One segment with all turns, by thread and number, and the newest counters in place of all."""

    def current(now) -> dict[str, DataFrame | None]:
        turns = now.table("turns")
        by = ("chat_id", "turn")
        return {"turns": turns if turns is None else turns.repartitionByRange(*by).sortWithinPartitions(*by), "counters": now.latest("counters", "chat_id")}

    return compact(spark, path, current)


class ThreadHistory(StatefulProcessor):
    """A thread's turns in order: counters in state, and each message out with its number. A
    thread's new messages of one batch are sorted in one task (``stream_thread_turns`` deals them)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long, questions long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, questions = self.count.get() if self.count.exists() else (0, 0)
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        new = pd.concat(frames).sort_values(["ts", "turn"], kind="stable")
        asked = questions + (new["role"] == "user").cumsum()
        yield pd.DataFrame({"chat_id": key[0], "turn": range(n, n + len(new)), "role": new["role"].values, "content": new["content"].values, "question_count": asked.values})
        self.count.update((n + len(new), int(asked.iloc[-1])))

    def close(self) -> None:
        pass


def stream_thread_history(messages: DataFrame) -> DataFrame:
    """Durable append: chat_id, turn, role, content, question_count (needs STATE_STORE)."""
    return messages.groupBy("chat_id").transformWithStateInPandas(ThreadHistory(), "chat_id long, turn long, role string, content string, question_count long", "Append", "None")


class ReplyDecoder(StatefulProcessor):
    """Lines of a reply in state until the end mark and all before it are there, or none came
    for ``timeout_ms``; then the message goes out once, and later lines are ignored.

    Positions count from 0 without gaps, in any order and any number of batches; a line that
    comes twice counts once. What tells that a reply is out is forgotten after ``kept_ms``.
    """

    def __init__(self, timeout_ms: int, kept_ms: int):
        self.timeout_ms, self.kept_ms = timeout_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a reply: a call to the store costs far more than a line
        self.held = handle.getValueState("held", "pieces string, end long, last long")
        self.out = handle.getValueState("out", "finished boolean", self.kept_ms)

    def _message(self, key, pieces: dict[int, str | None], end: int | None, finished: bool) -> pd.DataFrame:
        self.out.update((finished,))
        text = "".join(pieces[pos] or "" for pos in sorted(pieces) if end is None or pos < end)
        return pd.DataFrame({"reply_id": [key[0]], "reply": [text], "finished": [finished]})

    def _held(self) -> tuple[dict[int, str | None], int | None, int | None]:
        text, end, last = self.held.get() if self.held.exists() else ("{}", None, None)
        return {int(k): v for k, v in json.loads(text).items()}, end, last

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if self.out.exists() or not frames:
            return
        pieces, end, last = self._held()
        for f in frames:
            for pos, piece, is_end in zip(f["pos"].tolist(), f["piece"].tolist(), f["is_end"].tolist(), strict=True):
                if is_end:
                    end = pos if end is None else min(end, pos)
                else:
                    pieces[pos] = piece if isinstance(piece, str) else None
        if end is not None and sum(pos < end for pos in pieces) == end:
            if last is not None:
                self.held.clear()
            yield self._message(key, pieces, end, True)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.held.update((json.dumps(pieces), end, now))
            self.handle.registerTimer(now + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pieces, end, last = self._held()
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() >= last + self.timeout_ms:  # else another line came since
            self.held.clear()
            yield self._message(key, pieces, end, False)

    def close(self) -> None:
        pass


def stream_replies(lines: DataFrame, timeout_ms: int = 120_000, kept_ms: int = 86_400_000) -> DataFrame:
    """Server-sent lines (reply_id, pos, line) as they come, to one row a reply: reply_id, reply,
    finished (false if it was cut off). Needs STATE_STORE."""
    kind = dict(lines.dtypes)["reply_id"]
    pieces = reply_pieces(lines.withColumn("pos", F.col("pos").cast("long")))
    return pieces.groupBy("reply_id").transformWithStateInPandas(ReplyDecoder(timeout_ms, kept_ms), f"reply_id {kind}, reply string, finished boolean", "Append", "ProcessingTime")


class ThreadOpener(StatefulProcessor):
    """Whether a thread is there, and for a new one its first request out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "created boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.there.update((False,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames and not self.there.exists():
            self.there.update((True,))
            yield pd.concat(frames).sort_values("request_id", kind="stable").head(1)

    def close(self) -> None:
        pass


def stream_open_threads(requests: DataFrame, documents: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, doc_id, selection, section_anchor, ...) as they come, to one row a
    thread that they create: the request's columns and chat_id. Needs STATE_STORE.

    A thread is created once, by the first request that arrives (of one batch, the least
    request_id); those of ``chats`` are there when the stream first starts. Requests for
    documents that are not known when their batch runs go.
    """
    known = requests.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(*requests.columns)
    old = None if chats is None else chats.select(*KEY).distinct().groupBy(*KEY)
    made = known.groupBy(*KEY).transformWithStateInPandas(ThreadOpener(), known.schema, "Append", "None", initialState=old)
    return made.withColumn("chat_id", F.xxhash64(*KEY))


def stream_retrieval(requests: DataFrame, graph: str, out: str, checkpoint: str) -> StreamingQuery:
    """Selections (as ``retrieve_selections`` takes them) answered as they come.

    Every batch reads the graph store as it is when the batch begins, so that what was ingested
    or deleted since the last one counts, and commits its answers to the store ``out``; request
    ids without an answer are there with a null label.
    """

    def batch(asked: DataFrame, number: int) -> None:
        spark = asked.sparkSession
        nodes = read_graph(spark, graph).nodes
        run = run_id(spark, checkpoint)
        asked = asked.persist()
        if nodes is None:
            found = asked.select("request_id", *[F.lit(None).cast("string").alias(c) for c in ("content", "label", "anchor", "section_label")])
        else:
            found = asked.select("request_id").join(retrieve_selections(asked, nodes), "request_id", "left")
        commit(spark, out, {"answers": found}, run, number)
        asked.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sections_finished(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row a reader session and section; repeats within the delay are ignored.

    events: session, doc_id, anchor, ts. On a batch frame the first event counts.
    """
    key = ["session", "doc_id", "anchor"]
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
    return first_per_key(events, key, [F.col("ts")])
