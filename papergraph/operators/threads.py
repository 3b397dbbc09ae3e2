"""Anchored conversation threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.functions.text import filled, or_empty, strip
from papergraph.operators.generation import END, bullet_lines, quoted
from papergraph.sources.landed import first_per_key

KEY = ["doc_id", "selection", "section_anchor"]


def open_threads(requests: DataFrame, chats: DataFrame, documents: DataFrame) -> DataFrame:
    """Threads for all requests: existing ones unchanged, and one a new key, seeded by its
    first request (by request_id). Requests for unknown documents go.
    """
    known = requests.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    new = first_per_key(known.join(chats.select(*KEY), KEY, "left_anti"), KEY, [F.col("request_id")])
    old = chats.join(known.select(*KEY).distinct(), KEY, "left_semi").withColumn("created", F.lit(False))
    seeded = new.withColumn("chat_id", F.xxhash64(*KEY)).withColumn("created", F.lit(True))
    return old.unionByName(seeded.select(*[c for c in old.columns if c in seeded.columns]), allowMissingColumns=True)


def thread_history(messages: DataFrame) -> DataFrame:
    """chat_id, messages: ordered (role, content) of chat_id, turn, role, content."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return messages.groupBy("chat_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def deal_turns(messages: DataFrame) -> DataFrame:
    """Messages (chat_id, ts, turn, role, content) with ``piece`` and ``tie``: sorted over ranges,
    so that a chat of any size is dealt to as many tasks as it takes, and its pieces are in
    order. Ties of (ts, turn) go by a hash of role and content; nulls come last, and rows
    without a chat go. Write the result before use: what is read twice must be the same.
    """
    rows = messages.where("chat_id is not null").select("chat_id", "ts", "turn", "role", "content")
    rows = rows.withColumn("tie", F.struct(F.xxhash64("role", "content").alias("text"), F.monotonically_increasing_id().alias("row")))
    return rows.repartitionByRange("chat_id", F.asc_nulls_last("ts"), F.asc_nulls_last("turn"), "tie").withColumn("piece", F.spark_partition_id())


def number_turns(dealt: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns (chat_id, turn, role, content, question_count) numbered from 0 in a chat, and the
    counters (chat_id, n, questions) of the chats met. ``before`` are counters to go on from.

    Pieces are numbered in tasks of their own; only their counts, a row a piece, are summed up
    along a chat.
    """
    asked = F.when(F.col("role") == "user", 1).otherwise(0)
    pieces = dealt.groupBy("chat_id", "piece").agg(F.count("*").alias("n"), F.sum(asked).alias("questions"))
    along = Window.partitionBy("chat_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    sums = pieces.select("chat_id", "piece", "n", "questions", F.sum("n").over(along).alias("n_upto"), F.sum("questions").over(along).alias("questions_upto"))
    if before is not None:
        old = before.select("chat_id", F.col("n").alias("n_old"), F.col("questions").alias("questions_old"))
        sums = sums.join(old, "chat_id", "left")
        for c in ("n", "questions"):
            sums = sums.withColumn(f"{c}_upto", F.col(f"{c}_upto") + F.coalesce(f"{c}_old", F.lit(0)))
    own = Window.partitionBy("chat_id", "piece").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("turn"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select("chat_id", "piece", "role", "content", F.row_number().over(own).alias("nth"), F.sum(asked).over(own).alias("asked"))
    starts = sums.select("chat_id", "piece", (F.col("n_upto") - F.col("n")).alias("n0"), (F.col("questions_upto") - F.col("questions")).alias("q0"))
    turns = placed.join(starts, ["chat_id", "piece"]).select("chat_id", (F.col("n0") + F.col("nth") - 1).alias("turn"), "role", "content", (F.col("q0") + F.col("asked")).alias("question_count"))
    return turns, sums.groupBy("chat_id").agg(F.max("n_upto").alias("n"), F.max("questions_upto").alias("questions"))


def thread_summaries(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """``chats`` with question_count and updated_at (the last append, else created_at)."""
    m = messages.groupBy("chat_id").agg(F.count_if(F.col("role") == "user").alias("question_count"), F.max("ts").alias("last"))
    out = chats.join(m, "chat_id", "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))
    stamp = F.coalesce("last", "created_at") if "created_at" in chats.columns else F.col("last")
    return out.withColumn("updated_at", stamp).drop("last")


def newest_threads(summaries: DataFrame) -> DataFrame:
    """``summaries`` with ``place`` in their document: newest first, ties by the later thread;
    a document's threads come together and in that order."""
    order = Window.partitionBy("doc_id").orderBy(F.col("updated_at").desc_nulls_last(), F.desc("chat_id"))
    return summaries.withColumn("place", F.row_number().over(order))


def thread_prompts(chats: DataFrame, history: DataFrame, docs: DataFrame, assistant: str = "Assistant") -> DataFrame:
    """chat_id, prompt: header, paragraph, highlight, dependencies, transcript, open turn."""
    rows = chats.join(history, "chat_id", "left").join(docs.select("doc_id", "title"), "doc_id")
    c = F.col
    said = lambda m: F.concat(F.when(m["role"] == "user", "> ").otherwise(f"{assistant} > "), strip(m["content"]), F.lit("\n"))
    turns = F.array_join(F.transform(F.coalesce(c("messages"), F.array().cast("array<struct<role:string,content:string>>")), said), "")
    part = lambda name, text: F.when(text == "", "").otherwise(F.concat(F.lit(quoted(name)), text, F.lit(END)))
    nearby = F.when(F.coalesce(F.size("dependencies"), F.lit(0)) > 0, bullet_lines(c("dependencies"))).otherwise("")
    prompt = F.concat(
        F.lit("A reader's thread on the paper titled "), or_empty(c("title")), F.lit(", section "), filled(c("section_label"), F.lit("not known")), F.lit(".\n\n"),
        F.lit(quoted("Paragraph")), strip(c("paragraph")), F.lit(END), part("What the reader marked first", strip(c("selection"))), part("Objects near it", nearby),
        F.lit("Turns (the reader's start with >):\n"), turns, F.lit(f"{assistant} >"),
    )
    return rows.select("chat_id", prompt.alias("prompt"))
