"""Prompts, provider calls in batches, and what becomes of the replies."""

from __future__ import annotations

import re
import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.functions.text import collapse, filled, or_empty, strip
from papergraph.operators.retrieval import retrieve_selections, symbol_excerpts
from papergraph.sources.shared import shared_dir, stored
from papergraph.sources.store import commit, compact, snapshot

# The reply that means "can't tell", the marks of a point, and the output limits by kind.
ABSTAIN = "NEEDS_MORE_CONTEXT"
STATUSES = ("hit", "partial", "miss")
LIMITS = {"resolve": 400, "equation": 500, "symbol": 80, "checkpoint": 600, "chat": 900}
ABSTAIN_MESSAGE = "The text around this does not settle it; an earlier section may."
RATE_MESSAGE = "The model is rate-limited right now; try again in a minute."
ERROR_MESSAGE = "The model could not be reached; try again shortly."
SYSTEM = {
    "resolve": "Explain the highlighted span in two to four plain sentences, from the context given.",
    "equation": "Explain in three to five plain sentences what the equation says and does.",
    "symbol": "State in one short sentence what the symbol denotes in the excerpts.",
    "checkpoint": "Judge the recall against two or three key points of the section: lines 'POINT hit|partial|miss: ...', then 'FEEDBACK: ...'.",
    "chat": "Answer the reader about the anchored paragraph, briefly.",
}
END = "\n>>>\n\n"


def quoted(name: str) -> str:
    """The line that opens a quoted part of a prompt; END closes it."""
    return f"{name}:\n<<<\n"


def bullet_lines(items: Column, empty: str = "- nothing") -> Column:
    few = F.slice(items, 1, 12)
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, empty).otherwise(F.array_join(F.transform(few, lambda d: F.concat(F.lit("- "), d)), "\n"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else or_empty(p) for p in parts])


def build_prompts(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with kind, system, prompt and max_tokens.

    A checkpoint's ``text`` stands as ``section_text`` gives it, with the blank at which its cut may end.
    """
    c, head = F.col, ("From the paper titled ", F.col("title"), ".\n\n")
    if kind == "resolve":
        prompt = _text(*head, quoted("Paragraph"), strip(c("paragraph")), END, "It belongs to section: ", filled(c("section"), F.lit("not known")), "\nObjects near it:\n", bullet_lines(c("dependencies")), "\n\n", quoted("What the reader marked"), strip(c("selection")), END, "Task: say what the marked span means here.")
    elif kind == "equation":
        prompt = _text(*head, quoted("LaTeX of an equation"), strip(c("latex")), END, quoted("Text around it"), strip(c("context")), END, "Its symbols:\n", bullet_lines(c("symbols")), "\n\nTask: say what the equation states.")
    elif kind == "symbol":
        prompt = _text(*head, quoted("Places where the symbol stands"), F.array_join("excerpts", "\n"), END, "Task: say what this symbol stands for: ", c("label"))
    elif kind == "checkpoint":
        prompt = _text(*head, quoted("Section"), c("text"), END, "It is headed: ", c("section_label"), "\n\n", quoted("What the reader recalls"), filled(strip(c("answer")), F.lit("(nothing; show the points)")), END, "Task: compare the two.")
    else:
        raise ValueError(f"no prompt kind {kind}")
    return rows.withColumns({"kind": F.lit(kind), "system": F.lit(SYSTEM[kind]), "prompt": prompt, "max_tokens": F.lit(LIMITS[kind])})


class Provider:
    """What a text-generation backend offers; built once a task."""

    def is_configured(self) -> bool:
        return False

    def generate(self, system: str, prompt: str, max_tokens: int) -> str:
        raise RuntimeError("no provider configured")


class EchoProvider(Provider):
    """Deterministic stand-in: the last line of the prompt, cut to the limit."""

    def is_configured(self) -> bool:
        return True

    def generate(self, system: str, prompt: str, max_tokens: int) -> str:
        return " ".join(prompt.strip().splitlines()[-1].split()[:max_tokens])


#: Fixed value: what an error of a rate limit says.
RATE_LIMITED = "429|resource_exhausted|retryinfo|quota|rate limit"


def prompt_key(system: Column, prompt: Column, max_tokens: Column) -> Column:
    """Content address of a request: the lengths keep apart what is system and what is prompt."""
    return F.sha2(F.concat_ws("|", F.length(system), max_tokens, system, prompt), 256)


def stored_replies(spark: SparkSession, store: str) -> DataFrame | None:
    """key, reply: the replies that a store holds, one a key; failures are not among them."""
    rows = snapshot(spark, store).table("replies")
    return None if rows is None else rows.where("error is null").groupBy("key").agg(F.min_by("reply", "version").alias("reply"))


def compact_replies(spark: SparkSession, store: str) -> int | None:
    """One segment in place of all that a store of replies has: a reply a key; failures go."""

    def current(now) -> dict[str, DataFrame | None]:
        rows = now.table("replies")
        best = F.min_by(F.struct("reply", "error", "version"), "version").alias("kept")
        return {"replies": rows if rows is None else rows.where("error is null").groupBy("key").agg(best).select("key", "kept.*")}

    return compact(spark, store, current)


def generate(prompts: DataFrame, provider: type[Provider], tasks: int | None = None, store: str | None = None, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``prompts`` with reply and error.

    Replies lie in ``store``, a folder, by the content address of system, prompt and limit.
    Only what it lacks is sent, once a distinct request, and written there before anything is
    returned: however often the result is read, and by whatever later call, no stored request
    is sent again. Without ``store`` the replies are kept for this result alone. Failures are
    reported, but asked again by the next call.

    ``tasks`` bounds the calls at a time. A call that meets a rate limit is made again,
    ``attempts`` times in all, after ``wait`` seconds and then twice as long each time. A lost
    task repeats its own calls alone: the finished ones have written theirs.
    """
    spark = prompts.sparkSession
    store = store or f"{shared_dir(spark)}/replies/{uuid.uuid4().hex}"
    keyed = prompts.withColumn("key", prompt_key(F.col("system"), F.col("prompt"), F.col("max_tokens")))
    asked = keyed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("system", "prompt", "max_tokens")])
    known = stored_replies(spark, store)
    asked = asked if known is None else asked.join(known.select("key"), "key", "left_anti")
    asked = asked.repartition(tasks) if tasks else asked

    def said(model: Provider, row) -> tuple[str | None, str | None]:
        for nth in range(attempts):
            try:
                return model.generate(row.system, row.prompt, int(row.max_tokens)), None
            except Exception as e:  # one bad call must not end the batch
                error = str(e) or type(e).__name__
            if nth + 1 == attempts or not re.search(RATE_LIMITED, error.lower()):
                break
            time.sleep(wait * 2**nth)
        return None, error

    def run(frames):
        model = provider()
        for f in frames:
            out = [said(model, row) for row in f.itertuples(index=False)]
            yield pd.DataFrame({"key": f["key"], "reply": pd.Series([x for x, _ in out], dtype=object, index=f.index), "error": pd.Series([e for _, e in out], dtype=object, index=f.index)})

    version = commit(spark, store, {"replies": asked.mapInPandas(run, "key string, reply string, error string")})
    answers = snapshot(spark, store).table("replies")
    # a failure counts only if it is this call's
    mine = answers.where(F.col("error").isNull() | (F.col("version") == version))
    best = mine.groupBy("key").agg(F.min_by(F.struct("reply", "error"), F.struct(F.col("error").isNotNull(), "version")).alias("answer"))
    return keyed.join(best, "key").select(*prompts.columns, "answer.reply", "answer.error")


def friendly_error(error: Column) -> Column:
    return F.when(F.lower(error).rlike(RATE_LIMITED), RATE_MESSAGE).otherwise(ERROR_MESSAGE)


def without_thoughts(reply: Column) -> Column:
    return strip(F.regexp_replace(or_empty(reply), r"(?s)<think>.*?</think>", ""))


def is_abstention(reply: Column) -> Column:
    return F.upper(strip(reply)).startswith(ABSTAIN)


def postprocess_reply(rows: DataFrame) -> DataFrame:
    """``rows`` (reply, error) with mode (generated, abstained, error) and content."""
    clean = without_thoughts(F.col("reply"))
    failed = F.col("error").isNotNull()
    mode = F.when(failed, "error").when(is_abstention(clean), "abstained").otherwise("generated")
    content = F.when(failed, friendly_error(F.col("error"))).when(is_abstention(clean), ABSTAIN_MESSAGE).otherwise(clean)
    return rows.withColumn("mode", mode).withColumn("content", content)


def resolve(requests: DataFrame, nodes: DataFrame, docs: DataFrame, provider: type[Provider], tasks: int | None = None, store: str | None = None) -> DataFrame:
    """request_id, mode, content, label, anchor, section_label: from the graph where it can be,
    else from the provider (or ``store``, see ``generate``); what is retrieved never reaches it."""
    found = retrieve_selections(requests, nodes)
    rest = requests.join(found.select("request_id"), "request_id", "left_anti")
    blank = [F.lit("").alias(c) for c in ("label", "anchor", "section_label")]
    if not provider().is_configured():
        made = rest.select("request_id", F.lit("unconfigured").alias("mode"), F.lit("").alias("content"), *blank)
    else:
        prompts = build_prompts(rest.join(docs.select("doc_id", "title"), "doc_id"), "resolve")
        made = postprocess_reply(generate(prompts, provider, tasks, store)).select("request_id", "mode", "content", *blank)
    return found.select("request_id", F.lit("retrieved").alias("mode"), "content", "label", "anchor", "section_label").unionByName(made)


def define_symbols(nodes: DataFrame, dom: DataFrame, docs: DataFrame, provider: type[Provider], tasks: int | None = None, store: str | None = None) -> DataFrame:
    """``nodes`` with definitions of still open symbols; settled ones are not asked again.

    A reply that abstains, by sentinel or in words, leaves the symbol undefined.
    """
    if not provider().is_configured():
        return nodes
    settled = F.coalesce("data.definition_status", F.lit("")).isin("grounded", "inferred", "undefined")
    # what is read several times is stored: the symbols, and the open ones with their excerpts
    symbols = stored(nodes.where("kind = 'symbol'"), "symbols")
    open_ = symbols.where(~settled)
    asked = open_.select("doc_id", "node_ord", "label").join(symbol_excerpts(open_.select("doc_id", "label").distinct(), dom), ["doc_id", "label"], "left")
    asked = stored(asked, "symbol_excerpts")
    replies = generate(build_prompts(asked.where("excerpts is not null").join(docs.select("doc_id", "title"), "doc_id"), "symbol"), provider, tasks, store)
    text = without_thoughts(F.col("reply"))
    none = (text == "") | is_abstention(text) | F.lower(text).contains("not explicitly defined")
    known = replies.where("error is null").select("doc_id", "node_ord", F.when(none, "undefined").otherwise("grounded").alias("new"), F.when(none, "").otherwise(text).alias("meaning"))
    silent = asked.where("excerpts is null").select("doc_id", "node_ord", F.lit("undefined").alias("new"), F.lit("").alias("meaning"))
    out = open_.join(known.unionByName(silent), ["doc_id", "node_ord"], "left")
    status = F.coalesce("new", "data.definition_status")
    out = out.withColumn("excerpt", F.when(F.col("new") == "grounded", F.col("meaning")).otherwise(F.col("excerpt"))).withColumn("data", F.col("data").withField("definition_status", status)).select(*nodes.columns)
    return nodes.where("kind is null or kind != 'symbol'").unionByName(symbols.where(settled)).unionByName(out)


def parse_checkpoints(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (reply_id, ord, status, point) and feedback (reply_id, feedback) of raw replies."""
    lines = replies.select("reply_id", F.posexplode(F.split(or_empty(F.col("raw")), r"\R")).alias("at", "line"))
    lines = lines.withColumn("line", strip(F.regexp_replace(strip(F.col("line")), "^`+", "")))
    # a point is headed POINT and its status, feedback FEEDBACK; what follows the colon counts
    head, rest = F.split(F.lower(collapse(F.substring_index("line", ":", 1))), " "), strip(F.get(F.split("line", ":", 2), F.lit(1)))
    status = F.get(head, F.lit(1))
    is_point = (F.size(head) == 2) & (F.get(head, F.lit(0)) == "point") & status.isin(*STATUSES) & (or_empty(rest) != "")
    points = lines.where(is_point).select("reply_id", F.col("at").alias("ord"), status.alias("status"), rest.alias("point"))
    is_feedback = F.upper("line").startswith("FEEDBACK:")
    said = lines.groupBy("reply_id").agg(F.max_by(rest, F.when(is_feedback, F.col("at"))).alias("said"), F.count_if(is_point).alias("n"))
    out = replies.join(said, "reply_id")
    feedback = F.when((or_empty(F.col("said")) == "") & (F.col("n") == 0), F.substring(strip(F.col("raw")), 1, 400)).otherwise(or_empty(F.col("said")))
    return points, out.select("reply_id", feedback.alias("feedback"))


def reply_pieces(lines: DataFrame) -> DataFrame:
    """Server-sent lines (reply_id, pos, line) as reply_id, pos, piece (what the line adds, or
    null), is_end. Blank, foreign and broken lines add nothing."""
    body = F.when(F.col("line").startswith("data:"), strip(F.substring("line", 6, 1 << 30)))
    return lines.select("reply_id", "pos", F.get_json_object(body, "$.choices[0].delta.content").alias("piece"), F.coalesce(body == "[DONE]", F.lit(False)).alias("is_end"))


def decode_reply_stream(lines: DataFrame) -> DataFrame:
    """reply_id, reply: the pieces of server-sent lines (reply_id, pos, line) up to the end mark."""
    data = reply_pieces(lines)
    ends = data.where("is_end").groupBy("reply_id").agg(F.min("pos").alias("end"))
    live = data.where("piece is not null").join(ends, "reply_id", "left").where("end is null or pos < end")
    joined = live.groupBy("reply_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "piece")))["piece"], "").alias("reply"))
    return lines.select("reply_id").distinct().join(joined, "reply_id", "left").withColumn("reply", or_empty(F.col("reply")))
