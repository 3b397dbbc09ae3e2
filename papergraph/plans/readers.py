"""Queries over readers' requests, conversation threads and reading events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papergraph.operators import dom as D
from papergraph.operators import generation, graph, html_graph, retrieval, threads
from papergraph.operators.html_graph import MATH_COLUMNS, TARGET_COLUMNS
from papergraph.plans import derived
from papergraph.plans.layout import LINES
from papergraph.plans.papers import N, NAMED, OBJECT_PARA, PARA, TARGETS, elements, found_targets
from papergraph.sources import store
from papergraph.sources.shared import shared_dir, stored
from papergraph.streaming import jobs


def _section_nodes(spark, sf_dir):
    """Section nodes of the derived papers, for callers that read them once."""
    return graph.target_nodes(found_targets(derived.html(spark, sf_dir)))


def _papers(spark, sf_dir, *more):
    """Elements and section nodes of the derived papers, with three symbols each; parsed once.
    ``more``: the roles of the elements that the caller reads besides mathematics and those that make targets."""
    columns = (*TARGET_COLUMNS, *MATH_COLUMNS, *(retrieval.EXCERPT_COLUMNS if "paragraph" in more else ()))
    dom = elements(spark, sf_dir, *NAMED, "math", *more, columns=columns)
    nodes = graph.target_nodes(html_graph.targets(dom))
    n = dom.where("tag = 'math'").groupBy("doc_id").agg(F.count("*").alias("n"))
    one = lambda k, token, count: F.struct(F.lit(token).alias("token"), count.alias("count"), F.lit(k).alias("ord"))
    symbols = n.select("doc_id", F.explode(F.array(one(1, "x_0", F.col("n")), one(2, "x_1", F.col("n")), one(3, "x", F.col("n") * 2))).alias("s")).select("doc_id", "s.*")
    none = spark.createDataFrame([], "doc_id long, ord int, name string, body string")
    return dom, nodes.unionByName(graph.symbol_nodes(none, symbols, html_graph.math_by_section(dom), nodes))


def _requests(spark, sf_dir):
    """A request a line: its section by its label, in other words and case, or an unknown phrase."""
    i = F.col("i")
    asked = F.when(i % 2 == 0, F.concat(F.lit(" (§"), i, F.lit("). "))).otherwise(F.concat(F.lit("phrase "), i))
    return derived.lines(spark, sf_dir).select(
        F.concat_ws(":", "doc_id", "i").alias("request_id"), "doc_id", asked.alias("selection"), F.lit("A paragraph.").alias("paragraph"), F.lit("").alias("section"), F.array(F.lit("§1")).alias("dependencies"), F.concat(F.lit("S"), i).alias("anchor")
    )


def _titles(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Paper "), "doc_id").alias("title"))


def retrieved_selections(spark, sf_dir):
    nodes = _section_nodes(spark, sf_dir)
    return retrieval.retrieve_selections(_requests(spark, sf_dir), nodes).select("request_id", "label", "anchor", "section_label")


def retrieved_symbols(spark, sf_dir):
    """Selections that are a symbol, answered by its definition; one that is defined by nothing is not."""
    dom, nodes = _papers(spark, sf_dir, "paragraph")
    defined = generation.define_symbols(nodes, dom, _titles(spark, sf_dir), generation.EchoProvider)
    asked = F.explode(F.array(*[F.lit(x) for x in ("  X_0. ", "(x_1)", "x_2", "§0")])).alias("selection")
    requests = derived.table(spark, sf_dir, "documents").select("doc_id", asked).select(F.concat_ws("|", "doc_id", "selection").alias("request_id"), "doc_id", "selection")
    return retrieval.retrieve_selections(requests, defined).select("request_id", "label", F.md5("content").alias("content_md5"), "anchor")


def resolved_requests(spark, sf_dir):
    """The cascade with a stand-in provider: what the graph knows is never sent."""
    nodes = graph.target_nodes(stored(found_targets(derived.html(spark, sf_dir)), "targets"))
    out = generation.resolve(_requests(spark, sf_dir), nodes, _titles(spark, sf_dir), generation.EchoProvider)
    return out.select("request_id", "mode", F.md5("content").alias("content_md5"), "label", "anchor", "section_label")


def resolve_prompts(spark, sf_dir):
    r = _requests(spark, sf_dir).join(_titles(spark, sf_dir), "doc_id")
    return generation.build_prompts(r, "resolve").select("request_id", F.md5("prompt").alias("prompt_md5"), "max_tokens")


def section_texts(spark, sf_dir):
    dom = elements(spark, sf_dir, "named")
    return retrieval.section_text(_requests(spark, sf_dir).select("request_id", "doc_id", "anchor"), dom).select("request_id", F.md5("text").alias("text_md5"))


def selection_contexts(spark, sf_dir):
    nodes = _section_nodes(spark, sf_dir)
    i = F.regexp_extract("anchor", r"(\d+)", 1).cast("int")
    asked = _requests(spark, sf_dir).select("request_id", "doc_id", "selection", "paragraph", F.col("anchor").alias("section_anchor"), F.array(F.concat(F.lit("S"), i - 1), F.col("anchor"), F.lit("nowhere")).alias("anchors"))
    return retrieval.selection_context(asked, nodes).select("request_id", "section", F.md5(F.array_join("dependencies", "|")).alias("dependencies_md5"))


def equation_contexts(spark, sf_dir):
    dom = D.dom_flatten(derived.html(spark, sf_dir), only=NAMED, columns=retrieval.EQUATION_COLUMNS)
    return retrieval.equation_context(_requests(spark, sf_dir).select("request_id", "doc_id", "anchor"), dom).select("request_id", "latex")


def object_equation_contexts(spark, sf_dir):
    """Every equation's LaTeX, section text and symbols, and the prompt made of them."""
    dom = D.dom_flatten(derived.object_html(spark, sf_dir), only=("equation",), columns=retrieval.EQUATION_COLUMNS)
    asked = derived.lines(spark, sf_dir).where("i % 6 = 1").select(F.concat_ws(":", "doc_id", "i").alias("request_id"), "doc_id", F.concat(F.lit("S"), "i", F.lit(".E1")).alias("anchor"))
    # the titles come first, so that the texts are shuffled once
    found = retrieval.equation_context(asked.join(_titles(spark, sf_dir), "doc_id"), dom)
    prompts = generation.build_prompts(found, "equation")
    return prompts.select("request_id", "latex", F.md5("context").alias("context_md5"), F.array_join("symbols", ",").alias("symbols"), F.md5("prompt").alias("prompt_md5"))


def symbol_paragraphs(spark, sf_dir):
    """Paragraphs in which x_1 stands: x_1, x_10 to x_19 and so on, four at most, and the prompt made of them."""
    dom = elements(spark, sf_dir, "math", "paragraph", columns=(*MATH_COLUMNS, *retrieval.EXCERPT_COLUMNS))
    asked = dom.select("doc_id").distinct().select("doc_id", F.lit("x_1").alias("label"))
    found = retrieval.symbol_excerpts(asked, dom)
    prompts = generation.build_prompts(found.join(_titles(spark, sf_dir), "doc_id"), "symbol")
    return prompts.select("doc_id", F.size("excerpts").alias("n"), F.md5("prompt").alias("prompt_md5"))


def checkpoint_prompts(spark, sf_dir):
    """Prompts about every section, with a recall for every second one."""
    dom = elements(spark, sf_dir, "named")
    asked = _requests(spark, sf_dir).withColumn("section_label", F.concat(F.lit("§"), F.substring("anchor", 2, 9))).withColumn("answer", F.when(F.col("selection").startswith("phrase"), F.col("selection")).otherwise(F.lit(" ")))
    rows = retrieval.section_text(asked.select("request_id", "doc_id", "anchor", "section_label", "answer"), dom)
    return generation.build_prompts(rows.join(_titles(spark, sf_dir), "doc_id"), "checkpoint").select("request_id", F.md5("prompt").alias("prompt_md5"), "max_tokens")


def notation(spark, sf_dir):
    _, nodes = _papers(spark, sf_dir)
    seen = _titles(spark, sf_dir).select("doc_id", F.array(F.lit("S0")).alias("sections"))
    return retrieval.notation_sheet(nodes, seen).select("doc_id", "label", F.col("place").cast("long").alias("place"), F.col("data.count").alias("n"))


def defined_symbols(spark, sf_dir):
    """Symbols with the stand-in provider's definitions."""
    dom, nodes = _papers(spark, sf_dir, "paragraph")
    out = generation.define_symbols(nodes, dom, _titles(spark, sf_dir), generation.EchoProvider)
    return out.where("kind = 'symbol'").select("doc_id", "label", F.col("data.definition_status").alias("status"), "excerpt")


def _replies(spark, sf_dir):
    i, word = F.col("i"), F.element_at(F.array(F.lit("hit"), F.lit("Partial"), F.lit("MISS")), (F.col("i") % 3 + 1).cast("int"))
    clean = F.regexp_replace("line", r"[^A-Za-z]+", "")
    line = F.when(clean == "", "noise").when(i % 4 == 3, F.concat(F.lit("`feedback: "), clean)).otherwise(F.concat(F.lit(" POINT "), word, F.lit(" : "), clean))
    li = derived.lines(spark, sf_dir).select("doc_id", "i", line.alias("line"))
    return li.groupBy(F.col("doc_id").alias("reply_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("raw"))


def checkpoint_points(spark, sf_dir):
    return generation.parse_checkpoints(_replies(spark, sf_dir))[0].select("reply_id", F.col("ord").cast("long").alias("ord"), "status", "point")


def checkpoint_feedback(spark, sf_dir):
    return generation.parse_checkpoints(_replies(spark, sf_dir))[1].select("reply_id", "feedback")


def decoded_streams(spark, sf_dir):
    """Replies streamed a line at a time, with broken lines and comments in between, the end
    mark after the last one and a line that comes too late."""
    li = derived.lines(spark, sf_dir)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("line").alias("content")).alias("delta"))).alias("choices")))
    more = F.when(F.col("i") % 3 == 0, "data: {broken").when(F.col("i") % 3 == 1, ": comment").otherwise('data: {"choices": []}')
    row = lambda at, line: F.struct(at.cast("long").alias("pos"), line.alias("line"))
    sent = li.select("doc_id", F.explode(F.array(row(F.col("i") * 2, F.concat(F.lit("data: "), body)), row(F.col("i") * 2 + 1, more))).alias("x")).select("doc_id", "x.*")
    end = li.groupBy("doc_id").agg((F.max("i") * 2 + 2).alias("end")).select("doc_id", F.explode(F.array(row(F.col("end"), F.lit("data: [DONE]")), row(F.col("end") + 1, F.lit('data: {"choices": [{"delta": {"content": "late"}}]}')))).alias("x")).select("doc_id", "x.*")
    return generation.decode_reply_stream(sent.unionByName(end).withColumnRenamed("doc_id", "reply_id")).select("reply_id", F.md5("reply").alias("reply_md5"))


def replies_postprocessed(spark, sf_dir):
    d, k = derived.table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    reply = F.when(k == 0, " needs_more_context.").when(k == 1, F.concat(F.lit("<think>a\nb</think> "), "lang")).otherwise(F.col("lang"))
    error = F.when(k == 3, "HTTP 429").when(k == 4, "boom")
    return generation.postprocess_reply(d.select("doc_id", reply.alias("reply"), error.alias("error"))).select("doc_id", "mode", "content")


def thread_list(spark, sf_dir):
    chats, messages, _ = derived.chats(spark, sf_dir)
    return threads.thread_summaries(chats, messages).select("chat_id", "doc_id", "section_label", F.col("question_count").cast("long").alias("question_count"), F.unix_timestamp("updated_at").alias("updated_s"))


def thread_histories(spark, sf_dir):
    _, messages, _ = derived.chats(spark, sf_dir)
    h = threads.thread_history(messages)
    return h.select("chat_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("history_md5"))


def thread_prompt_texts(spark, sf_dir):
    chats, messages, docs = derived.chats(spark, sf_dir)
    return threads.thread_prompts(chats, threads.thread_history(messages), docs).select("chat_id", F.md5("prompt").alias("prompt_md5"))


def newest_thread_places(spark, sf_dir):
    """Threads of each document, newest first."""
    chats, messages, _ = derived.chats(spark, sf_dir)
    return threads.newest_threads(threads.thread_summaries(chats, messages)).select("doc_id", "chat_id", F.col("place").cast("long").alias("place"))


def reopened_threads(spark, sf_dir):
    """Requests for every thread twice; a third of the threads exist, a document is unknown."""
    chats, _, docs = derived.chats(spark, sf_dir)
    asked = chats.select((F.col("chat_id") * 2).alias("request_id"), *threads.KEY).unionByName(chats.select((F.col("chat_id") * 2 + 1).alias("request_id"), *threads.KEY))
    out = threads.open_threads(asked, chats.where("chat_id % 3 = 0"), docs.where("doc_id != 7"))
    old = F.when(~F.col("created"), F.col("chat_id"))
    return out.select(old.alias("old_chat_id"), "doc_id", F.md5("selection").alias("selection_md5"), "section_anchor", "created")


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    single = table.inputFiles()[:1] and table.inputFiles()[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def _folder(spark, name):
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _messages(spark, sf_dir):
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60 + F.col("conv_id"))
    return _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content"), stamp.alias("ts"))


def streamed_thread_summaries(spark, sf_dir):
    """Thread counters kept by a streaming aggregation over the conversations."""
    folder = _folder(spark, "threads")
    jobs.stream_thread_table(_messages(spark, sf_dir).select("chat_id", "role", "ts"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return jobs.thread_table(spark, f"{folder}/table").select("chat_id", "question_count", F.unix_timestamp("updated_at").alias("updated_s"))


def _run_stateful(spark, rows, folder):
    """A stateful stream's whole output. A query keeps the settings that it starts with; these
    are put back (or unset) after: the state store that it needs, and no batches without data,
    which timers would ask for without end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": jobs.STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {key: spark.sql(f"SET {key}").first()["value"] for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        query = rows.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value == "<undefined>" else spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


def streamed_thread_history(spark, sf_dir):
    """Every turn with its number and the questions so far, kept by a stateful operator."""
    turns = _run_stateful(spark, jobs.stream_thread_history(_messages(spark, sf_dir)), _folder(spark, "history"))
    return turns.select("chat_id", "turn", "role", F.md5("content").alias("content_md5"), "question_count")


def appended_thread_turns(spark, sf_dir):
    """Every turn with its number and the questions so far, appended to a store: the first three
    turns by one stream, the others by a second that goes on from the counters."""
    folder = _folder(spark, "turns")
    for run, some in enumerate(("turn < 3", "turn >= 3")):
        jobs.stream_thread_turns(_messages(spark, sf_dir).where(some), f"{folder}/table", f"{folder}/checkpoint-{run}").awaitTermination()
    return jobs.thread_turns(spark, f"{folder}/table").select("chat_id", "turn", "role", F.md5("content").alias("content_md5"), "question_count")


def streamed_replies(spark, sf_dir):
    """Every turn of the conversations as a reply streamed a word a line, with comments between
    and an end mark, put together by a stateful operator."""
    words = F.split("text", " ", -1)
    body = lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content")).alias("delta"))).alias("choices"))))
    lines = F.concat(F.flatten(F.transform(words, lambda w: F.array(body(F.concat(w, F.lit("|"))), F.lit(": a comment")))), F.array(F.lit("data: [DONE]"), F.lit('data: {"choices": [{"delta": {"content": "late"}}]}')))
    sent = _stream(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), F.posexplode(lines).alias("pos", "line"))
    out = _run_stateful(spark, jobs.stream_replies(sent), _folder(spark, "replies"))
    return out.select("reply_id", F.md5("reply").alias("reply_md5"), "finished")


def streamed_threads(spark, sf_dir):
    """Threads that streamed requests create: two requests a thread, of which a third is there."""
    chats, _, docs = derived.chats(spark, sf_dir)
    turns = _stream(spark, sf_dir, "conversations").where("turn < 2")
    asked = turns.select((F.col("conv_id") * 2 + F.col("turn")).alias("request_id"), (F.col("conv_id") % 50).alias("doc_id"), F.concat(F.lit("passage "), F.col("conv_id") % 60).alias("selection"), F.concat(F.lit("S"), F.col("conv_id") % 5).alias("section_anchor"))
    old = chats.where("chat_id % 3 = 0").select("doc_id", F.concat(F.lit("passage "), F.col("chat_id") % 60).alias("selection"), "section_anchor")
    out = _run_stateful(spark, jobs.stream_open_threads(asked, docs.where("doc_id != 7"), old), _folder(spark, "opened"))
    return out.select("request_id", "doc_id", "selection", "section_anchor")


def streamed_ingest(spark, sf_dir):
    """Documents ingested as they come: by one stream two of three, by a second with a checkpoint
    of its own all, of which it finds those ready. Nodes and edges by document."""
    folder = _folder(spark, "ingest")

    def build(papers):
        dom = stored(D.dom_flatten(derived.html_of(papers.select("doc_id", "text")), only=TARGETS), "ingested")
        return graph.target_nodes(html_graph.targets(dom)), html_graph.edges(dom)

    for run in range(2):
        some = "text is not null" if run else "text is not null and doc_id % 3 != 0"
        landing = _stream(spark, sf_dir, "documents").where(some).select("doc_id", F.concat(F.lit("key-"), "doc_id").alias("doc_key"), "text")
        jobs.stream_ingest(landing, folder, f"{folder}/checkpoint-{run}", build).awaitTermination()
    back = store.read_graph(spark, folder)
    nodes = back.nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    edges = back.edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    return back.documents.select("doc_id").join(nodes, "doc_id", "left").join(edges, "doc_id", "left").select("doc_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def streamed_sections(spark, sf_dir):
    """Sections finished by each reader, from a stream of events whose repeats are dropped."""
    folder = _folder(spark, "sections")
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 10).alias("doc_id"), F.col("event_type").alias("anchor"), F.col("ts").cast("timestamp").alias("ts"))
    once = jobs.sections_finished(events)
    query = once.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/table").select("session", "doc_id", "anchor").distinct()


def finished_sections(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("session"), (F.col("event_id") % 10).alias("doc_id"), F.col("event_type").alias("anchor"), "ts")
    return jobs.sections_finished(events).select("session", "doc_id", "anchor", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


QUERIES = {f.__name__: f for f in (
    retrieved_selections, retrieved_symbols, resolved_requests, resolve_prompts, section_texts, selection_contexts, equation_contexts, symbol_paragraphs, notation, defined_symbols, object_equation_contexts, checkpoint_prompts, checkpoint_points, checkpoint_feedback,
    decoded_streams, replies_postprocessed, thread_list, thread_histories, thread_prompt_texts, newest_thread_places, reopened_threads, streamed_thread_summaries, streamed_thread_history, appended_thread_turns, streamed_replies, streamed_threads, streamed_ingest, streamed_sections, finished_sections,
)}

Q = f"WITH {LINES}, r AS (SELECT *, doc_id || ':' || i AS request_id FROM l)"


def _prompt(*parts: str) -> str:
    """SQL of a prompt's hash; NL stands for a line's end in plain parts, SQL terms come in braces."""
    terms = (p[1:-1] if p.startswith("{") else "'" + p.replace("'", "''").replace("NL", "' || chr(10) || '") + "'" for p in parts)
    return f"md5({' || '.join(terms)})"


OPEN, END = "NL<<<NL", "NL>>>NLNL"
HEAD = ("From the paper titled Paper ", "{doc_id}", ".NLNL")
SECTION_TEXT = f"left(trim(i || ' Part ' || i || ' ' || {PARA}), 6000)"
CLEAN = "regexp_replace(line, '[^A-Za-z]+', '', 'g')"
CHAT = """c AS (SELECT conv_id, arg_min(text, turn) AS f FROM conversations GROUP BY conv_id)"""
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
SQL = {
    "retrieved_selections": f"{Q} SELECT request_id, '§' || i AS label, 'S' || i AS anchor, '§' || i AS section_label FROM r WHERE i % 2 = 0",
    "retrieved_symbols": f"WITH {LINES}, k AS (SELECT doc_id, unnest(['x_0', 'x_1']) AS s, unnest(['  X_0. ', '(x_1)']) AS q FROM documents), h AS (SELECT k.doc_id, s, q FROM k JOIN l USING (doc_id) GROUP BY ALL HAVING max((starts_with('x_' || i, s) AND {PARA} <> '')::INT) = 1) SELECT doc_id || '|' || q AS request_id, s AS label, md5('Task: say what this symbol stands for: ' || s) AS content_md5, '' AS anchor FROM h UNION ALL SELECT doc_id || '|§0', '§0', md5(i || ' Part ' || i || ' — ' || left({PARA}, 300)), 'S0' FROM l WHERE i = 0",
    "resolved_requests": f"{Q} SELECT request_id, 'retrieved' AS mode, md5(i || ' Part ' || i || ' — ' || left({PARA}, 300)) AS content_md5, '§' || i AS label, 'S' || i AS anchor, '§' || i AS section_label FROM r WHERE i % 2 = 0 UNION ALL SELECT request_id, 'generated', md5('Task: say what the marked span means here.'), '', '', '' FROM r WHERE i % 2 = 1",
    "resolve_prompts": Q + " SELECT request_id, " + _prompt(*HEAD, f"Paragraph:{OPEN}A paragraph.{END}It belongs to section: not knownNLObjects near it:NL- §1NLNLWhat the reader marked:{OPEN}", "{CASE WHEN i % 2 = 0 THEN '(§' || i || ').' ELSE 'phrase ' || i END}", f"{END}Task: say what the marked span means here.") + " AS prompt_md5, 400 AS max_tokens FROM r",
    "checkpoint_prompts": Q + " SELECT request_id, " + _prompt(*HEAD, f"Section:{OPEN}", "{" + SECTION_TEXT + "}", f"{END}It is headed: §", "{i}", f"NLNLWhat the reader recalls:{OPEN}", "{CASE WHEN i % 2 = 0 THEN '(nothing; show the points)' ELSE 'phrase ' || i END}", f"{END}Task: compare the two.") + " AS prompt_md5, 600 AS max_tokens FROM r",
    "object_equation_contexts": f"WITH {LINES}, c AS (SELECT *, doc_id || ':' || i AS request_id, left(i || ' Part ' || i || ' ' || {OBJECT_PARA} || ' y = y (' || i || ')', 1500) AS context FROM l WHERE i % 6 = 1)"
    + " SELECT request_id, 'y_{' || i || '} = z' AS latex, md5(context) AS context_md5, 'y,=' AS symbols, " + _prompt(*HEAD, f"LaTeX of an equation:{OPEN}y_{{", "{i}", f"}} = z{END}Text around it:{OPEN}", "{trim(context)}", f"{END}Its symbols:NL- yNL- =NLNLTask: say what the equation states.") + " AS prompt_md5 FROM c",
    "symbol_paragraphs": f"WITH {LINES}, h AS (SELECT doc_id, i, {PARA} AS t FROM l WHERE starts_with('x_' || i, 'x_1')), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left(t, 80) ORDER BY i) AS n FROM h), k AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o WHERE n = 1 AND t <> ''),"
    + " g AS (SELECT doc_id, count(*)::INT AS n, string_agg(left(t, 400), chr(10) ORDER BY n) AS x FROM k WHERE n <= 4 GROUP BY doc_id) SELECT doc_id, n, " + _prompt(*HEAD, f"Places where the symbol stands:{OPEN}", "{x}", f"{END}Task: say what this symbol stands for: x_1") + " AS prompt_md5 FROM g",
    "defined_symbols": f"WITH {LINES}, k AS (SELECT doc_id, unnest(['x_0', 'x_1', 'x']) AS s FROM documents WHERE text IS NOT NULL), h AS (SELECT k.doc_id, s, max((starts_with('x_' || i, s) AND {PARA} <> '')::INT) AS found FROM k JOIN l USING (doc_id) GROUP BY k.doc_id, s) SELECT doc_id, s AS label, CASE WHEN found = 1 THEN 'grounded' ELSE 'undefined' END AS status, CASE WHEN found = 1 THEN 'Task: say what this symbol stands for: ' || s ELSE '' END AS excerpt FROM h",
    "section_texts": f"{Q} SELECT request_id, md5({SECTION_TEXT}) AS text_md5 FROM r",
    "selection_contexts": f"{Q}, e AS (SELECT doc_id, i, '§' || i || ': ' || left(i || ' Part ' || i || ' — ' || left({PARA}, 300), 120) AS e FROM l) SELECT request_id, '§' || r.i AS section, md5(CASE WHEN b.e IS NULL THEN '' ELSE b.e || '|' END || a.e) AS dependencies_md5 FROM r JOIN e a USING (doc_id, i) LEFT JOIN e b ON b.doc_id = r.doc_id AND b.i = r.i - 1",
    "equation_contexts": f"{Q} SELECT request_id, 'x_{{' || i || '}}' AS latex FROM r",
    "notation": N + " SELECT doc_id, unnest(['x', 'x_0']) AS label, unnest([1, 2])::BIGINT AS place, unnest([2 * n, n]) AS n FROM n",
    "checkpoint_points": f"WITH {LINES} SELECT doc_id AS reply_id, i AS ord, ['hit', 'partial', 'miss'][i % 3 + 1] AS status, {CLEAN} AS point FROM l WHERE i % 4 <> 3 AND {CLEAN} <> ''",
    "checkpoint_feedback": f"WITH {LINES}, t AS (SELECT doc_id, arg_max(CASE WHEN i % 4 = 3 AND {CLEAN} <> '' THEN {CLEAN} END, i) AS f, count(*) FILTER (i % 4 <> 3 AND {CLEAN} <> '') AS n, string_agg('noise', chr(10)) AS raw FROM l GROUP BY doc_id) SELECT doc_id AS reply_id, CASE WHEN f IS NULL AND n = 0 THEN left(raw, 400) ELSE coalesce(f, '') END AS feedback FROM t",
    "decoded_streams": f"WITH {LINES} SELECT doc_id AS reply_id, md5(string_agg(line, '' ORDER BY i)) AS reply_md5 FROM l GROUP BY doc_id",
    "replies_postprocessed": f"SELECT doc_id, ['abstained', 'generated', 'generated', 'error', 'error'][doc_id % 5 + 1] AS mode, ['{generation.ABSTAIN_MESSAGE}', coalesce(trim(lang), ''), coalesce(trim(lang), ''), '{generation.RATE_MESSAGE}', '{generation.ERROR_MESSAGE}'][doc_id % 5 + 1] AS content FROM documents",
    "thread_list": "SELECT conv_id AS chat_id, conv_id % 50 AS doc_id, '§' || (conv_id % 5) AS section_label, count(*) FILTER (role = 'user') AS question_count, max(1700000000 + turn * 60 + conv_id) AS updated_s FROM conversations GROUP BY conv_id",
    "thread_histories": "SELECT conv_id AS chat_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS history_md5 FROM conversations GROUP BY conv_id",
    "thread_prompt_texts": "WITH " + CHAT + f""", t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '> ' ELSE 'Assistant > ' END || {STRIP.format("text")} || chr(10), '' ORDER BY turn, role, text) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id AS chat_id, """ + _prompt("A reader's thread on the paper titled Paper ", "{(conv_id % 50)}", ", section §", "{(conv_id % 5)}", f".NLNLParagraph:{OPEN}", "{" + STRIP.format("left(f, 200)") + "}", END, "{CASE WHEN " + STRIP.format("left(f, 40)") + " = '' THEN '' ELSE 'What the reader marked first:' || chr(10) || '<<<' || chr(10) || " + STRIP.format("left(f, 40)") + " || chr(10) || '>>>' || chr(10) || chr(10) END}", f"Objects near it:{OPEN}- Eq. (1)NL- [2]{END}Turns (the reader's start with >):NL", "{x}", "Assistant >") + " AS prompt_md5 FROM c JOIN t USING (conv_id)",
    "newest_thread_places": "WITH s AS (SELECT conv_id, max(1700000000 + turn * 60 + conv_id) AS u FROM conversations GROUP BY conv_id) SELECT conv_id % 50 AS doc_id, conv_id AS chat_id, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY u DESC, conv_id DESC) AS place FROM s",
    "streamed_thread_history": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id AS chat_id, n AS turn, role, md5(text) AS content_md5, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS question_count FROM t",
    "appended_thread_turns": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id AS chat_id, n AS turn, role, md5(text) AS content_md5, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS question_count FROM t",
    "streamed_replies": "SELECT conv_id || '-' || turn AS reply_id, md5(replace(text, ' ', '|') || '|') AS reply_md5, TRUE AS finished FROM conversations WHERE text IS NOT NULL",
    "streamed_threads": "WITH a AS (SELECT conv_id * 2 + turn AS request_id, conv_id % 50 AS doc_id, 'passage ' || (conv_id % 60) AS selection, 'S' || (conv_id % 5) AS section_anchor FROM conversations WHERE turn < 2), o AS (SELECT DISTINCT conv_id % 50 AS doc_id, 'passage ' || (conv_id % 60) AS selection, 'S' || (conv_id % 5) AS section_anchor FROM conversations WHERE conv_id % 3 = 0) SELECT min(request_id) AS request_id, doc_id, selection, section_anchor FROM a ANTI JOIN o USING (doc_id, selection, section_anchor) WHERE doc_id <> 7 GROUP BY ALL",
    "streamed_ingest": N + " SELECT doc_id, n AS n_nodes, n - 1 AS n_edges FROM n",
    "reopened_threads": "WITH " + CHAT + """, k AS (SELECT conv_id, conv_id % 50 AS d, left(f, 40) AS s, conv_id % 5 AS a FROM c), e AS (SELECT * FROM k WHERE conv_id % 3 = 0)
SELECT conv_id AS old_chat_id, d AS doc_id, md5(s) AS selection_md5, 'S' || a AS section_anchor, FALSE AS created FROM e WHERE d <> 7 UNION ALL SELECT NULL, d, md5(s), 'S' || a, TRUE FROM (SELECT DISTINCT d, s, a FROM k WHERE d <> 7 EXCEPT SELECT d, s, a FROM e)""",
    "streamed_thread_summaries": "SELECT conv_id AS chat_id, count(*) FILTER (role = 'user') AS question_count, max(1700000000 + turn * 60 + conv_id) AS updated_s FROM conversations GROUP BY conv_id",
    "streamed_sections": "SELECT DISTINCT user_id AS session, event_id % 10 AS doc_id, event_type AS anchor FROM events",
    "finished_sections": "SELECT user_id AS session, event_id % 10 AS doc_id, event_type AS anchor, min(epoch_us(ts)) AS ts_us FROM events GROUP BY 1, 2, 3",
}
