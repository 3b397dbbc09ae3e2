"""Provider calls: stored once, retried on rate limits, shared by later calls."""

import os
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from papergraph.operators import generation

ASKED = "id long, system string, prompt string, max_tokens int"


def counting(folder, script):
    """A provider that notes each call and answers by ``script(prompt, nth call of it)``."""

    class Counting(generation.Provider):
        def is_configured(self):
            return True

        def generate(self, system, prompt, max_tokens):
            name = prompt.replace(" ", "_")
            nth = sum(f.startswith(name + "-") for f in os.listdir(folder)) + 1
            tempfile.mkstemp(prefix=name + "-", dir=folder)
            return script(prompt, nth)

    return Counting


def calls(folder):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def test_a_request_is_sent_once_however_often_it_is_read(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    prompts = spark.createDataFrame([(k, "s", f"p{k % 4}", 9) for k in range(20)] + [(99, "s", "p0", 8), (98, "sp", "0", 9)], ASKED)
    provider = counting(str(seen), lambda p, n: f"{p}!")
    for kept in (None, store):
        before = calls(str(seen))
        out = generation.generate(prompts, provider, tasks=3, store=kept)
        for _ in range(2):
            assert sorted((r["id"], r["reply"], r["error"]) for r in out.collect()) == sorted([(k, f"p{k % 4}!", None) for k in range(20)] + [(99, "p0!", None), (98, "0!", None)])
        out.groupBy("reply").count().collect()
        assert calls(str(seen)) - before == Counter({"p0": 2, "p1": 1, "p2": 1, "p3": 1, "0": 1})
    before = calls(str(seen))
    more = prompts.where("id < 3").unionByName(spark.createDataFrame([(50, "s", "new", 9)], ASKED))
    assert generation.generate(more, provider, store=store).count() == 4
    held, sent = sorted(map(str, generation.stored_replies(spark, store).collect())), len(calls(seen))
    assert generation.compact_replies(spark, store) and generation.compact_replies(spark, store) is None
    assert sorted(map(str, generation.stored_replies(spark, store).collect())) == held
    assert generation.generate(more, provider, store=store).count() == 4 and len(calls(seen)) == sent
    assert calls(str(seen)) - before == Counter({"new": 1})


def test_rate_limits_are_waited_for_and_failures_asked_again(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()

    def script(prompt, nth):
        if prompt == "slow" and nth < 3:
            raise RuntimeError("HTTP 429: Rate Limit")
        if prompt == "never":
            raise RuntimeError("quota used up")
        if prompt == "broken" and nth == 1:
            raise ValueError
        return prompt

    prompts = spark.createDataFrame([(k, "s", p, 1) for k, p in enumerate(("slow", "never", "broken", "fine"))], ASKED)
    provider = counting(str(seen), script)
    ask = lambda: {r["prompt"]: (r["reply"], r["error"]) for r in generation.generate(prompts, provider, store=store, wait=0.01).collect()}
    assert ask() == {"slow": ("slow", None), "never": (None, "quota used up"), "broken": (None, "ValueError"), "fine": ("fine", None)}
    assert calls(str(seen)) == Counter({"slow": 3, "never": 3, "broken": 1, "fine": 1})
    assert ask()["broken"] == ("broken", None)
    assert calls(str(seen)) == Counter({"slow": 3, "never": 6, "broken": 2, "fine": 1})
    shown = generation.postprocess_reply(generation.generate(prompts, provider, store=store, attempts=1)).where("prompt = 'never'").first()
    assert (shown["mode"], shown["content"]) == ("error", generation.RATE_MESSAGE)


def test_settled_definitions_and_stored_ones_are_not_asked_again(spark, tmp_path):
    from papergraph.operators.graph import DATA

    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    status = F.named_struct(*[x for n in ("excerpt_html", "section_label", "grounded", "source", "label_mathml", "definition_status", "sections", "macro_name", "count") for x in (F.lit(n), F.lit("unresolved") if n == "definition_status" else F.lit(None))])
    nodes = spark.createDataFrame([(1, 1, "symbol", "d_k", "")], "doc_id long, node_ord long, kind string, label string, excerpt string").withColumn("data", status.cast(DATA))
    dom = spark.createDataFrame([(1, 5, "math", "d_k", 4, "", False, None), (1, 4, "p", "", None, "where d_k is the width", False, None)], "doc_id long, pos int, tag string, alttext string, para_pos int, text string, hidden boolean, error string")
    docs = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    provider = counting(str(seen), lambda p, n: "the width")
    provider.generate = lambda self, system, prompt, max_tokens: (tempfile.mkstemp(prefix="call-", dir=str(seen)), "the width")[1]
    first = generation.define_symbols(nodes, dom, docs, provider, store=store)
    assert (first.first()["excerpt"], first.first()["data"]["definition_status"]) == ("the width", "grounded")
    assert generation.define_symbols(first, dom, docs, provider, store=store).first()["excerpt"] == "the width"
    assert generation.define_symbols(nodes, dom, docs, provider, store=store).first()["excerpt"] == "the width"
    assert len(os.listdir(seen)) == 1


def test_no_prompts_no_calls(spark, tmp_path):
    none = spark.createDataFrame([], ASKED)
    assert generation.generate(none, generation.EchoProvider).collect() == []
    assert generation.stored_replies(spark, str(tmp_path)) is None
