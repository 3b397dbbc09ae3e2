"""Paper operators on small examples with exact expected values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papergraph.functions import text as T
from papergraph.operators import admission, citations, dom, generation, graph, html_graph, latex, layout, retrieval, threads
from papergraph.sources import landed, store
from papergraph.streaming import jobs

#: A short paper on tides, with each kind of object once.
PAPER = """<html><head><style>p{}</style></head><body><article><h1 class="ltx_title ltx_title_document">Tides in
 Narrow Straits</h1><div class="ltx_authors">Noor van Dijk <a href="#H">x</a></div>
<section class="ltx_section" id="H"><h2 class="ltx_title"><span class="ltx_tag">1.</span> Height</h2>
<p class="ltx_p">By <a href="#H.E4">eq</a>, <a href="#lag">that lemma</a> and <a href="#bib.darwin">Darwin</a>; not <a href="#gone">this</a>.</p>
<div class="ltx_equation" id="H.E4"><math alttext="h_{0}=\\frac{g}{c}"><mi>h</mi><mo>=</mo><mi>g</mi><mi>gravity</mi></math><span class="ltx_tag">(4)</span></div>
<script>if (a < b) { document.write("</p>"); }</script></section>
<section class="ltx_section" id="F"><h2 class="ltx_title">Flow</h2>
<div class="ltx_theorem" id="lag"><h6 class="ltx_title"><span class="ltx_tag">Lemma 9</span></h6><p class="ltx_p" onclick="go()">The lag <math alttext="\\tau_{s}"></math> grows.</p></div>
<figure class="ltx_figure" id="F.F2"><img src="map.svg" onerror="y()"><img src="https://tides.example/a.png"><figcaption class="ltx_caption"><span class="ltx_tag">Figure 2: </span>The strait.</figcaption></figure></section>
<ol><li class="ltx_bibitem" id="bib.darwin"><span class="ltx_tag">[D98]</span> G. Darwin. The Tides. 1898.</li></ol></article></body></html>"""

TEX = r"""% a draft
\documentclass{report}
\newcommand*{\lag}{\hat{\tau}}
\renewcommand \mean [2] {\mathbf{#1}_{#2}}
\DeclareMathOperator*{\argmin}{arg\,min}
\newtheorem{note}[lag]{Useful Remark}
\begin{document}
\section*{Height {\em above} zero}\label{s:height}
Of the water 30\% moves, as \citep[p.~4]{darwin, kelvin} say; see \autoref{s:flow,e:rise}. % \cite{nobody}
\begin{align*}\label{e:rise} h_{0} &= \gamma^{2} + M_2 \end{align*}
\[ h_{0} + M_2 \] and \( h_0 - M_2 \) but $x$ and $\gamma^2$, $\gamma^2$.
\subsection{Flow \textbf{now}}
\label{s:flow}
\begin{note}[Lag]\label{n:lag}
The lag $\lag$ is \emph{never} negative.
\end{note}
\begin{thebibliography}{2}
\bibitem[Dar]{darwin} G. Darwin, {\it The Tides}, 1898.
\bibitem{kelvin} Lord Kelvin, Harmonic analysis.
\end{thebibliography}
\end{document}
"""


def column(spark, values, use):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(use(F.col("x"))).collect()]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def elements(spark):
    papers = spark.createDataFrame([(1, PAPER)], "doc_id long, html string")
    return dom.dom_flatten(papers).persist()


@pytest.fixture(scope="module")
def source(spark):
    return latex.sources(spark.createDataFrame([(1, TEX)], "doc_id long, tex string"))


def test_text_functions(spark):
    assert column(spark, ["  (Lemma 2). ", None, "W^Q", "a\u00a0 b"], T.norm_text) == ["lemma 2", "", "w^q", "a b"]
    assert column(spark, ["arXiv:1706.03762v5", "https://arxiv.org/pdf/1706.03762.pdf", "hep-th/9901001", "x1706.03762", None], T.normalize_paper_id) == ["1706.03762v5", "1706.03762", "hep-th/9901001", None, None]
    forms = {"https://www.ar5iv.labs.arxiv.org/html/2101.00001/": "2101.00001", "HTTP://ARXIV.ORG/ABS/math.GT/0309136v12": "math.GT/0309136v12", "arxiv: 1234.5678": "1234.5678", "https://arxiv.org/pdf/hep-th/9901001.PDF": "hep-th/9901001"}
    refused = ["https://arxiv.org/list/1706.03762", "https://arxiv.org.evil/abs/1706.03762", "1706.037", "1706.037621", "a.bc/9901001", "a.BCD/9901001", "/9901001", "1706.03762v", "1706.03762w1", "1.2.3", ""]
    assert column(spark, [*forms, *refused], T.normalize_paper_id) == [*forms.values(), *[None] * len(refused)]
    assert column(spark, ["∑ x_{i} + β = 1 (3)", "plain prose of words", "=="], T.is_display_equation) == [True, False, False]
    assert column(spark, [r"\emph{All} you  need"], T.clean_text) == ["All you need"]
    assert column(spark, [r"a % b", r"5\% c"], T.strip_comments) == ["a ", r"5\% c"]
    assert column(spark, ["<think>a\nb</think> yes"], generation.without_thoughts) == ["yes"]


def test_html_graph(spark, elements):
    header = html_graph.document_header(elements).first()
    assert (header["title"], header["authors"]) == ("Tides in Narrow Straits", "Noor van Dijk x")
    found = html_graph.targets(elements)
    targets = {r["anchor"]: r for r in found.collect()}
    assert sorted(targets, key=lambda k: targets[k]["ord"]) == ["H.E4", "lag", "bib.darwin", "F.F2", "H", "F"]
    assert [(targets[k]["kind"], targets[k]["label"], targets[k]["section_label"]) for k in targets] == [
        ("equation", "Eq. (4)", "§1"), ("theorem", "Lemma 9", "Flow"), ("citation", "[D98]", "References"), ("figure", "Figure 2", "Flow"), ("section", "§1.", "§1"), ("section", "§Lemma 9", "Flow"),
    ]
    assert targets["H.E4"]["excerpt"] == r"h_{0}=\frac{g}{c}" and targets["H.E4"]["excerpt_html"].startswith('<math alttext="h_{0}=') and targets["H.E4"]["excerpt_html"].endswith("<mi>gravity</mi></math>")
    assert targets["lag"]["excerpt"] == "Lemma 9 The lag grows." and '<p class="ltx_p" onclick="go()">' in targets["lag"]["excerpt_html"]
    assert targets["F.F2"]["excerpt"] == "Figure 2: The strait." and targets["F"]["excerpt"] == "Flow — The lag grows."
    assert rows(html_graph.occurrences(elements, found), "pos", "section_anchor", "target_anchor", "kind")[0][1:] == ("H", "H.E4", "references")
    assert sorted(r[1:] for r in rows(html_graph.occurrences(elements, found), "section_anchor", "target_anchor", "kind")) == [("H.E4", "references"), ("bib.darwin", "cites"), ("lag", "references")]
    assert rows(html_graph.math_by_section(elements), "section_anchor", "blob") == [("F", r"\tau_s"), ("H", r"h_0=\fracgc")]
    assert rows(html_graph.asset_manifest(elements, "/a"), "path", "served_url") == [("map.svg", "/a/map.svg")]
    both = elements.select("pos", "section_anchor").join(html_graph.enclosing_sections_by_sweep(elements).withColumnRenamed("section_anchor", "j"), "pos")
    assert both.where("section_anchor != j").count() == 0
    asked = spark.createDataFrame([(1, 1, "H.E4"), (2, 1, "none")], "request_id long, doc_id long, anchor string")
    context = retrieval.equation_context(asked, elements).collect()
    assert [(r["latex"], r["symbols"]) for r in context] == [(r"h_{0}=\frac{g}{c}", ["h", "=", "g"])] and context[0]["context"].startswith("1. Height By eq")
    paper = spark.createDataFrame([(1, PAPER, "N. van Dijk & Co", "/a")], "doc_id long, html string, byline string, asset_prefix string")
    out = dom.annotate_html(paper, found).first()
    html = out["html"]
    assert out["error"] is None and not any(x in html for x in ("<script", "<style", "onclick", "onerror", "Noor"))
    assert '<a href="#lag" data-anchor="lag" data-anchor-kind="theorem">that lemma</a>' in html and '<a href="#gone">this</a>' in html
    assert '<img src="/a/map.svg" loading="lazy"><img src="https://tides.example/a.png">' in html and '<div class="ltx_authors">N. van Dijk &amp; Co</div>' in html


def test_deep_nesting_ends_no_job(spark):
    deep = [("<div>" * 5000) + "core" + "</div>" * 5000, "<b>" * 5000 + "x", '<section id="s" class="ltx_theorem"><p class="ltx_p">' + "<i>" * 3000]
    papers = spark.createDataFrame([(i, h, None, None) for i, h in enumerate(deep)], "doc_id long, html string, byline string, asset_prefix string")
    got = dom.dom_flatten(papers)
    assert rows(got.where("error is null").groupBy("doc_id").count(), "doc_id", "count") == [(0, 5000), (1, 5000), (2, 3002)]
    out = dom.annotate_html(papers, html_graph.targets(got)).collect()
    assert [r["error"] for r in out] == [None] * 3 and {len(r["html"]) for r in out if r["doc_id"] == 0} == {5000 * 11 + 4}


def test_dom_tolerates_broken_markup(spark):
    bad = "<p>one<p>two<b>bold</p><ul><li>a<li>b</ul></div></i><table><tr><td>1<td>2<tr><td>3</table>"
    got = dom.dom_flatten(spark.createDataFrame([(1, bad), (2, None), (3, "")], "doc_id long, html string"))
    counts = {r[0]: r[1] for r in got.where("doc_id = 1").groupBy("tag").count().collect()}
    assert counts == {"p": 2, "b": 1, "ul": 1, "li": 2, "table": 1, "tr": 2, "td": 3}
    assert got.where("error is not null").count() == 0


def test_latex_scans(source):
    assert dict(rows(latex.labels(source), "label", "kind")) == {"s:height": "document", "e:rise": "align*", "s:flow": "document", "n:lag": "note"}
    assert [r[1] for r in rows(latex.refs(source), "ord", "ref")] == ["s:flow", "e:rise"]
    assert [r[1] for r in rows(latex.cite_keys(source), "ord", "key")] == ["darwin", "kelvin"]
    assert rows(latex.bibliography(source), "ord", "key", "text") == [(0, "darwin", "G. Darwin, The Tides, 1898."), (1, "kelvin", "Lord Kelvin, Harmonic analysis.")]
    assert [r[1:] for r in rows(latex.macros(source), "ord", "name", "body")] == [("lag", r"\hat{\tau}"), ("mean", r"\mathbf{#1}_{#2}"), ("argmin", r"arg\,min")]
    assert rows(latex.theorems(source), "kind", "title", "label", "statement") == [("remark", "Lag", "n:lag", r"The lag $ $ is never negative.")]
    assert [r[1:] for r in rows(latex.tex_sections(source), "ord", "level", "title", "label")] == [("section", "Height above zero", "s:height"), ("subsection", "Flow now", "s:flow")]
    assert rows(latex.symbols(source), "ord", "token", "count") == [(1, "h_0", 3), (2, r"\gamma^2", 3), (3, "M_2", 3)]
    assert rows(latex.symbols(source, least=1, most=1), "ord", "token") == [(1, "h_0")]


def test_graph_merge(spark, elements):
    macros = spark.createDataFrame([(1, 1, "lag", r"\hat{\tau}"), (1, 2, "mean", r"\mathbf{#1}_{#2}"), (1, 3, "plain", "q")], "doc_id long, ord int, name string, body string")
    symbols = spark.createDataFrame([(1, "h_0", 5, 1)], "doc_id long, token string, count long, ord int")
    nodes = graph.symbol_nodes(macros, symbols, html_graph.math_by_section(elements))
    got = {r["label"]: r for r in nodes.collect()}
    assert set(got) == {r"\hat{\tau}", "h_0"} and got["h_0"]["excerpt"] == "" and got["h_0"]["data"]["definition_status"] == "unresolved"
    assert got["h_0"]["data"]["sections"] == ["H"] and got["h_0"]["data"]["count"] == 5
    targets = html_graph.targets(elements)
    all_nodes = graph.target_nodes(targets)
    edges = graph.resolve_edges(html_graph.occurrences(elements, targets), all_nodes)
    assert {r[0] for r in rows(edges, "kind")} == {"references", "cites"}
    loose = spark.createDataFrame([(1, "", "H.E4", "references"), (1, "S9", "H.E4", "references"), (1, "H", "nowhere", "references")], "doc_id long, section_anchor string, target_anchor string, kind string")
    assert [r["source_node_ord"] == r["target_node_ord"] for r in graph.resolve_edges(loose, all_nodes).collect()] == [True, True]
    docs = spark.createDataFrame([(1, "k")], "doc_id long, doc_key string")
    assert '"edges":[{' in landed.export_graph_json(docs, all_nodes, edges).first()["json"]


#: A page of a report: text, size, bold.
REPORT = (
    ("On the Keeping of Bees", 20.0, False), ("Permission to copy is granted.", 9.0, False), ("Mira Okafor, T. Lund and Ana Sousa", 10.5, False), ("University of Hives, mira@hive.example", 9.0, False),
    ("1. Queens", 13.0, True), ("A hive has one queen [2], which earlier work [1–3; 9] and others [3, 7] take for granted.", 10.0, False), ("SWARMING", 10.0, True), ("They leave in May [2] when the weather is fair.", 10.0, False),
    ("Works cited", 13.0, True), ("[1] K. Frisch. Dancing bees.", 10.0, False), ("[2] L. Huber. The queen. [3] E. Aristotle.", 10.0, False),
)


def page(spark):
    data = [(1, 0, k, "text", 60.0, 50.0 + 30 * k, 280.0, 62.0 + 30 * k, t, size, bold, 600.0) for k, (t, size, bold) in enumerate(REPORT)]
    return spark.createDataFrame(data, "doc_id long, page int, seq int, kind string, x0 double, y double, x1 double, y1 double, text string, size double, bold boolean, page_width double")


def test_layout_to_article(spark):
    blocks = layout.reading_order(page(spark))
    titles = layout.pick_title(blocks, layout.body_size(blocks))
    assert titles.first()["title"] == "On the Keeping of Bees"
    meta = spark.createDataFrame([(1, " Bees "), (2, "x")], "doc_id long, meta_title string")
    assert layout.pick_title(blocks.where("size < 11"), layout.body_size(blocks), meta).first()["title"] == "Bees"
    sections, content, front = layout.segment(blocks, titles)
    assert [r[1:] for r in rows(sections, "section_no", "anchor", "heading", "label", "is_refs")] == [("S1", "Queens", "§1", False), ("S2", "SWARMING", "SWARMING", False), ("S3", "Works cited", "Works cited", True)]
    by = layout.byline(front)
    assert by.first()["byline"] == "Mira Okafor, T Lund, Ana Sousa"
    refs = citations.parse_references(sections, content)
    assert [r[1:] for r in rows(refs, "ord", "num", "text")] == [("1", "K. Frisch. Dancing bees"), ("2", "L. Huber. The queen"), ("3", "E. Aristotle")]
    paragraphs = content.join(sections.select("doc_id", "section_no", F.col("anchor").alias("section_anchor"), "is_refs"), ["doc_id", "section_no"]).where("not is_refs").select("doc_id", "pos", "section_anchor", "text")
    assert rows(citations.expand_citations(paragraphs, refs), "section_anchor", "target_anchor") == [("S1", "bib.bib2"), ("S1", "bib.bib3"), ("S2", "bib.bib2")]
    extra = spark.createDataFrame([(1, 2, 90, 0, "table", None, [["a", "b<"], ["1", "2"]], None), (1, 2, 91, 0, "image", None, None, "p.png")], "doc_id long, section_no long, pos int, page int, kind string, text string, rows array<array<string>>, src string")
    html = citations.render_article(titles, by, sections, content.unionByName(extra, allowMissingColumns=True), refs).first()["html"]
    assert '<section class="ltx_section" id="S1"><h2 class="ltx_title"><span class="ltx_tag">1</span> Queens</h2>' in html and '[<a class="ltx_ref" href="#bib.bib3">3</a>]' in html and "[1–3; 9]" in html
    assert "<tr><th>a</th><th>b&lt;</th></tr><tr><td>1</td><td>2</td></tr>" in html and '<img loading="lazy" src="p.png">' in html and 'id="bib.bib2"' in html


def test_reference_lists_without_brackets(spark):
    sections = spark.createDataFrame([(1, 1, True), (2, 1, True)], "doc_id long, section_no long, is_refs boolean")
    content = spark.createDataFrame([(1, 1, 1, "text", "1. First one. 2. Second, 3rd ed. 10. Last"), (2, 1, 1, "text", "Adams, Bees"), (2, 1, 2, "text", "7] Brown, Hives"), (2, 1, 3, "text", " ")], "doc_id long, section_no long, pos int, kind string, text string")
    assert [r for r in rows(citations.parse_references(sections, content), "doc_id", "ord", "num", "text")] == [(1, 0, "1", "First one."), (1, 1, "2", "Second, 3rd ed."), (1, 2, "10", "Last"), (2, 0, "1", "Adams, Bees"), (2, 1, "2", "Brown, Hives")]


def test_layout_rules(spark):
    assert column(spark, ["Ursula K. Ode Orbit Labs u@x.org", "von Thun", "", None, "A. B.", "Åsa Öst* Lindqvist† Bo Ek Moe"], layout.leading_name) == ["Ursula K Ode Orbit", "", "", "", "", "Åsa Öst Lindqvist Bo"]
    assert column(spark, ["All rights kept", "T. Lund", "a b c d e f g h i j k l m."], layout.is_notice) == [True, False, True]
    assert column(spark, ["3.1. Data sets", "3.1 Data", "3.", "3.x Data", "Data 3", " 3 Data"], layout.section_number) == ["3.1", "3.1", "", "", "", ""]
    assert column(spark, [" BIBLIOGRAPHY ", "References to bees"], layout.is_reference_heading) == [True, False]
    spans = spark.createDataFrame([(1, 0, 0, 0, 0, 0.0, "the bee-", 9.96, False), (1, 0, 0, 1, 0, 0.0, " keeper  sat", 11.0, True), (1, 0, 0, 2, 0, 0.9, "stamp", 40.0, True)], "doc_id long, page int, block int, line int, span int, dir_y double, text string, size double, bold boolean")
    r = layout.assemble_blocks(spans).first()
    assert (r["text"], r["size"], r["bold"]) == ("the beekeeper sat", 11.0, False)
    boxes = spark.createDataFrame([(1, 0, 0.0, 75.0, 400.0, 95.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert layout.drop_text_inside_tables(page(spark), boxes).count() == len(REPORT) - 1


def expand_plainly(run):
    out = []
    for part in run.split(","):
        lo, _, hi = part.strip().partition("-")
        if hi:
            out += range(int(lo), int(hi) + 1) if 0 <= int(hi) - int(lo) < 50 else []
        else:
            out.append(int(lo))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 99).map(str), st.tuples(st.integers(0, 120), st.integers(0, 120)).map(lambda p: f"{p[0]} - {p[1]}")), min_size=1, max_size=5).map(" , ".join), min_size=1, max_size=20))
def test_runs_expand_as_plainly(spark, runs):
    df = spark.createDataFrame([(k, f"x [{r}] y") for k, r in enumerate(runs)], "doc_id long, text string")
    got = {}
    for r in citations.cited_numbers(df).orderBy("doc_id", "run", "nth").collect():
        got.setdefault(r["doc_id"], []).append(int(r["num"]))
    assert got == {k: e for k, r in enumerate(runs) if (e := expand_plainly(r))}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["begin", "end", "label"]), st.sampled_from("abc")), max_size=25))
def test_label_rule_as_literally(spark, events):
    tex = "".join(f"\\{what}{{{name if what != 'label' else f'l{k}'}}}" for k, (what, name) in enumerate(events))
    want, seen = {}, []
    for k, (what, name) in enumerate(events):
        if what == "label":
            open_ = [n for w, n in seen if w == "begin"]
            for n in [n for w, n in seen if w == "end"]:
                if n in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(n)]
            want[f"l{k}"] = open_[-1] if open_ else "text"
        seen.append((what, name))
    assert dict(rows(latex.labels(spark.createDataFrame([(1, tex)], "doc_id long, tex string")), "label", "kind")) == want


class Counting(generation.EchoProvider):
    def generate(self, system, prompt, max_tokens):
        if "Lemma" in prompt.split("What the reader marked")[-1]:
            raise AssertionError("what is retrieved must not be sent")
        if "rare" in prompt:
            raise RuntimeError("HTTP 429 quota")
        return "needs_more_context" if "abstain" in prompt else "An answer."


def lemma_nodes(spark):
    data = "struct<excerpt_html:string,section_label:string,grounded:boolean,source:string,label_mathml:string,definition_status:string,sections:array<string>,macro_name:string,count:bigint>"
    return spark.createDataFrame(
        [(1, 1, "theorem", "Lemma 9", "lag", "lag", "The lag grows.", (None, "§3", True, None, None, None, None, None, None)), (1, 2, "symbol", "h_0", "", "", "", (None, None, None, "math_scan", "", "unresolved", ["H"], None, 3))],
        f"doc_id long, node_ord long, kind string, label string, html_anchor string, definition_anchor string, excerpt string, data {data}",
    )


def test_resolution_cascade(spark, elements):
    docs = spark.createDataFrame([(1, "Tides")], "doc_id long, title string")
    asked = spark.createDataFrame([(1, 1, "lemma 9."), (2, 1, "spring tide"), (3, 1, "abstain here"), (4, 1, "rare thing")], "request_id long, doc_id long, selection string").withColumns({"paragraph": F.lit("p"), "section": F.lit(""), "dependencies": F.array().cast("array<string>")})
    got = {r["request_id"]: r for r in generation.resolve(asked, lemma_nodes(spark), docs, Counting).collect()}
    assert [got[k]["mode"] for k in (1, 2, 3, 4)] == ["retrieved", "generated", "abstained", "error"]
    assert (got[1]["anchor"], got[1]["section_label"]) == ("lag", "§3") and got[3]["content"] == generation.ABSTAIN_MESSAGE and "rate-limited" in got[4]["content"]
    off = generation.resolve(asked, lemma_nodes(spark), docs, generation.Provider)
    assert {r[0] for r in rows(off.where("request_id > 1"), "mode")} == {"unconfigured"}
    defined = generation.define_symbols(lemma_nodes(spark), elements, docs, Counting)
    symbol = defined.where("kind = 'symbol'").first()
    # the equation stands outside any paragraph, so nothing grounds it
    assert symbol["data"]["definition_status"] == "undefined"
    assert retrieval.section_text(spark.createDataFrame([(1, 1, "H"), (2, 1, "none")], "request_id long, doc_id long, anchor string"), elements).orderBy("request_id").collect()[1]["text"] == ""


def test_checkpoints_and_streams(spark):
    raw = spark.createDataFrame([(1, "POINT hit: one\nPOINT miss: two: $\\alpha$\nPOINT hit me: no\nFEEDBACK: good"), (2, "`point Partial : x\nnoise"), (3, "just text")], "reply_id long, raw string")
    points, feedback = generation.parse_checkpoints(raw)
    assert rows(points, "reply_id", "status", "point") == [(1, "hit", "one"), (1, "miss", "two: $\\alpha$"), (2, "partial", "x")]
    assert rows(feedback, "reply_id", "feedback") == [(1, "good"), (2, ""), (3, "just text")]


def test_admission_and_deletes(spark):
    files = spark.createDataFrame([(1, bytearray(b"%PDF-1.7"), 3), (2, bytearray(b"hello"), 3), (3, bytearray(b"%PDF-1.7"), 51)], "doc_id long, content binary, page_count int")
    good, bad = admission.admit(files)
    assert rows(good, "doc_id") == [(1,)] and rows(bad, "doc_id", "reason") == [(2, "not a PDF"), (3, "too many pages")]
    known = spark.createDataFrame([("a", "ready"), ("b", "failed"), ("c", "ready")], "doc_key string, status string")
    asked = spark.createDataFrame([("a", False), ("a", False), ("b", False), ("c", True), ("d", None)], "doc_key string, force boolean")
    assert rows(admission.plan_ingest(asked, known), "doc_key", "action") == [("b", "retry"), ("c", "refresh"), ("d", "create")]


def test_threads(spark):
    docs = spark.createDataFrame([(1, "P")], "doc_id long, title string")
    chats = spark.createDataFrame([(7, 1, "sel", "S1", "§1", " para ", ["a"])], "chat_id long, doc_id long, selection string, section_anchor string, section_label string, paragraph string, dependencies array<string>")
    asked = spark.createDataFrame([(1, 1, "sel", "S1"), (2, 1, "new", "S1"), (3, 1, "new", "S1"), (4, 9, "x", "S1")], "request_id long, doc_id long, selection string, section_anchor string")
    assert rows(threads.open_threads(asked, chats, docs), "selection", "created") == [("new", True), ("sel", False)]
    messages = spark.createDataFrame([(7, 1, "assistant", "hi "), (7, 0, "user", "hello")], "chat_id long, turn int, role string, content string").withColumn("ts", F.timestamp_seconds(F.col("turn")))
    history = threads.thread_history(messages)
    assert [m["role"] for m in history.first()["messages"]] == ["user", "assistant"]
    summaries = threads.thread_summaries(chats, messages)
    assert summaries.first()["question_count"] == 1
    more = summaries.unionByName(summaries.withColumns({"chat_id": F.lit(9).cast("long"), "updated_at": F.timestamp_seconds(F.lit(5))})).unionByName(summaries.withColumns({"chat_id": F.lit(8).cast("long"), "updated_at": F.lit(None).cast("timestamp")}))
    assert rows(threads.newest_threads(more), "place", "chat_id") == [(1, 9), (2, 7), (3, 8)]
    assert threads.thread_prompts(chats, history, docs).first()["prompt"].endswith("> hello\nAssistant > hi\nAssistant >")


def test_sources(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "main.tex").write_text("\\documentclass{a}\\begin{document}\\input{part}\\input{#1}\\end{document}")
    (tmp_path / "p1" / "part.tex").write_text("PART\\include{ deep }")
    (tmp_path / "p1" / "deep.tex").write_text("DEEP\\input{deep}")
    (tmp_path / "p1" / "x.bbl").write_text("BBL")
    (tmp_path / "meta.xml").write_text("<feed><entry><id>http://x/abs/1.2v1</id><title> A\n B </title><author><name> X </name></author><author><name>Y</name></author></entry></feed>")
    files = landed.read_corpus(spark, str(tmp_path), "tex").withColumnRenamed("doc_key", "doc_id")
    main = landed.pick_main_source(files)
    assert main.first()["path"] == "main.tex"
    assert landed.inline_inputs(files, main).first()["tex"] == "\\documentclass{a}\\begin{document}\nPART" + "\nDEEP" * 4 + "\\input{deep}" + "\n" * 5 + "\\input{#1}\\end{document}\nBBL"
    assert tuple(landed.read_metadata(spark, str(tmp_path / "meta.xml")).first()) == ("1.2", "A B", "X, Y")


def test_streaming_equals_batch(spark, tmp_path):
    papers = spark.createDataFrame([(1, "a", PAPER), (2, "b", PAPER), (3, "a", PAPER)], "doc_id long, doc_key string, html string")
    papers.write.parquet(str(tmp_path / "in"))

    def build(batch):
        d = dom.dom_flatten(batch)
        t = html_graph.targets(d)
        nodes = graph.target_nodes(t)
        return nodes, graph.resolve_edges(html_graph.occurrences(d, t), nodes)

    for _ in range(2):  # the second run finds nothing to do
        landing = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(landing, str(tmp_path / "out"), str(tmp_path / "check"), build).awaitTermination()
    back = store.read_graph(spark, str(tmp_path / "out"))
    assert rows(back.nodes.select("doc_id").distinct(), "doc_id") == [(1,), (2,)]
    assert back.nodes.where("doc_id = 1").count() == 6 and back.edges.count() == 6


def test_cited_runs_as_plainly(spark):
    import re

    texts = ["", "no", "[1]", "a [1, 2] b [3–5]c[6-7]", "[[1]] [2", "[ 1] [1 ] [1,] [,1] [a] [1a]", "[1,\t 2]\n[3 – 4]", "]1[ [1][2]", "[1\n]", "[١]", "x[1]y]z[2,3"]
    plain = re.compile(r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]")
    assert column(spark, texts, citations.cited_runs) == [plain.findall(t) for t in texts]
    assert column(spark, texts, lambda x: F.aggregate(citations.bracket_pieces(x), F.lit(""), lambda acc, p: F.concat(acc, F.when(p["run"].isNull(), "").otherwise(F.concat(F.lit("<"), p["run"], F.lit(">"))), p["plain"]))) == [plain.sub(r"<\1>", t) for t in texts]
    assert citations.numbered_entries("intro 1. One a. 2. Two 1234. x 3. 4. four 5.") == [("1", "One a. "), ("2", "Two 1234. x "), ("3", "4. four 5.")]
    assert citations.bracketed_entries("no [x] [1] a [2, 3] b[2]c [ 4] [5") == [("1", " a [2, 3] b"), ("2", "c [ 4] [5")]
    assert citations.numbered_entries("") == citations.bracketed_entries("") == []


def test_entry_imports():
    import __spark_entry__ as e

    assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())
