"""Queries over HTML renderings, LaTeX sources and the graph made of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papergraph.operators import dom as D
from papergraph.operators import graph, html_graph, latex
from papergraph.operators.html_graph import EDGE_COLUMNS, LINK_COLUMNS, MATH_COLUMNS, TARGET_COLUMNS
from papergraph.plans import derived
from papergraph.plans.derived import TEX_HEAD, TEX_PART, TEX_TAIL
from papergraph.plans.layout import LINES
from papergraph.sources import landed, store
from papergraph.sources.shared import shared_dir, stored


#: The elements that targets are read from, and those that occurrences are too.
NAMED = ("named",)
TARGETS = ("named", "link")


def elements(spark, sf_dir, *only, columns=()):
    """Elements of the derived papers (of these roles and columns only, if any), parsed once and stored."""
    return stored(D.dom_flatten(derived.html(spark, sf_dir), only=only, columns=columns), "elements")


def object_elements(spark, sf_dir, *only, columns=()):
    return stored(D.dom_flatten(derived.object_html(spark, sf_dir), only=only, columns=columns), "elements")


def found_targets(papers):
    """Targets of papers that are read once, so that nothing is stored."""
    return html_graph.targets(D.dom_flatten(papers, only=NAMED, columns=TARGET_COLUMNS))


def found_occurrences(papers):
    return html_graph.occurrences(D.dom_flatten(papers, only=("link",), columns=LINK_COLUMNS))


def found_edges(papers):
    return html_graph.edges(D.dom_flatten(papers, only=TARGETS, columns=EDGE_COLUMNS))


def scans(spark, sf_dir):
    return latex.sources(derived.tex(spark, sf_dir), "text")


def paper_graph(spark, sf_dir):
    """Nodes and edges of the derived papers: targets, then symbols."""
    dom = elements(spark, sf_dir, *TARGETS, "math", columns=(*TARGET_COLUMNS, *EDGE_COLUMNS, *MATH_COLUMNS))
    found = stored(html_graph.targets(dom), "targets")
    nodes = graph.target_nodes(found)
    tex = scans(spark, sf_dir)
    symbols = graph.symbol_nodes(latex.macros(tex), latex.symbols(tex), html_graph.math_by_section(dom), nodes.select("doc_id", "node_ord"))
    nodes = nodes.unionByName(symbols)
    return dom, nodes, html_graph.edges(dom)


def html_elements(spark, sf_dir):
    """Elements of the derived papers by tag."""
    return elements(spark, sf_dir).where("error is null and not hidden").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


def page_elements(spark, sf_dir):
    """Links and paragraphs of the raw web pages, whose markup is broken in places."""
    pages = derived.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    d = D.dom_flatten(pages).where("error is null and not hidden")
    return d.groupBy("doc_id").agg(F.count_if(F.col("tag") == "a").alias("n_links"), F.count_if((F.col("tag") == "p") & (F.col("text") != "")).alias("n_paragraphs"), F.max("end_pos").alias("last_pos"))


def cleaned_pages(spark, sf_dir):
    """Raw web pages without scripts, styles and handlers."""
    pages = derived.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", F.lit("").alias("byline"), F.lit("/a").alias("asset_prefix"))
    none = spark.createDataFrame([], "doc_id long, anchor string, kind string")
    out = D.annotate_html(pages, none)
    return out.select("doc_id", F.col("html").rlike("(?i)<(script|style|iframe|link|base)").alias("unsafe"))


def annotated_papers(spark, sf_dir):
    """Stamped links and sections, rewritten images of the cleaned papers."""
    papers = derived.html(spark, sf_dir)
    found = found_targets(papers)
    out = D.annotate_html(papers, found)
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return out.select("doc_id", n('data-anchor="S').alias("n_stamps"), n('loading="lazy"').alias("n_images"), n("onclick").alias("n_handlers"), n("<script").alias("n_scripts"))


def document_headers(spark, sf_dir):
    return html_graph.document_header(elements(spark, sf_dir, "header"))


def html_targets(spark, sf_dir):
    t = found_targets(derived.html(spark, sf_dir))
    return t.select("doc_id", F.col("ord").cast("long").alias("ord"), "anchor", "kind", "label", F.md5("excerpt").alias("excerpt_md5"), "section_label")


def html_occurrences(spark, sf_dir):
    return found_occurrences(derived.html(spark, sf_dir)).select("doc_id", "section_anchor", "target_anchor", "kind")


def math_blobs(spark, sf_dir):
    return html_graph.math_by_section(elements(spark, sf_dir, "math"))


def enclosing_sections(spark, sf_dir):
    """Elements whose section the parser's stack and the sweep name alike."""
    dom = elements(spark, sf_dir, columns=("pos", "end_pos", "id", "classes", "section_anchor"))
    both = dom.select("doc_id", "pos", "section_anchor").join(html_graph.enclosing_sections_by_sweep(dom).withColumnRenamed("section_anchor", "joined"), ["doc_id", "pos"])
    return both.groupBy("doc_id").agg(F.count_if(F.col("section_anchor") != F.col("joined")).alias("n_different"))


def object_targets(spark, sf_dir):
    """Equations, figures, tables, theorems, footnotes, references and sections as targets."""
    t = found_targets(derived.object_html(spark, sf_dir))
    return t.select("doc_id", F.col("ord").cast("long").alias("ord"), "anchor", "kind", "label", F.md5("excerpt").alias("excerpt_md5"), F.md5("excerpt_html").alias("html_md5"), "section_label")


def object_occurrences(spark, sf_dir):
    return found_occurrences(derived.object_html(spark, sf_dir)).select("doc_id", "section_anchor", "target_anchor", "kind")


def object_assets(spark, sf_dir):
    """Local images of the papers with objects; absolute addresses are left out."""
    images = D.dom_flatten(derived.object_html(spark, sf_dir), only=("image",), columns=("tag", "src", "hidden"))
    return html_graph.asset_manifest(images, "/assets")


def object_pages(spark, sf_dir):
    """The whole cleaned page of every paper with objects, with its byline."""
    papers = derived.object_html(spark, sf_dir).withColumn("byline", F.concat(F.lit("By "), "doc_id"))
    out = D.annotate_html(papers, found_targets(papers))
    return out.select("doc_id", F.md5("html").alias("html_md5"), "error")


def object_headers(spark, sf_dir):
    """Titles and authors, every second paper with a byline from elsewhere."""
    bylines = derived.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("By "), "doc_id").alias("byline"))
    return html_graph.document_header(object_elements(spark, sf_dir, "header"), bylines)


def symbol_places(spark, sf_dir):
    """Sections in whose mathematics a scanned symbol stands: y_1 in those of y_1, y_13 and so on."""
    dom = object_elements(spark, sf_dir, "math")
    none = spark.createDataFrame([], "doc_id long, ord int, name string, body string")
    symbols = dom.where("tag = 'math'").groupBy("doc_id").agg(F.count("*").alias("count")).select("doc_id", F.lit("y_{1}").alias("token"), "count", F.lit(1).alias("ord"))
    nodes = graph.symbol_nodes(none, symbols, html_graph.math_by_section(dom))
    return nodes.select("doc_id", "label", F.array_join("data.sections", ",").alias("sections"), F.col("data.count").alias("n"))


def object_edges(spark, sf_dir):
    """Edges between the objects of each paper, with the nodes' numbers."""
    e = found_edges(derived.object_html(spark, sf_dir))
    return e.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("source_node_ord").alias("sources"), F.sum("target_node_ord").alias("targets"))


def image_assets(spark, sf_dir):
    return html_graph.asset_manifest(elements(spark, sf_dir, "image"), "/assets")


def tex_labels(spark, sf_dir):
    return latex.labels(scans(spark, sf_dir))


def tex_refs(spark, sf_dir):
    return latex.refs(scans(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "ref")


def tex_cite_keys(spark, sf_dir):
    return latex.cite_keys(scans(spark, sf_dir)).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


def tex_bibliography(spark, sf_dir):
    return latex.bibliography(scans(spark, sf_dir)).select("doc_id", "key", "text")


def tex_macros(spark, sf_dir):
    return latex.macros(scans(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "body")


def tex_theorems(spark, sf_dir):
    return latex.theorems(scans(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "kind", "title", "label", "statement", "depth")


def tex_section_titles(spark, sf_dir):
    return latex.tex_sections(scans(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "level", "title", "label")


def tex_symbols(spark, sf_dir):
    return latex.symbols(scans(spark, sf_dir)).select("doc_id", "token", F.col("count").alias("n"), F.col("ord").cast("long").alias("ord"))


def graph_nodes(spark, sf_dir):
    _, nodes, _ = paper_graph(spark, sf_dir)
    sections = F.array_join(F.coalesce("data.sections", F.array().cast("array<string>")), ",")
    return nodes.select("doc_id", "node_ord", "kind", "label", "html_anchor", F.coalesce("data.definition_status", F.lit("")).alias("status"), sections.alias("sections"))


def graph_edges(spark, sf_dir):
    return found_edges(derived.html(spark, sf_dir)).select("doc_id", "source_anchor", "target_anchor", "kind", "source_node_ord", "target_node_ord")


def graph_counts(spark, sf_dir):
    _, nodes, edges = paper_graph(spark, sf_dir)
    return graph.graph_stats(nodes, edges)


def exported_graphs(spark, sf_dir):
    """Each document's JSON object as a reader of it finds it: its nodes' labels in order, its edges' ends."""
    _, nodes, edges = paper_graph(spark, sf_dir)
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    read = F.from_json("json", "source string, nodes array<struct<label string>>, edges array<struct<source_anchor string, target_anchor string>>")
    j = landed.export_graph_json(docs, nodes, edges).select("doc_id", read.alias("g"))
    ends = F.array_sort(F.transform("g.edges", lambda e: F.concat_ws(">", e["source_anchor"], e["target_anchor"])))
    digest = lambda c: F.md5(F.array_join(c, "|"))
    return j.select("doc_id", "g.source", F.size("g.nodes").alias("n_nodes"), F.size("g.edges").alias("n_edges"), digest(F.col("g.nodes")["label"]).alias("labels_md5"), digest(ends).alias("edges_md5"))


def written_graphs(spark, sf_dir):
    """Graphs written, then every seventh document replaced whole; nodes and edges as read back."""
    path = f"{shared_dir(spark)}/graphs/{uuid.uuid4().hex}"
    found, nodes = derived.edge_tables(spark, sf_dir)
    store.write_graph(nodes, found, path)
    some = F.col("doc_id") % 7 == 0
    store.write_graph(nodes.where(some & (F.col("node_ord") % 2 == 0)).withColumn("kind", F.lit("replaced")), found.where(some & (F.col("target_anchor") < "P5")), path)
    back = store.read_graph(spark, path)
    n = back.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    e = back.edges.groupBy(F.concat(F.lit("edge:"), "kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return n.unionByName(e)


def versioned_graphs(spark, sf_dir):
    """Three overlapping commits and a deletion, with a compaction between and one after them;
    what each document has in the end. A third reading, from before, must still see the old state."""
    path = f"{shared_dir(spark)}/graphs/{uuid.uuid4().hex}"
    found, nodes = derived.edge_tables(spark, sf_dir)
    docs = found.select("doc_id", F.concat(F.lit("order-"), "doc_id").alias("doc_key")).distinct()

    def put(tag, by, of_nodes, of_edges, number):
        mine = F.col("doc_id") % by == 0
        store.write_graph(nodes.where(mine).where(of_nodes).withColumn("kind", F.lit(tag)), found.where(mine).where(of_edges), path, docs.where(mine), "orders", number)

    put("first", 1, "true", "true", 0)
    put("second", 2, "node_ord % 2 = 0", "target_anchor < 'P5'", 1)
    before = store.read_graph(spark, path)
    store.compact_graph(spark, path)
    put("third", 3, "node_ord % 3 = 0", "target_anchor >= 'P5'", 2)
    put("third", 1, "false", "false", 2)  # a commit that comes again is skipped
    store.delete_from_graph(docs.where("doc_id % 5 = 0"), path)
    store.compact_graph(spark, path)
    now = store.read_graph(spark, path)
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    kinds = now.nodes.groupBy("doc_id").agg(F.max("kind").alias("kind"), F.count("*").alias("n_nodes"))
    out = now.documents.select("doc_id", "doc_key").join(kinds, "doc_id", "left").join(count(now.edges, "n_edges"), "doc_id", "left").join(count(before.nodes, "n_before"), "doc_id", "left")
    return out.select("doc_id", "doc_key", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_edges", "n_before")])


def served_assets(spark, sf_dir):
    """Images of every paper joined with landed files, one of four of which is missing and whose
    contents repeat: what is served, by type, and what is missing."""
    manifest = html_graph.asset_manifest(elements(spark, sf_dir, "image"), "/assets").select("doc_id", "path")
    n = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    lead = F.element_at(F.array(F.lit("89504E470D0A1A0A"), F.lit("FFD8FFE0"), F.lit("00")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = manifest.where(n % 16 != 4).select("doc_id", "path", F.unhex(F.concat(lead, F.hex((n % 5).cast("string")))).alias("content"))
    assets, payloads, missing = landed.stored_assets(manifest, files)
    served = landed.assets_with_data(assets, payloads).select("doc_id", "path", "content_type", F.md5("data").alias("data_md5"))
    gone = missing.select("doc_id", "path", F.lit("missing").alias("content_type"), F.lit(None).cast("string").alias("data_md5"))
    return served.unionByName(gone)


def landed_papers(spark, sf_dir):
    """Papers landed as JSON and read back."""
    path = f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}"
    derived.tex(spark, sf_dir).write.json(path)
    back = landed.read_corpus(spark, path, "json")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"))


def landed_metadata(spark, sf_dir):
    """Entries of an Atom feed written from the documents and read back."""
    path = f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}"
    docs, name = derived.table(spark, sf_dir, "documents"), lambda x: F.struct(F.concat(F.lit(f" {x} "), "doc_id", F.lit(" ")).alias("name"))
    entries = docs.select(F.concat(F.lit("http://archive.example/abs/"), "doc_id", F.lit("v2")).alias("id"), F.concat(F.lit("  Title\n  of "), "doc_id").alias("title"), F.array(name("Ann"), name("Bo")).alias("author"))
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return landed.read_metadata(spark, path)


def edges_at_volume(spark, sf_dir):
    """Edges of every order's document; a tenth of the anchors has no node."""
    found, nodes = derived.edge_tables(spark, sf_dir)
    return graph.resolve_edges(found, nodes).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("source_node_ord").alias("sources"), F.sum("target_node_ord").alias("targets"))


def node_counts_at_volume(spark, sf_dir):
    found, nodes = derived.edge_tables(spark, sf_dir)
    return graph.graph_stats(nodes, found).where("doc_id is null").select("what", "n")


QUERIES = {f.__name__: f for f in (
    html_elements, page_elements, cleaned_pages, annotated_papers, document_headers, html_targets, html_occurrences, math_blobs, enclosing_sections, image_assets, object_targets, object_occurrences, object_assets, object_pages, object_headers, symbol_places, object_edges, tex_labels, tex_refs, tex_cite_keys,
    tex_bibliography, tex_macros, tex_theorems, tex_section_titles, tex_symbols, graph_nodes, graph_edges, graph_counts, exported_graphs, written_graphs, versioned_graphs, served_assets, landed_papers, landed_metadata, edges_at_volume, node_counts_at_volume,
)}

N = f"WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)"
PARA = r"trim(regexp_replace(line || CASE WHEN i > 0 THEN ' see' ELSE '' END, '\s+', ' ', 'g'))"
#: y: the symbols of the derived sources; equal counts go by first sight.
SYMBOLS = r", y AS (SELECT doc_id, token, k AS n, ord FROM (SELECT doc_id, unnest(['\alpha', '\beta_b', 'Q^0', 'Q^1', 'Q^2']) AS token, unnest([n, n, (n + 2) // 3, (n + 1) // 3, n // 3]) AS k, unnest(range(1, 6)) AS ord FROM n) WHERE k >= 3)"
LETTER = "substr('CDEFGHKLMNPQ', (doc_id % 12 + 1)::INT, 1)"
FLAT = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
_above, _cited = "(CASE WHEN i > 0 AND i % 6 <> 1 THEN ' above' ELSE '' END)", "(CASE WHEN i % 4 <> 0 THEN ' cited' ELSE '' END)"
OBJECT_PARA = rf"trim(regexp_replace(line || {_above} || {_cited}, '\s+', ' ', 'g'))"
ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
OBJECT_ANCHOR = "CASE {0} % 6 WHEN 1 THEN 'S' || {0} || '.E1' WHEN 2 THEN 'S' || {0} || '.F1' WHEN 3 THEN 'S' || {0} || '.T1' WHEN 4 THEN 'Thm' || {0} WHEN 5 THEN 'footnote' || {0} END"
#: o: links (i, slot, anchor), t: targets in order, of the papers with objects.
OBJECTS = f"""WITH {LINES}, docs AS (SELECT DISTINCT doc_id FROM l),
o AS (SELECT doc_id, i, 0 AS slot, {OBJECT_ANCHOR.format("(i - 1)")} AS anchor FROM l WHERE i > 0 AND i % 6 <> 1 UNION ALL SELECT doc_id, i, 1, 'bib.bib' || (i % 3 + 1) FROM l WHERE i % 4 <> 0),
f AS (SELECT doc_id, anchor, min(i * 2 + slot) AS place FROM o GROUP BY ALL),
x AS (SELECT doc_id, i, 'S' || i AS anchor, 'section' AS kind, 5 AS rank, '§' || i AS label, i || ' Part ' || i || ' — ' || left({OBJECT_PARA}, 300) AS excerpt, '' AS html, '§' || i AS section_label FROM l
 UNION ALL SELECT doc_id, i, {OBJECT_ANCHOR.format("i")}, ['equation', 'figure', 'table', 'theorem', 'footnote'][(i % 6)::INT], CASE WHEN i % 6 < 5 THEN i % 6 - 1 END, ['Eq. (' || i || ')', 'Figure ' || i, 'Table ' || i, 'Lemma ' || i, 'Footnote ' || i][(i % 6)::INT],
  ['y_{{' || i || '}} = z', left(trim('Figure ' || i || ': ' || {FLAT}), 500), left(trim('Table ' || i || ': ' || {FLAT}), 500), left(trim('Lemma ' || i || ' ' || {FLAT}), 1000), left(trim(i || ' ' || {FLAT}), 600)][(i % 6)::INT],
  CASE i % 6 WHEN 1 THEN '<math alttext="y_{{' || i || '}} = z"><mi>y</mi><mo>=</mo><mi>y</mi></math>' WHEN 4 THEN '<span class="ltx_tag">Lemma ' || i || '</span><p class="ltx_p">' || {ESCAPED} || '</p>' ELSE '' END, '§' || i FROM l WHERE i % 6 > 0
 UNION ALL SELECT doc_id, k, 'bib.bib' || k, 'citation', 4, '[' || k || ']', '[' || k || '] Source ' || k || '.', '', 'References' FROM docs, range(1, 4) b(k)),
t AS (SELECT x.*, row_number() OVER (PARTITION BY x.doc_id ORDER BY place NULLS LAST, rank, i) AS ord FROM x LEFT JOIN f USING (doc_id, anchor) WHERE place IS NOT NULL OR rank IS NOT NULL)"""
_STAMP = """(' data-anchor="' || {0} || '" data-anchor-kind="' || {1} || '"')"""
_OWN = _STAMP.format(OBJECT_ANCHOR.format("i"), "['equation', 'figure', 'table', 'theorem', 'footnote'][(i % 6)::INT]")
_BODY = f"""CASE i % 6 WHEN 1 THEN '<table id="S' || i || '.E1" class="ltx_equation"' || {_OWN} || '><tr><td><math alttext="y_{{' || i || '}} = z"><mi>y</mi><mo>=</mo><mi>y</mi></math></td><td><span class="ltx_tag">(' || i || ')</span></td></tr></table>'
 WHEN 2 THEN '<figure id="S' || i || '.F1" class="ltx_figure"' || {_OWN} || '><img src="/assets/' || doc_id || '/f' || i || '.png" loading="lazy"><figcaption class="ltx_caption"><span class="ltx_tag">Figure ' || i || ': </span>' || {ESCAPED} || '</figcaption></figure>'
 WHEN 3 THEN '<figure id="S' || i || '.T1" class="ltx_table"' || {_OWN} || '><img src="https://example.org/' || i || '.png"><span class="ltx_caption"><span class="ltx_tag">Table ' || i || ':</span> ' || {ESCAPED} || '</span></figure>'
 WHEN 4 THEN '<div id="Thm' || i || '" class="ltx_theorem"' || {_OWN} || '><span class="ltx_tag">Lemma ' || i || '</span><p class="ltx_p">' || {ESCAPED} || '</p></div>'
 WHEN 5 THEN '<span id="footnote' || i || '" class="ltx_note"' || CASE WHEN i + 1 < n THEN {_OWN} ELSE '' END || '><sup class="ltx_tag">' || i || '</sup> ' || {ESCAPED} || '</span>' ELSE '' END"""
_LINKS = f"""CASE WHEN i > 0 AND i % 6 <> 1 THEN ' <a href="#' || {OBJECT_ANCHOR.format("(i - 1)")} || '"' || {_STAMP.format(OBJECT_ANCHOR.format("(i - 1)"), "['equation', 'figure', 'table', 'theorem', 'footnote'][((i - 1) % 6)::INT]")} || '>above</a>' ELSE '' END
 || CASE WHEN i % 4 <> 0 THEN ' <a href="#bib.bib' || (i % 3 + 1) || '"' || {_STAMP.format("'bib.bib' || (i % 3 + 1)", "'citation'")} || '>cited</a>' ELSE '' END"""
_ITEMS = "".join(f'<li id="bib.bib{k}" class="ltx_bibitem" data-anchor="bib.bib{k}" data-anchor-kind="citation"><span class="ltx_tag">[{k}]</span> Source {k}.</li>' for k in (1, 2, 3))
SQL = {
    "object_targets": OBJECTS + " SELECT doc_id, ord, anchor, kind, label, md5(excerpt) AS excerpt_md5, md5(CASE WHEN kind = 'theorem' AND length(html) > 8000 THEN '' ELSE html END) AS html_md5, section_label FROM t",
    "object_occurrences": OBJECTS + " SELECT doc_id, 'S' || i AS section_anchor, anchor AS target_anchor, CASE WHEN slot = 1 THEN 'cites' ELSE 'references' END AS kind FROM o",
    "object_assets": f"WITH {LINES} SELECT doc_id, 'f' || i || '.png' AS path, '/assets/f' || i || '.png' AS served_url FROM l WHERE i % 6 = 2",
    "object_pages": N + f""" SELECT doc_id, md5('<article><h1 class="ltx_title ltx_title_document">Objects of ' || doc_id || '</h1><div class="ltx_authors">By ' || doc_id || '</div>' || string_agg('<section id="S' || i || '" class="ltx_section"' || {_STAMP.format("'S' || i", "'section'")} || '><h2 class="ltx_title"><span class="ltx_tag">' || i || '</span> Part ' || i || '</h2><p class="ltx_p">' || {ESCAPED} || {_LINKS} || '</p>' || {_BODY} || '</section>', chr(10) ORDER BY i) || '<ul>{_ITEMS}</ul></article>') AS html_md5, NULL::VARCHAR AS error FROM l JOIN n USING (doc_id) GROUP BY doc_id""",
    "object_headers": "SELECT doc_id, 'Objects of ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'By ' ELSE 'Writer ' END || doc_id AS authors FROM documents WHERE text IS NOT NULL",
    "symbol_places": f"WITH {LINES}, e AS (SELECT doc_id, i FROM l WHERE i % 6 = 1) SELECT doc_id, 'y_{{1}}' AS label, string_agg('S' || i, ',' ORDER BY 'S' || i) FILTER (starts_with('y_' || i, 'y_1')) AS sections, count(*) AS n FROM e GROUP BY doc_id",
    "object_edges": OBJECTS + " SELECT o.doc_id, CASE WHEN slot = 1 THEN 'cites' ELSE 'references' END AS kind, count(*) AS n, sum(s.ord)::BIGINT AS sources, sum(t.ord)::BIGINT AS targets FROM o JOIN t ON t.doc_id = o.doc_id AND t.anchor = o.anchor JOIN t s ON s.doc_id = o.doc_id AND s.anchor = 'S' || o.i GROUP BY ALL",
    "written_graphs": """WITH k AS (SELECT l_orderkey AS d, l_partkey AS k FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT * FROM k WHERE k % 10 <> 0),
w AS (SELECT CASE WHEN d % 7 = 0 THEN 'replaced' WHEN k % 3 = 0 THEN 'citation' ELSE 'equation' END AS kind, d FROM n WHERE d % 7 <> 0 OR k % 2 = 0), e AS (SELECT l_orderkey AS d FROM lineitem WHERE l_orderkey % 7 <> 0 OR 'P' || l_partkey < 'P5' OR l_orderkey NOT IN (SELECT d FROM n WHERE k % 2 = 0 UNION SELECT l_orderkey FROM lineitem WHERE 'P' || l_partkey < 'P5'))
SELECT kind, count(*) AS n, sum(d)::BIGINT AS ids FROM (SELECT * FROM w UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'citation' ELSE 'equation' END, d FROM n WHERE d % 7 = 0 AND d NOT IN (SELECT d FROM n WHERE k % 2 = 0 UNION SELECT l_orderkey FROM lineitem WHERE 'P' || l_partkey < 'P5')) GROUP BY kind UNION ALL SELECT 'edge:references', count(*), sum(d)::BIGINT FROM e""",
    "versioned_graphs": """WITH k AS (SELECT l_orderkey AS d, l_partkey AS k FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem), g AS (SELECT d, count(*) AS n1, count(*) FILTER (k % 2 = 0) AS n2, count(*) FILTER (k % 3 = 0) AS n3 FROM k WHERE k % 10 <> 0 GROUP BY d),
e AS (SELECT l_orderkey AS d, count(*) AS e1, count(*) FILTER ('P' || l_partkey < 'P5') AS e2, count(*) FILTER ('P' || l_partkey >= 'P5') AS e3 FROM lineitem GROUP BY 1),
w AS (SELECT d, CASE WHEN d % 3 = 0 THEN 'third' WHEN d % 2 = 0 THEN 'second' ELSE 'first' END AS kind, coalesce(CASE WHEN d % 3 = 0 THEN n3 WHEN d % 2 = 0 THEN n2 ELSE n1 END, 0) AS n_nodes, CASE WHEN d % 3 = 0 THEN e3 WHEN d % 2 = 0 THEN e2 ELSE e1 END AS n_edges, coalesce(CASE WHEN d % 2 = 0 THEN n2 ELSE n1 END, 0) AS n_before FROM e LEFT JOIN g USING (d) WHERE d % 5 <> 0)
SELECT d AS doc_id, 'order-' || d AS doc_key, CASE WHEN n_nodes > 0 THEN kind END AS kind, n_nodes, n_edges, n_before FROM w""",
    "served_assets": f"WITH {LINES}, m AS (SELECT doc_id, i, 'x' || i || '.png' AS path, ['image/png', 'image/jpeg', 'application/octet-stream'][doc_id % 3 + 1] AS kind, ['89504E470D0A1A0A', 'FFD8FFE0', '00'][doc_id % 3 + 1] || hex((i % 5)::VARCHAR) AS x FROM l WHERE i % 4 = 0) SELECT doc_id, path, CASE WHEN i % 16 = 4 THEN 'missing' ELSE kind END AS content_type, CASE WHEN i % 16 <> 4 THEN md5(unhex(x)) END AS data_md5 FROM m",
    "landed_papers": f"WITH {LINES} SELECT doc_id, {len(TEX_HEAD) + len(TEX_TAIL)} + sum(length({TEX_PART}))::BIGINT AS n_chars FROM l GROUP BY doc_id",
    "landed_metadata": "SELECT doc_id::VARCHAR AS doc_key, 'Title of ' || doc_id AS title, 'Ann ' || doc_id || ', Bo ' || doc_id AS authors FROM documents",
    "html_elements": N + """, t AS (SELECT doc_id, unnest([{'t': 'article', 'n': 1}, {'t': 'h1', 'n': 1}, {'t': 'section', 'n': n}, {'t': 'h2', 'n': n}, {'t': 'span', 'n': n}, {'t': 'p', 'n': n}, {'t': 'math', 'n': n}, {'t': 'a', 'n': n - 1}, {'t': 'img', 'n': (n + 3) // 4}]) AS x FROM n) SELECT doc_id, x.t AS tag, x.n AS n FROM t WHERE x.n > 0""",
    "page_elements": r"""WITH s AS (SELECT page_id, regexp_extract(html, '(?s)^(.*)<article>(.*?)</article>', 1) AS head, regexp_extract(html, '(?s)^(.*)<article>(.*?)</article>', 2) AS body FROM pages)
SELECT page_id AS doc_id, len(regexp_extract_all(body, '<a[ >]')) AS n_links, len(list_filter(string_split(body, '<p>')[2:], lambda x: trim(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g')) <> '')) AS n_paragraphs, (len(regexp_extract_all(head || '<article>' || body, '<[a-zA-Z]')) - 1)::INT AS last_pos FROM s""",
    "cleaned_pages": "SELECT page_id AS doc_id, FALSE AS unsafe FROM pages",
    "annotated_papers": N + " SELECT doc_id, 2 * n - 1 AS n_stamps, (n + 3) // 4 AS n_images, 0::BIGINT AS n_handlers, 0::BIGINT AS n_scripts FROM n",
    "document_headers": "SELECT doc_id, 'Paper ' || doc_id AS title, 'A. Author' AS authors FROM documents WHERE text IS NOT NULL",
    "html_targets": f"WITH {LINES} SELECT doc_id, i + 1 AS ord, 'S' || i AS anchor, 'section' AS kind, '§' || i AS label, md5(i || ' Part ' || i || ' — ' || left({PARA}, 300)) AS excerpt_md5, '§' || i AS section_label FROM l",
    "html_occurrences": f"WITH {LINES} SELECT doc_id, 'S' || i AS section_anchor, 'S' || (i - 1) AS target_anchor, 'references' AS kind FROM l WHERE i > 0",
    "math_blobs": f"WITH {LINES} SELECT doc_id, 'S' || i AS section_anchor, 'x_' || i AS blob FROM l",
    "enclosing_sections": "SELECT doc_id, 0::BIGINT AS n_different FROM documents WHERE text IS NOT NULL",
    "image_assets": f"WITH {LINES} SELECT doc_id, 'x' || i || '.png' AS path, '/assets/x' || i || '.png' AS served_url FROM l WHERE i % 4 = 0",
    "tex_labels": f"WITH {LINES} SELECT doc_id, 'sec:' || i AS label, 'document' AS kind FROM l UNION ALL SELECT doc_id, 'eq:' || i, 'equation' FROM l UNION ALL SELECT doc_id, 'lem:' || i, 'lem' FROM l WHERE i % 5 = 0 UNION ALL SELECT doc_id, 'obs:' || i, 'obs' FROM l WHERE i % 5 = 2",
    "tex_refs": f"WITH {LINES} SELECT doc_id, i AS ord, 'eq:' || i AS ref FROM l",
    "tex_cite_keys": f"WITH {LINES} SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, unnest(['k' || (i % 7), 'k7']) AS key FROM l) GROUP BY ALL",
    "tex_bibliography": "SELECT doc_id, 'k' || k AS key, 'Entry ' || k || '. Journal ' || k || '.' AS text FROM documents, range(7) t(k) WHERE text IS NOT NULL",
    "tex_macros": r"SELECT doc_id, unnest([1, 2, 3])::BIGINT AS ord, unnest(['set' || x, 'pair', 'best']) AS name, unnest(['\mathcal{' || x || '}', '\hat{#1}, {#2}', 'best']) AS body FROM (SELECT doc_id, "
    + LETTER + " AS x FROM documents WHERE text IS NOT NULL)",
    "tex_theorems": f"""WITH {LINES}, t AS (SELECT doc_id, i, 1 AS rank, 'claim' AS kind, '' AS title, '' AS label, 'Inner ' || i || '.' AS statement, 1 AS depth FROM l WHERE i % 5 = 2
 UNION ALL SELECT doc_id, i, 2, 'lemma', 'T' || i, 'lem:' || i, 'Claim ' || i || ' holds.', 0 FROM l WHERE i % 5 = 0 UNION ALL SELECT doc_id, i, 3, 'remark', 'O' || i, 'obs:' || i, 'Outer ' || i || ' claim Inner ' || i || '. claim rest.', 0 FROM l WHERE i % 5 = 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS ord, kind, title, label, statement, depth FROM t""",
    "tex_section_titles": f"WITH {LINES} SELECT doc_id, i AS ord, 'section' AS level, 'Part ' || i AS title, 'sec:' || i AS label FROM l",
    "tex_symbols": N + SYMBOLS + " SELECT * FROM y",
    "graph_nodes": N + SYMBOLS + r""" SELECT doc_id, i + 1 AS node_ord, 'section' AS kind, '§' || i AS label, 'S' || i AS html_anchor, '' AS status, '' AS sections FROM l UNION ALL SELECT doc_id, n + 1, 'symbol', '\mathcal{' || """ + LETTER + r""" || '}', '', 'unresolved', '' FROM n UNION ALL SELECT doc_id, n.n + 1 + ord, 'symbol', token, '', 'unresolved', '' FROM y JOIN n USING (doc_id)""",
    "graph_edges": f"WITH {LINES} SELECT doc_id, 'S' || i AS source_anchor, 'S' || (i - 1) AS target_anchor, 'references' AS kind, i + 1 AS source_node_ord, i AS target_node_ord FROM l WHERE i > 0",
    "graph_counts": N + SYMBOLS + """, t AS (SELECT doc_id, unnest([{'w': 'node:section', 'n': n}, {'w': 'edges', 'n': n - 1}, {'w': 'node:symbol', 'n': 1 + coalesce(ny, 0)}]) AS x FROM n LEFT JOIN (SELECT doc_id, count(*) AS ny FROM y GROUP BY doc_id) USING (doc_id)), d AS (SELECT doc_id, x.w AS what, x.n AS n FROM t WHERE x.n > 0) SELECT * FROM d UNION ALL SELECT NULL, what, sum(n)::BIGINT FROM d GROUP BY what""",
    "exported_graphs": N + SYMBOLS + r""", g AS (SELECT doc_id, i AS nth, '§' || i AS label FROM l UNION ALL SELECT doc_id, n, '\mathcal{' || """ + LETTER + r""" || '}' FROM n UNION ALL SELECT doc_id, n.n + ord, token FROM y JOIN n USING (doc_id)),
a AS (SELECT doc_id, count(*)::INT AS c, string_agg(label, '|' ORDER BY nth) AS x FROM g GROUP BY doc_id), e AS (SELECT doc_id, count(*)::INT AS c, string_agg(x, '|' ORDER BY x) AS x FROM (SELECT doc_id, 'S' || i || '>S' || (i - 1) AS x FROM l WHERE i > 0) GROUP BY doc_id)
SELECT doc_id, source, coalesce(a.c, 0) AS n_nodes, coalesce(e.c, 0) AS n_edges, md5(coalesce(a.x, '')) AS labels_md5, md5(coalesce(e.x, '')) AS edges_md5 FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "edges_at_volume": """WITH k AS (SELECT l_orderkey AS d, l_partkey AS k FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem), g AS (SELECT * FROM k WHERE k % 10 <> 0)
SELECT l_orderkey AS doc_id, count(*) AS n, sum(CASE WHEN l_linenumber = 1 OR g.k IS NULL THEN l_partkey ELSE g.k END)::BIGINT AS sources, sum(l_partkey)::BIGINT AS targets FROM lineitem LEFT JOIN g ON g.d = l_orderkey AND g.k = l_suppkey WHERE l_partkey % 10 <> 0 GROUP BY 1""",
    "node_counts_at_volume": """WITH k AS (SELECT l_orderkey AS d, l_partkey AS k FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem)
SELECT CASE WHEN k % 3 = 0 THEN 'node:citation' ELSE 'node:equation' END AS what, count(*) AS n FROM k WHERE k % 10 <> 0 GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM lineitem""",
}
