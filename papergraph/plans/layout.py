"""Queries over layout blocks, citations and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from papergraph.functions import text as T
from papergraph.operators import admission, citations, layout
from papergraph.plans import derived
from papergraph.sources import landed
from papergraph.sources.shared import stored

# --- shared SQL ------------------------------------------------------------
LINES = r"""l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"""
BLOCKS = LINES + r""", b0 AS (SELECT doc_id, i AS seq, i // 40 AS page, CASE WHEN i % 40 >= 20 THEN 320.0 ELSE 72.0 END AS x0, 14.0 * (i % 40) AS y, CASE WHEN length(line) < 40 AND i % 2 = 0 THEN regexp_replace(line, '\.$', '') ELSE line END AS text,
  CASE WHEN length(line) < 40 THEN 14.0 ELSE 10.0 END AS size, length(line) < 40 AS bold FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, x0 >= 306, y, seq) AS pos FROM b0),
bs AS (SELECT doc_id, arg_max(size, chars * 1000000000 - first) AS body_size FROM (SELECT doc_id, size, sum(length(text)) AS chars, min(pos) AS first FROM b GROUP BY ALL) GROUP BY doc_id)"""
TITLES = BLOCKS + r""", p AS (SELECT * FROM b WHERE page = 0 AND NOT regexp_matches(text, '^(?i)ar\s?xiv[:\s]')),
tp AS (SELECT doc_id, arg_max({'size': size, 'y': y, 'text': text}, size * 1000000 - pos) AS t FROM p GROUP BY doc_id),
jt AS (SELECT p.doc_id, string_agg(p.text, ' ' ORDER BY p.pos) AS joined FROM p JOIN tp USING (doc_id) WHERE abs(p.size - tp.t.size) < 0.3 AND p.y <= tp.t.y + 120 GROUP BY p.doc_id),
ti AS (SELECT bs.doc_id, body_size, CASE WHEN tp.t IS NULL THEN 'Untitled document' WHEN tp.t.size <= body_size + 0.5 THEN left(tp.t.text, 200)
  ELSE left(CASE WHEN trim(joined, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN tp.t.text ELSE trim(joined, chr(32) || chr(9) || chr(10) || chr(13)) END, 300) END AS title,
  coalesce(tp.t.size, body_size + 4) AS title_size FROM bs LEFT JOIN tp USING (doc_id) LEFT JOIN jt USING (doc_id))"""
SEGMENTS = TITLES + r""", w AS (SELECT b.*, body_size, title, title_size, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words,
  regexp_matches(text, '^(\d+(?:\.\d+)*)\.?\s+\S') AS numbered, regexp_extract(text, '\pL', 0) AS letter FROM b JOIN ti USING (doc_id)),
k AS (SELECT * FROM w WHERE NOT (text = title OR (page = 0 AND abs(size - title_size) < 0.3))),
h AS (SELECT *, text <> '' AND text <> title AND words <= 16 AND (regexp_matches(text, '^(?i)\s*(references|bibliography|works cited)\s*$') OR (
  (numbered OR (right(text, 1) NOT IN ('.', ',', ';', ':') AND (letter = '' OR (upper(letter) = letter AND lower(letter) <> letter))))
  AND ((size >= body_size + 1 AND words <= 14) OR (bold AND (numbered OR (upper(text) = text AND lower(text) <> text AND length(text) BETWEEN 2 AND 60))) OR (numbered AND size >= body_size AND words <= 12)))) AS heading FROM k),
s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS no, max((NOT heading AND page > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS op FROM h)"""


def _blocks(spark, sf_dir):
    """Blocks in reading order, stored: titles, body sizes and sections each read them."""
    return stored(layout.reading_order(derived.blocks(spark, sf_dir)), "blocks")


def _titles(b):
    return layout.pick_title(b, layout.body_size(b))


def layout_sections(spark, sf_dir):
    """Sections of every document with their text blocks and characters."""
    b = _blocks(spark, sf_dir)
    sections, content, _ = layout.segment(b, _titles(b))
    sizes = content.groupBy("doc_id", "section_no").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return sections.join(sizes, ["doc_id", "section_no"], "left").select("doc_id", "section_no", "anchor", "heading", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def layout_reading_order(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"))


def layout_body_size(spark, sf_dir):
    return layout.body_size(_blocks(spark, sf_dir))


def layout_titles(spark, sf_dir):
    return _titles(_blocks(spark, sf_dir)).select("doc_id", "title", "title_size")


def layout_front_matter(spark, sf_dir):
    """Blocks before the first section, which hold the byline."""
    b = _blocks(spark, sf_dir)
    return layout.segment(b, _titles(b))[2].groupBy("doc_id").agg(F.count("*").alias("n_front"), F.count_if(layout.is_notice(F.col("text"))).alias("n_notices"))


def layout_bylines(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return layout.byline(layout.segment(b, _titles(b))[2])


def layout_assembled(spark, sf_dir):
    """Blocks of each document: every eight lines one block of two-span lines, hyphens joined."""
    li = derived.lines(spark, sf_dir)
    i, cut = F.col("i"), F.floor(F.length("line") / 2).cast("int")
    base = [F.col("doc_id"), F.lit(0).alias("page"), F.floor(i / 8).alias("block"), (i % 8).alias("line_no")]
    halves = F.array(F.struct(F.lit(0).alias("span"), F.left("line", cut).alias("text")), F.struct(F.lit(1).alias("span"), F.substring("line", cut + 1, F.length("line")).alias("text")))
    dash = F.when(i % 2 == 0, "-").otherwise("")
    spans = li.withColumn("line", F.concat(F.regexp_replace(T.collapse(F.col("line")), "-+$", ""), dash)).select(*base, F.explode(halves).alias("s"), F.when(i % 5 == 4, 0.5).otherwise(0.0).alias("dir_y"))
    spans = spans.select("doc_id", "page", "block", F.col("line_no").alias("line"), "s.span", "s.text", "dir_y", F.lit(10.04).alias("size"), (F.col("s.span") == 1).alias("bold"))
    out = layout.assemble_blocks(spans)
    return out.select("doc_id", "block", F.md5("text").alias("text_md5"), "size")


def layout_outside_tables(spark, sf_dir):
    """Text blocks whose centre is in no table box; boxes lie on each page's left column."""
    b = derived.blocks(spark, sf_dir)
    boxes = b.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(60.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(300.0).alias("x1"), (F.lit(80.0) + F.col("doc_id") % 50).alias("y1"))
    return layout.drop_text_inside_tables(b, boxes).groupBy("doc_id").agg(F.count("*").alias("n_left"), F.sum("seq").alias("seq_sum"))


def layout_real_tables(spark, sf_dir):
    """Orders as tables: their lines as rows, some columns as cells."""
    li = derived.table(spark, sf_dir, "lineitem")
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.col("l_suppkey").cast("string")), F.when(F.col("l_orderkey") % 3 == 0, F.lit("a cell that reads much more like a sentence of running prose than like any label")).otherwise(""))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("table"), F.col("l_linenumber").alias("row"), F.posexplode(cells).alias("col", "text"))
    return layout.real_tables(rows).select("doc_id")


def layout_page_images(spark, sf_dir):
    """Order lines as image placements on pages of their documents."""
    li = derived.table(spark, sf_dir, "lineitem")
    images = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_partkey") % 3).alias("ref"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_partkey") % 101).cast("double").alias("x1"), (F.col("l_partkey") * 7 % 97).cast("double").alias("y1"))
    return layout.page_images(images).select("doc_id", F.col("page").cast("int").alias("page"), F.col("ref").cast("long").alias("ref"), F.col("seq").cast("long").alias("seq"))


def display_equations(spark, sf_dir):
    """Lines that are display equations, with a formula appended to every third."""
    li = derived.lines(spark, sf_dir)
    text = F.when(F.col("i") % 3 == 0, F.concat(F.left("line", F.lit(10)), F.lit(" = ∑ x_{i} + β^2 (3)"))).otherwise(F.col("line"))
    return li.where(T.is_display_equation(text)).groupBy("doc_id").agg(F.count("*").alias("n_equations"))


def cited_occurrences(spark, sf_dir):
    """Citation runs expanded against each document's references."""
    paragraphs, refs = derived.cited(spark, sf_dir)
    return citations.expand_citations(paragraphs, refs).groupBy("doc_id", "section_anchor", "target_anchor").agg(F.count("*").alias("n"))


def parsed_references(spark, sf_dir):
    """Reference entries of every document: its lines as a bracketed list."""
    li = derived.lines(spark, sf_dir)
    content = li.select("doc_id", F.lit(1).cast("long").alias("section_no"), F.col("i").alias("pos"), F.lit("text").alias("kind"), F.concat(F.lit("["), F.col("i") + 1, F.lit("] "), F.regexp_replace("line", r"[^A-Za-z ]", "")).alias("text"))
    sections = li.select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("section_no"), F.lit(True).alias("is_refs"))
    return citations.parse_references(sections, content).select("doc_id", F.col("ord").cast("long").alias("ord"), "num", F.md5(T.collapse(F.col("text"))).alias("text_md5"))


def listed_references(spark, sf_dir):
    """Reference lists without brackets: numbered with dots in every other document, a paragraph
    an entry in the rest, half of which start with a number."""
    i = F.col("i")
    letters = F.regexp_replace("line", r"[^A-Za-z]+", "")
    plain = F.when(letters == "", "none").otherwise(letters)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat((i % 900 + 1).cast("string"), F.lit(". "), plain)).when(i % 2 == 0, F.concat((i + 7).cast("string"), F.lit(") "), plain)).otherwise(plain)
    li = derived.lines(spark, sf_dir)
    content = li.select("doc_id", F.lit(1).cast("long").alias("section_no"), i.alias("pos"), F.lit("text").alias("kind"), text.alias("text"))
    sections = li.select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("section_no"), F.lit(True).alias("is_refs"))
    return citations.parse_references(sections, content).select("doc_id", "num", F.md5("text").alias("text_md5"))


def rendered_articles(spark, sf_dir):
    """Whole articles rendered from blocks, cited references, tables and images: their hash."""
    b = _blocks(spark, sf_dir)
    titles = _titles(b)
    sections, content, front = layout.segment(b, titles)
    html = citations.render_article(titles, layout.byline(front), sections, content, citations.parse_references(sections, content))
    return html.select("doc_id", F.regexp_count("html", F.lit('<section class="ltx_section"')).cast("long").alias("n_sections"), F.regexp_count("html", F.lit('<p class="ltx_p">')).cast("long").alias("n_paragraphs"))


def article_texts(spark, sf_dir):
    """Whole articles, by hash: a section a line, whose text cites, a table in every fourth and
    an image in every third; references that some runs know and some don't."""
    paragraphs, refs = derived.cited(spark, sf_dir)
    li, i = derived.lines(spark, sf_dir), F.col("i")
    number = (i + 1).cast("long").alias("section_no")
    docs = li.select("doc_id").distinct()
    sections = li.select("doc_id", number, F.concat(F.lit("S"), i + 1).alias("anchor"), F.when(i % 2 == 0, (i + 1).cast("string")).otherwise("").alias("tag"), F.when(i % 5 == 4, "").otherwise(F.concat(F.lit("Part <"), i, F.lit(">"))).alias("heading"), F.lit(False).alias("is_refs"))
    none, rows_of = F.lit(None).cast("string"), F.array(F.array(F.lit("k"), F.lit("v & w")), F.array(i.cast("string"), F.lit(" x ")))
    no_rows = F.lit(None).cast("array<array<string>>")
    text = paragraphs.select("doc_id", (F.col("pos") + 1).cast("long").alias("section_no"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), "text", no_rows.alias("rows"), none.alias("src"))
    table = li.where("i % 4 = 0").select("doc_id", number, F.lit(1).alias("pos"), F.lit("table").alias("kind"), F.lit("").alias("text"), rows_of.alias("rows"), none.alias("src"))
    image = li.where("i % 3 = 0").select("doc_id", number, F.lit(2).alias("pos"), F.lit("image").alias("kind"), F.lit("").alias("text"), no_rows.alias("rows"), F.concat(F.lit("/assets/x&"), i, F.lit(".png")).alias("src"))
    titles = docs.select("doc_id", F.concat(F.lit("Paper "), "doc_id", F.lit(" & more")).alias("title"))
    bylines = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("A. Writer, B. Reader").alias("byline"))
    html = citations.render_article(titles, bylines, sections, text.unionByName(table).unionByName(image), refs)
    return html.select("doc_id", F.md5("html").alias("html_md5"))


def normal_texts(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("norm_md5"))


def content_keys(spark, sf_dir):
    """Content addresses, each once, with the least document that has them."""
    docs = derived.table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(T.content_key(F.col("text").cast("binary")).alias("doc_key")).agg(F.min("doc_id").alias("doc_id"))


def paper_ids(spark, sf_dir):
    """Typed references made of order keys, in every accepted form and some refused ones."""
    k = F.col("o_orderkey")
    new = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k % 100000).cast("string"), 5, "0"))
    forms = [new, F.concat(F.lit(" arXiv:"), new, F.lit("v2 ")), F.concat(F.lit("https://arxiv.org/abs/"), new), F.concat(F.lit("http://www.arxiv.org/pdf/"), new, F.lit(".pdf")), F.concat(F.lit("hep-th/"), F.lpad((k % 10000000).cast("string"), 7, "0")), F.concat(F.lit("doi:"), new), F.concat(new, F.lit("x"))]
    typed = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    return derived.table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_paper_id(typed).alias("paper_id"))


def admitted(spark, sf_dir):
    """Uploads made of the documents: why each is refused."""
    docs = derived.table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).cast("binary")
    files = docs.select("doc_id", head.alias("content"), (F.col("n_chars") / 100).cast("int").alias("page_count"))
    good, bad = admission.admit(files)
    return good.withColumn("reason", F.lit("accepted")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


def ingest_plan(spark, sf_dir):
    """What to do with every user's key, given the latest status of its document."""
    e = derived.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "fetched").otherwise("ready")
    docs = admission.latest_status(e.where("user_id % 3 != 0").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), status.alias("status")))
    incoming = e.select(F.col("user_id").alias("doc_key"), (F.col("user_id") % 5 == 0).alias("force"))
    return admission.plan_ingest(incoming, docs.withColumnRenamed("doc_id", "doc_key")).select("doc_key", "action")


def library_listing(spark, sf_dir):
    """The hundred newest documents."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars")).alias("created_at"), landed_title().alias("title"))
    return admission.list_documents(docs, 100).select("doc_id", "title")


def landed_title():
    return T.document_title(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")), F.concat(F.lit("key-"), "doc_id"))


def cascade_delete(spark, sf_dir):
    """Documents and their labels without those that are marked toxic."""
    docs, labels = (derived.table(spark, sf_dir, t) for t in ("documents", "labels"))
    left = admission.delete_documents({"documents": docs.select("doc_id"), "labels": labels.select("doc_id")}, labels.where("toxic = 1"))
    return left["documents"].withColumn("name", F.lit("documents")).unionByName(left["labels"].withColumn("name", F.lit("labels"))).groupBy("name").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def main_sources(spark, sf_dir):
    """The main file of every document's tree: its text and three other files."""
    tex = derived.tex(spark, sf_dir)
    files = F.array(F.struct(F.lit("main.tex").alias("path"), F.col("text")), F.struct(F.lit("z.tex").alias("path"), F.lit("\\documentclass{x}").alias("text")), F.struct(F.lit("readme.txt").alias("path"), F.col("text")))
    return landed.pick_main_source(tex.select("doc_id", F.explode(files).alias("f")).select("doc_id", "f.*")).select("doc_id", "path", F.length("text").cast("long").alias("n_chars"))


def inlined_sources(spark, sf_dir):
    """Trees whose main file inputs every fourth line's file, and each file the next line's."""
    li = derived.lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", derived.NO_LETTERS, ""))
    n = li.groupBy("doc_id").agg(F.max("i").alias("n"))
    more = F.when((F.col("i") < F.col("n")) & (F.col("i") % 4 < 3), F.concat(F.lit("\\input{f"), F.col("i") + 1, F.lit("}"))).otherwise("")
    files = stored(li.join(n, "doc_id").select("doc_id", F.concat(F.lit("f"), "i", F.lit(".tex")).alias("path"), F.concat("line", more).alias("text")), "files")
    starts = F.transform(F.sequence(F.lit(0), F.col("n"), F.lit(4)), lambda k: F.concat(F.lit("\\input{f"), k, F.lit("}")))
    main = n.select("doc_id", F.lit("main.tex").alias("path"), F.concat(F.lit("A "), F.array_join(starts, ""), F.lit(" \\include{missing} B")).alias("text"))
    return landed.inline_inputs(files, main).select("doc_id", F.md5("tex").alias("tex_md5"))


QUERIES = {f.__name__: f for f in (
    layout_sections, layout_reading_order, layout_body_size, layout_titles, layout_front_matter, layout_bylines, layout_assembled, layout_outside_tables, layout_real_tables, layout_page_images,
    display_equations, cited_occurrences, parsed_references, listed_references, rendered_articles, article_texts, normal_texts, content_keys, paper_ids, admitted, ingest_plan, library_listing, cascade_delete, main_sources, inlined_sources,
)}

COLLAPSED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
MATH = T.MATH_CHARS.replace("'", "''")
SQL = {
    "layout_sections": f"""WITH {SEGMENTS}, heads AS (SELECT doc_id, no AS section_no, text FROM s WHERE heading), body AS (SELECT doc_id, no AS section_no, count(*) AS n_blocks, sum(length(text)) AS n_chars FROM s WHERE NOT heading AND (no > 0 OR op = 1) GROUP BY ALL)
SELECT coalesce(h.doc_id, c.doc_id) AS doc_id, coalesce(h.section_no, c.section_no)::BIGINT AS section_no, 'S' || coalesce(h.section_no, c.section_no)::BIGINT AS anchor,
CASE WHEN h.text IS NULL THEN '' WHEN regexp_matches(h.text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+\\S') THEN trim(regexp_replace(h.text, '^\\d+(?:\\.\\d+)*\\.?\\s+', '')) ELSE h.text END AS heading,
coalesce(n_blocks, 0) AS n_blocks, coalesce(n_chars, 0)::BIGINT AS n_chars FROM heads h FULL JOIN body c ON h.doc_id = c.doc_id AND h.section_no = c.section_no""",
    "layout_reading_order": f"WITH {BLOCKS} SELECT doc_id, seq, pos FROM b",
    "layout_body_size": f"WITH {BLOCKS} SELECT doc_id, body_size::DOUBLE AS body_size FROM bs",
    "layout_titles": f"WITH {TITLES} SELECT doc_id, title, title_size::DOUBLE AS title_size FROM ti",
    "layout_front_matter": f"""WITH {SEGMENTS} SELECT doc_id, count(*) AS n_front, count(*) FILTER (regexp_matches(lower(text), '{'|'.join(layout.NOTICE_WORDS)}') OR (words > 12 AND trim(text) LIKE '%.')) AS n_notices FROM s WHERE no = 0 AND op = 0 AND NOT heading GROUP BY doc_id""",
    "layout_outside_tables": f"""WITH {BLOCKS} SELECT doc_id, count(*) AS n_left, sum(seq)::BIGINT AS seq_sum FROM b WHERE NOT (x0 + 100 BETWEEN 60 AND 300 AND y + 6 BETWEEN 20 AND 80 + doc_id % 50) GROUP BY doc_id""",
    "layout_real_tables": """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS r, unnest([l_partkey::VARCHAR, l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE l_suppkey::VARCHAR END, CASE WHEN l_orderkey % 3 = 0 THEN 'a cell that reads much more like a sentence of running prose than like any label' ELSE '' END]) AS t FROM lineitem)
SELECT doc_id FROM c GROUP BY doc_id HAVING count(DISTINCT r) >= 2 AND count(*) FILTER (t <> '') >= 4 AND sum(length(t)) / count(*) FILTER (t <> '') < 45 AND count(*) FILTER (t <> '' AND length(t) <= 25) / count(*) FILTER (t <> '') > 0.55""",
    "layout_page_images": """SELECT doc_id, page, ref, seq FROM (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_partkey % 3 AS ref, l_linenumber * 1000000 + l_partkey AS seq, l_partkey % 101 AS w, l_partkey * 7 % 97 AS h, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2, l_partkey % 3 ORDER BY l_linenumber * 1000000 + l_partkey) AS n FROM lineitem) WHERE n = 1 AND w >= 48 AND h >= 48""",
    "display_equations": f"""WITH {LINES}, t AS (SELECT doc_id, CASE WHEN i % 3 = 0 THEN left(line, 10) || ' = ∑ x_{{i}} + β^2 (3)' ELSE line END AS s FROM l),
m AS (SELECT *, length(replace(s, ' ', '')) AS total, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS letters, length(s) - length(translate(s, '{MATH}', '')) AS maths, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS words FROM t)
SELECT doc_id, count(*) AS n_equations FROM m WHERE total >= 3 AND length(s) <= 240 AND words <= 28 AND letters / total < 0.55 AND (maths / total > 0.18 OR (regexp_matches(s, '\\(\\d+\\)\\s*$') AND maths / total > 0.08)) GROUP BY doc_id""",
    "cited_occurrences": f"""WITH {LINES}, n AS (SELECT doc_id, ceil(count(*) / 3) AS n FROM l GROUP BY doc_id), c AS (SELECT doc_id, i, unnest(CASE WHEN i % 3 = 0 THEN [i] WHEN i % 3 = 1 THEN [i, i + 2] ELSE [i, i + 1, i + 2, i + 3] END) AS k FROM l)
SELECT c.doc_id, 'S' || (i % 5) AS section_anchor, 'bib.bib' || k AS target_anchor, count(*) AS n FROM c JOIN n USING (doc_id) WHERE k BETWEEN 1 AND n.n GROUP BY ALL""",
    "parsed_references": f"""WITH {LINES}, t AS (SELECT doc_id, i, {COLLAPSED.format("regexp_replace(line, '[^A-Za-z ]', '', 'g')")} AS t, length(trim(regexp_replace(line, '[^A-Za-z ]', '', 'g'))) AS n, trim(regexp_replace(line, '[^A-Za-z ]', '', 'g')) AS raw FROM l)
SELECT doc_id, i AS ord, (i + 1)::VARCHAR AS num, md5({COLLAPSED.format("left(raw, 600)")}) AS text_md5 FROM t WHERE t <> ''""",
    "normal_texts": rf"""SELECT doc_id, md5(trim(lower({COLLAPSED.format("coalesce(text, '')")}), '.,;:()[]')) AS norm_md5 FROM documents""",
    "content_keys": "SELECT 'pdf-' || left(sha1(text), 16) AS doc_key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "paper_ids": """WITH k AS (SELECT o_orderkey, lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS new FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN new || 'v2' WHEN 4 THEN 'hep-th/' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE new END AS paper_id FROM k""",
    "admitted": """SELECT CASE WHEN NOT starts_with(CASE WHEN doc_id % 3 = 0 THEN '%PDF-' || text ELSE text END, '%PDF-') THEN 'not a PDF' WHEN n_chars // 100 > 50 THEN 'too many pages' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "ingest_plan": """WITH d AS (SELECT user_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'fetched' ELSE 'ready' END, {'t': ts, 'e': event_id}) AS status FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
a AS (SELECT user_id AS doc_key, CASE WHEN status IS NULL THEN 'create' WHEN status <> 'ready' THEN 'retry' WHEN user_id % 5 = 0 THEN 'refresh' END AS action FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN d USING (user_id)) SELECT * FROM a WHERE action IS NOT NULL""",
    "library_listing": """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'key-' || doc_id) AS title FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id DESC LIMIT 100""",
    "cascade_delete": """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'labels', count(*), sum(doc_id)::BIGINT FROM labels WHERE doc_id NOT IN (FROM g)""",
    "inlined_sources": f"""WITH {LINES}, c AS (SELECT doc_id, i // 4 AS c, string_agg(chr(10) || regexp_replace(line, '[^A-Za-z ]', '', 'g'), '' ORDER BY i) || repeat(chr(10), count(*)::INT) AS x FROM l GROUP BY ALL)
SELECT doc_id, md5('A ' || string_agg(x, '' ORDER BY c) || ' \\include{{missing}} B') AS tex_md5 FROM c GROUP BY doc_id""",
    "main_sources": f"""WITH {LINES} SELECT doc_id, 'main.tex' AS path, {len(derived.TEX_HEAD) + len(derived.TEX_TAIL)} + sum(length({derived.TEX_PART}))::BIGINT AS n_chars FROM l GROUP BY doc_id""",
    "layout_assembled": f"""WITH {LINES}, k AS (SELECT doc_id, i // 8 AS block, i, trim(regexp_replace(regexp_replace(line, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM l WHERE i % 5 <> 4),
d AS (SELECT doc_id, block, list(trim(regexp_replace(t, '-+$', '') || CASE WHEN i % 2 = 0 THEN '-' ELSE '' END) ORDER BY i) AS x FROM k GROUP BY ALL)
SELECT doc_id, block, md5(trim(list_reduce(x, lambda a, b: CASE WHEN a[-1:] = '-' AND b <> '' THEN a[:-2] || b WHEN a <> '' THEN a || ' ' || b ELSE b END))) AS text_md5, 10.0::DOUBLE AS size FROM d""",
    "listed_references": f"""WITH {LINES}, t AS (SELECT doc_id, i, coalesce(nullif(regexp_replace(line, '[^A-Za-z]+', '', 'g'), ''), 'none') AS p FROM l),
e AS (SELECT doc_id, i, CASE WHEN doc_id % 2 = 0 THEN i % 900 + 1 ELSE i + 1 END AS num, CASE WHEN doc_id % 2 = 1 AND i % 2 = 0 THEN ') ' || p ELSE p END AS x FROM t)
SELECT doc_id, num::VARCHAR AS num, md5(left(arg_max(x, i), 600)) AS text_md5 FROM e GROUP BY doc_id, num""",
    "article_texts": f"""WITH {LINES}, n AS (SELECT doc_id, ceil(count(*) / 3)::BIGINT AS n FROM l GROUP BY doc_id),
r AS (SELECT l.doc_id, i, n, {ESCAPED.format("regexp_replace(line, '[][]', '', 'g')")} AS t, CASE i % 3 WHEN 0 THEN i::VARCHAR WHEN 1 THEN i || ', ' || (i + 2) ELSE i || '–' || (i + 3) END AS run, list_filter(CASE i % 3 WHEN 0 THEN [i] WHEN 1 THEN [i, i + 2] ELSE [i, i + 1, i + 2, i + 3] END, lambda k: k BETWEEN 1 AND n) AS known FROM l JOIN n USING (doc_id)),
h AS (SELECT doc_id, i, '<section class="ltx_section" id="S' || (i + 1) || '">' || CASE WHEN i % 5 = 4 THEN '' ELSE '<h2 class="ltx_title">' || CASE WHEN i % 2 = 0 THEN '<span class="ltx_tag">' || (i + 1) || '</span> ' ELSE '' END || 'Part &lt;' || i || '&gt;</h2>' END
  || '<p class="ltx_p">' || t || ' [' || CASE WHEN len(known) = 0 THEN run ELSE array_to_string(list_transform(known, lambda k: '<a class="ltx_ref" href="#bib.bib' || k || '">' || k || '</a>'), ', ') END || ']</p>'
  || CASE WHEN i % 4 = 0 THEN '<table class="ltx_tabular"><tr><th>k</th><th>v &amp; w</th></tr><tr><td>' || i || '</td><td>x</td></tr></table>' ELSE '' END || CASE WHEN i % 3 = 0 THEN '<figure class="ltx_figure"><img loading="lazy" src="/assets/x&amp;' || i || '.png"></figure>' ELSE '' END || '</section>' AS h FROM r),
s AS (SELECT doc_id, string_agg(h, '' ORDER BY i) AS s FROM h GROUP BY doc_id), b AS (SELECT doc_id, array_to_string(list_transform(range(1, n + 1), lambda k: '<li class="ltx_bibitem" id="bib.bib' || k || '"><span class="ltx_tag">[' || k || ']</span> Entry ' || k || '</li>'), '') AS b FROM n)
SELECT doc_id, md5('<article class="ltx_document"><h1 class="ltx_title ltx_title_document">Paper ' || doc_id || ' &amp; more</h1>' || CASE WHEN doc_id % 2 = 0 THEN '<div class="ltx_authors">A. Writer, B. Reader</div>' ELSE '' END || s || '<section class="ltx_bibliography" id="bib"><h2 class="ltx_title">References</h2><ul>' || b || '</ul></section></article>') AS html_md5 FROM s JOIN b USING (doc_id)""",
    "rendered_articles": f"""WITH {SEGMENTS}, heads AS (SELECT doc_id, no, lower(trim(text)) IN ('references', 'bibliography', 'works cited') AS refs FROM s WHERE heading), body AS (SELECT doc_id, no, count(*) AS n FROM s WHERE NOT heading AND (no > 0 OR op = 1) GROUP BY ALL),
x AS (SELECT coalesce(h.doc_id, b.doc_id) AS doc_id, coalesce(n, 0) AS n FROM heads h FULL JOIN body b ON h.doc_id = b.doc_id AND h.no = b.no WHERE NOT coalesce(refs, FALSE))
SELECT ti.doc_id, count(x.doc_id) AS n_sections, coalesce(sum(x.n), 0)::BIGINT AS n_paragraphs FROM ti LEFT JOIN x USING (doc_id) GROUP BY ti.doc_id""",
    "layout_bylines": f"""WITH {SEGMENTS}, f AS (SELECT doc_id, pos, regexp_replace(text, '(^|[^\\pL\\pN_])and([^\\pL\\pN_]|$)', '\\1,\\2', 'g') AS text FROM s WHERE no = 0 AND op = 0 AND NOT heading
  AND NOT (regexp_matches(lower(text), '{'|'.join(layout.NOTICE_WORDS)}') OR (words > 12 AND trim(text) LIKE '%.')) AND words <= 40 AND trim(regexp_replace(text, '\\S+@\\S+', '', 'g')) <> ''),
q AS (SELECT doc_id, pos, unnest(range(len(a))) AS nth, unnest(a) AS part FROM (SELECT doc_id, pos, regexp_split_to_array(text, '[,;&]') AS a FROM f)),
v AS (SELECT doc_id, pos, nth, list_filter(regexp_split_to_array(part, '\\s+'), lambda x: x <> '') AS w FROM q),
e AS (SELECT *, list_position(list_transform(w, lambda x: contains(x, '@') OR NOT regexp_matches(x, '^\\p{{Lu}}') OR regexp_matches(lower(trim(x, '{layout.NAME_EDGE}')), '{'|'.join(layout.AFFILIATION_WORDS)}')), TRUE) AS stop FROM v),
n AS (SELECT doc_id, pos, nth, list_transform(w[:CASE WHEN coalesce(stop, 0) > 0 THEN least(stop - 1, 4) ELSE 4 END], lambda x: trim(x, '{layout.NAME_EDGE}')) AS n FROM e),
g AS (SELECT doc_id, array_to_string(n, ' ') AS name, min({{'p': pos, 'n': nth}}) AS place FROM n WHERE len(list_filter(n, lambda x: length(x) > 1)) > 0 GROUP BY ALL),
j AS (SELECT doc_id, string_agg(name, ', ' ORDER BY place) AS b FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(b) > 220 THEN regexp_replace(left(b, 220), ',[^,]*$', '') || '…' ELSE b END AS byline FROM j""",
}
