"""Nodes and edges of the per-paper graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.functions.text import norm_math
from papergraph.operators.latex import structured_body
from papergraph.operators.matching import contained

#: ``sections``: null means unknown, which is not the same as none.
DATA = "struct<excerpt_html:string,section_label:string,grounded:boolean,source:string,label_mathml:string,definition_status:string,sections:array<string>,macro_name:string,count:bigint>"


def _data(**given):
    names = [f.split(":")[0] for f in ("excerpt_html", "section_label", "grounded", "source", "label_mathml", "definition_status", "sections", "macro_name", "count")]
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(DATA)


def target_nodes(targets: DataFrame) -> DataFrame:
    """Targets as nodes; each is its own definition."""
    data = _data(excerpt_html=F.col("excerpt_html"), section_label=F.col("section_label"), grounded=F.lit(True))
    return targets.select("doc_id", F.col("ord").cast("long").alias("node_ord"), "kind", "label", F.col("anchor").alias("html_anchor"), F.col("anchor").alias("definition_anchor"), "excerpt", data.alias("data"))


def symbol_nodes(macros: DataFrame, symbols: DataFrame, math: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Macro expansions with structure, then scanned tokens that no macro spelled already.

    Excerpts stay empty: how a symbol is written does not say what it means.
    ``after`` (doc_id, node_ord) makes the numbers go on.
    """
    fit = macros.where(structured_body(F.col("body")) & ~F.col("body").contains("#") & F.col("body").isNotNull() & F.length("body").between(1, 60) & (F.length("name") <= 24))
    first = Window.partitionBy("doc_id", "body").orderBy("ord")
    fit = fit.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    own = fit.select("doc_id", F.col("body").alias("label"), F.lit(0).alias("pass"), "ord", F.lit("macro").alias("source"), F.concat(F.lit("\\"), "name").alias("macro_name"), F.lit(None).cast("long").alias("count"))
    scanned = symbols.join(own.select("doc_id", F.col("label").alias("token")), ["doc_id", "token"], "left_anti")
    scanned = scanned.select("doc_id", F.col("token").alias("label"), F.lit(1).alias("pass"), "ord", F.lit("math_scan").alias("source"), F.lit(None).cast("string").alias("macro_name"), F.col("count").cast("long").alias("count"))
    every = own.unionByName(scanned)
    every = every.join(symbol_sections(every.select("doc_id", "label"), math), ["doc_id", "label"], "left")
    order = Window.partitionBy("doc_id").orderBy("pass", "ord")
    ordinal = F.row_number().over(order).cast("long")
    if after is not None:
        last = after.groupBy("doc_id").agg(F.max("node_ord").alias("last"))
        every = every.join(last, "doc_id", "left")
        ordinal = ordinal + F.coalesce("last", F.lit(0))
    data = _data(source=F.col("source"), label_mathml=F.lit(""), definition_status=F.lit("unresolved"), sections=F.coalesce("sections", F.array().cast("array<string>")), macro_name=F.col("macro_name"), count=F.col("count"))
    blank = F.lit("")
    return every.select("doc_id", ordinal.alias("node_ord"), F.lit("symbol").alias("kind"), "label", blank.alias("html_anchor"), blank.alias("definition_anchor"), blank.alias("excerpt"), data.alias("data"))


def symbol_sections(symbols: DataFrame, math: DataFrame) -> DataFrame:
    """doc_id, label, sections: where the normal form of a symbol stands in the mathematics."""
    hits = contained(symbols.select("doc_id", "label", norm_math(F.col("label")).alias("key")), math, "section_anchor")
    return hits.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("section_anchor")).alias("sections"))


def resolve_edges(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors to nodes. Unknown targets drop the edge; an unknown source falls back to the
    target; of nodes with one anchor the last counts; repeats are kept.

    Empty sources (preambles) never enter the join, where they would be one hot key.
    """
    last = nodes.where("html_anchor != ''").groupBy("doc_id", F.col("html_anchor").alias("anchor")).agg(F.max("node_ord").alias("node_ord"))
    t = last.withColumnsRenamed({"anchor": "target_anchor", "node_ord": "target_node_ord"})
    s = last.withColumnsRenamed({"anchor": "source_anchor", "node_ord": "source_node_ord"})
    o = occurrences.select("doc_id", F.col("section_anchor").alias("source_anchor"), "target_anchor", "kind").join(t, ["doc_id", "target_anchor"])
    inside = o.where("source_anchor != ''").join(s, ["doc_id", "source_anchor"], "left")
    outside = o.where("source_anchor = '' or source_anchor is null").withColumn("source_node_ord", F.lit(None).cast("long"))
    every = inside.unionByName(outside)
    return every.select("doc_id", "source_anchor", "target_anchor", "kind", F.coalesce("source_node_ord", "target_node_ord").alias("source_node_ord"), "target_node_ord")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, what, n: nodes by kind and edges, for each document and (null id) the corpus."""
    things = nodes.select("doc_id", F.concat(F.lit("node:"), "kind").alias("what")).unionByName(edges.select("doc_id", F.lit("edges").alias("what")))
    per_doc = things.groupBy("doc_id", "what").agg(F.count("*").alias("n"))
    return per_doc.unionByName(per_doc.groupBy("what").agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(nodes.dtypes)["doc_id"]).alias("doc_id"), "what", "n"))
