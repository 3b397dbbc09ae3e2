"""Landed papers: readers, source selection, input inlining and the JSON export of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergraph.functions.text import collapse, filled, strip
from papergraph.sources.shared import stored


def read_corpus(spark: SparkSession, path: str, kind: str = "html") -> DataFrame:
    """Landed files: ``html`` and ``tex`` as (doc_key, path, text), ``binary`` as
    (doc_key, path, content), ``parquet`` and ``json`` as they are.

    The key is the folder under which a paper's files lie.
    """
    if kind in ("parquet", "json"):
        return spark.read.format(kind).load(path)
    key = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    if kind == "binary":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(key(F.col("path")).alias("doc_key"), "path", "content", "length")
    pattern = "*.html" if kind == "html" else "*.{tex,bbl}"
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return files.select(key(F.input_file_name()).alias("doc_key"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("path"), F.col("value").alias("text"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_key, title, authors of Atom entries (id, title, author/name)."""
    schema = "id string, title string, author array<struct<name:string>>"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    names = F.filter(F.transform(F.coalesce("author", F.array()), lambda a: strip(a["name"])), lambda n: n != "")
    return entries.select(F.regexp_extract(strip(F.col("id")), r"([^/]+?)(?:v\d+)?$", 1).alias("doc_key"), collapse(F.col("title")).alias("title"), F.array_join(names, ", ").alias("authors"))


def pick_main_source(files: DataFrame) -> DataFrame:
    """doc_id, path, text: of the files with a document class, the one that begins a
    document, then the longest, then the greatest path."""
    tex = files.where(F.col("path").endswith(".tex") & F.col("text").contains(r"\documentclass"))
    rank = F.struct(F.col("text").contains(r"\begin{document}"), F.length("text"), "path")
    return tex.groupBy("doc_id").agg(F.max_by(F.struct("path", "text"), rank).alias("m")).select("doc_id", "m.*")


def inline_inputs(files: DataFrame, main: DataFrame, depth: int = 5) -> DataFrame:
    r"""doc_id, tex: ``\input`` and ``\include`` replaced by the files they name, ``depth``
    times at most, then every ``.bbl`` file. Unknown, blank and ``#`` names stay as typed.

    Only papers in which the last round found a file go on, and rounds end with them.
    """
    command = r"\\(?:input|include)\{([^}]*)\}"
    named = files.select("doc_id", F.col("path").alias("name"), F.concat(F.lit("\n"), "text", F.lit("\n")).alias("insert"))
    now, done = main.select("doc_id", F.col("text").alias("tex"), F.lit(True).alias("more")), []
    for turn in range(depth):
        again = F.col("more") & F.col("tex").rlike(command)
        done.append(now.where(~again))
        live = now.where(again)
        if turn and live.isEmpty():
            break
        gaps, whole = F.split("tex", command, -1), F.regexp_extract_all("tex", F.lit(command), F.lit(0))
        rows = live.select("doc_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), whole.alias("typed"))).alias("at", "p")).select("doc_id", "at", "p.*")
        rows = rows.withColumn("name", strip(F.regexp_extract("typed", command, 1)))
        asked = F.when((F.col("name") == "") | F.col("name").startswith("#"), F.lit(None)).when(F.col("name").rlike(r"\.[A-Za-z]+$"), F.col("name")).otherwise(F.concat("name", F.lit(".tex")))
        found = rows.withColumn("name", asked).join(named, ["doc_id", "name"], "left")
        piece = F.concat("gap", F.coalesce("insert", "typed", F.lit("")))
        joined = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", piece.alias("t"))))["t"], "").alias("tex"), F.max(F.col("insert").isNotNull()).alias("more"))
        now = stored(joined, "inlined")
    else:
        done.append(now)
    every = reduce(DataFrame.unionByName, done).drop("more")
    bbl = files.where(F.col("path").endswith(".bbl")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("path", "text")))["text"], "\n").alias("bbl"))
    return every.join(bbl, "doc_id", "left").select("doc_id", F.when(F.col("bbl").isNull(), F.col("tex")).otherwise(F.concat("tex", F.lit("\n"), "bbl")).alias("tex"))


# What the types of images and papers begin with, as hex.
LEADING = {
    "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "47494638", "image/webp": "52494646", "image/bmp": "424D", "image/tiff": "49492A00",
    "application/pdf": "255044462D", "image/svg+xml": "3C737667",
}


def content_type(data: Column) -> Column:
    """The type that a file's leading bytes tell; octets if none."""
    head = F.hex(F.substring(data, 1, 16))
    text = F.lower(F.substring(F.decode(F.substring(data, 1, 512), "ISO-8859-1"), 1, 512))
    svg = F.ltrim(text).startswith("<?xml") & text.contains("<svg")
    found = F.lit("application/octet-stream")
    for kind, lead in LEADING.items():
        found = F.when(head.startswith(lead), kind).otherwise(found)
    return F.when(svg, "image/svg+xml").when(head.startswith("52494646") & (F.substring(head, 17, 8) != "57454250"), "application/octet-stream").otherwise(found)


def stored_assets(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets (doc_id, path, content_type, content_hash, n_bytes), payloads (content_hash,
    data: one a content) and what is missing (doc_id, path).

    ``manifest``: doc_id, path; ``files``: doc_id, path, content; null and empty contents count
    as missing, of equal paths in a document the least content counts. Only hashes are
    grouped; a payload that very many documents share moves once a task at most.
    """
    there = files.where(F.length("content") > 0).select("doc_id", "path", "content").withColumn("content_hash", F.sha2("content", 256))
    marks = there.select("doc_id", "path", "content_hash", content_type(F.col("content")).alias("content_type"), F.length("content").cast("long").alias("n_bytes"))
    best = marks.groupBy("doc_id", "path").agg(F.min(F.struct("content_hash", "content_type", "n_bytes")).alias("file"))
    listed = manifest.select("doc_id", "path").distinct().join(best, ["doc_id", "path"], "left")
    assets = listed.where("file is not null").select("doc_id", "path", "file.content_type", "file.content_hash", "file.n_bytes")
    wanted = assets.select("content_hash").distinct()
    payloads = there.select("content_hash", F.col("content").alias("data")).join(wanted, "content_hash", "left_semi").dropDuplicates(["content_hash"])
    return assets, payloads, listed.where("file is null").select("doc_id", "path")


def assets_with_data(assets: DataFrame, payloads: DataFrame) -> DataFrame:
    """doc_id, path, content_type, data: what a reader is served."""
    return assets.join(payloads, "content_hash").select("doc_id", "path", "content_type", "data")


def export_graph_json(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, json: one object a document with its node and edge lists in order."""
    node_cols = [c for c in nodes.columns if c != "doc_id"]
    edge_cols = [c for c in edges.columns if c != "doc_id"]
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", *[c for c in node_cols if c != "node_ord"]))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*edge_cols))).alias("edges"))
    joined = docs.join(n, "doc_id", "left").join(e, "doc_id", "left")
    header = [c for c in docs.columns]
    return joined.select("doc_id", F.to_json(F.struct(*header, F.coalesce("nodes", F.array()).alias("nodes"), F.coalesce("edges", F.array()).alias("edges"))).alias("json"))


def titled(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``docs`` with ``title``: the first choice, else the second, else the key."""
    return docs.withColumn("title", filled(F.col(first), F.col(second), F.col("doc_key")))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
