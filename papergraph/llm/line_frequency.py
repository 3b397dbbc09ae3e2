"""Quality rules by cross-document line frequency.

Normalised lines are hashed and the distinct documents that hold one are
counted per host; lines above the host's limit are boilerplate and count as
removed; a document that loses too large a part of its words is rejected. A few
per-text counts (repeated lines and word windows, symbols) give base rules.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; each row is a document, repeated rows and null ids included;
equal lines of one text count once for their document and all of them go; very long
texts are split and counted whole; an empty table gives an empty result; columns that
are not named are not read, so clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let, record, stored, table, word_array

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    The windows' hashes are sorted with their places; equal neighbours repeat.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))

    def covered(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: record(h=x, i=i)))
        start = record(at=F.lit(-3), n=F.lit(0))
        return F.aggregate(let(paired, places), start, lambda acc, x: record(at=x, n=acc["n"] + F.least(F.lit(3), x - acc["at"])), lambda acc: acc["n"])

    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def full_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def hashed_lines(text: Column) -> Column:
    """Lines that have a word, as sorted structs: hash of the normal form, words, new.

    Normal form: the line's words in lower case, digit runs as 0. ``new`` marks
    the first of a document's equal lines, so that distinct ones can be counted.
    """
    plain = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    each = F.filter(F.transform(F.split(plain, "\n", -1), word_array), lambda w: F.size(w) > 0)
    each = F.transform(each, lambda w: record(line=F.xxhash64(w), words=F.size(w)))
    new = lambda s, x, j: ~F.coalesce(F.get(s, j - 1)["line"] == x["line"], F.lit(False))
    return let(F.sort_array(each), lambda s: F.transform(s, lambda x, j: record(line=x["line"], words=x["words"], new=new(s, x, j))))


def text_counts(text: Column) -> Column:
    """A struct of the counts that one text alone gives."""
    lines = full_lines(text)
    return let(
        word_array(text),
        lambda w: record(
            n_words=F.size(w).cast("long"),
            word_chars=F.length(F.translate(text, BLANKS, "")).cast("long"),
            n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            n_dup_lines=let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
            n_repeat_words=repeated_words(w),
        ),
    )


def line_frequency_rules(
    docs: DataFrame,
    least_docs: int = 20,
    host_share: float = 0.005,
    least_left: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, the counts, n_removed_words, base_failed, kept.

    A line is removed if more distinct documents of its host hold it than
    ``least_docs`` and than ``host_share`` of the host's documents. A document is
    depleted if less than ``least_left`` of its words are left.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    d = d.select("doc_id", "host", F.xxhash64("host", "text").alias("same"), text_counts(F.col("text")).alias("counts"), F.posexplode_outer(hashed_lines(F.col("text"))).alias("at", "x"))
    # The texts are read once; the counts ride on a document's first row alone.
    first = F.coalesce("at", F.lit(0)) == 0
    rows = stored(d.select("doc_id", "host", "same", F.col("x.line").alias("line"), F.col("x.words").alias("words"), F.col("x.new").alias("new"), F.when(first, F.col("counts")).alias("counts")), "lines")

    # a document's distinct lines count once each; the sums start before the shuffle
    seen = rows.where(F.col("line").isNotNull()).groupBy("host", "line").agg(F.count_if("new").alias("n_docs"))
    hosts = rows.where(F.col("counts").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "h")
    # no line can pass the limit below least_docs, so nearly all rows end here
    often = seen.where(F.col("n_docs") > least_docs)
    often = often.join(hosts, often["host"].eqNullSafe(hosts["h"])).where(F.col("n_docs") > F.col("host_docs") * F.lit(host_share))
    often = often.select(F.col("host").alias("o_host"), F.col("line").alias("o_line"))

    # rows without a line go by their text, so that they do not all meet in one task
    key = F.coalesce(rows["line"], F.xxhash64("doc_id", "same"))
    marked = rows.join(often, rows["host"].eqNullSafe(often["o_host"]) & (key == often["o_line"]) & rows["line"].isNotNull(), "left")
    removed = F.sum(F.when(F.col("o_line").isNotNull(), F.col("words")).otherwise(0))
    out = marked.groupBy("doc_id", "same").agg(F.first("counts", ignorenulls=True).alias("counts"), F.count("counts").alias("copies"), removed.alias("removed"))
    # repeated rows met in one group: they share it evenly and come out as often as they came in
    out = out.withColumn("n_removed_words", (F.col("removed") / F.col("copies")).cast("long"))
    out = out.select("doc_id", "counts.*", "n_removed_words", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < F.lit(least_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def op9_line_frequency(spark, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents"))
