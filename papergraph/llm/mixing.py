"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies. Its whole part is taken for
certain; of the rest, documents are ranked by their random odds divided by
their inclusion odds, and the first ones are taken until the source's target
is met. Inclusion is unequal: it follows the source's rate and, within a
source, a power of the document's size.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, sorted last; a null id is allowed; repeated rows have the
same rank and are cut in any order, which leaves the same multiset; ties of rank go
by the random number, then the id; a very long text has its full size, and if one
document is larger than its source's target it may be left out; an empty table gives
an empty result; columns that are not named are not read by ``mix_sources``, and
``draw_documents`` keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record, stored, table, word_count

#: ln(odds ratio) is binned over this range; what lies outside goes to the end bins.
SPAN, BINS = 8.0, 8192


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of an MD5."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Add ``target``: the budget (the sum of ``source_size``) shared by weight,
    at most ``most`` times a source's size, the excess reshared by weight.

    ``sources`` has one row a source, so its global ranking is a small sort. The
    level is found by repeated one-row sums; no source list reaches the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stored(sources.withColumn("weight", weight), "mix-sources")
    room = F.col("source_size") * F.lit(float(most))
    total, share = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    if not total or not share:
        return ranked.withColumn("target", F.lit(0.0))
    level, capped = total / share, -1
    while True:
        full = room <= F.col("weight") * F.lit(level)
        n, taken, share = ranked.agg(F.count_if(full), F.sum(F.when(full, room).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not share:
            break
        level, capped = (total - taken) / share, n
    return ranked.withColumn("target", F.least(room, F.col("weight") * F.lit(level)))


def _tilt(level: Column, power: float) -> Column:
    return F.pow(F.lit(2.0), level * F.lit(power))


def _rate(levels: Column, target: Column, power: float, most: float) -> Column:
    """The factor at which the expected words of all size levels meet the target (bisection)."""

    def words(c: Column) -> Column:
        return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + F.least(F.lit(float(most)), c * _tilt(x["level"], power)) * x["words"])

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        less = words(mid) < target
        return record(lo=F.when(less, mid).otherwise(acc["lo"]), hi=F.when(less, acc["hi"]).otherwise(mid))

    # a level's tilt is at least 1, so at hi every document has all its copies
    start = record(lo=F.lit(0.0), hi=F.lit(float(most)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda acc: acc["hi"])


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    power: float = 0.25,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies."""
    out = _mixed(docs, weights, most, power, seed, id_col, text_col, source_col)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def draw_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    power: float = 0.25,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, whatever its columns' names."""
    out = _mixed(docs, weights, most, power, seed, id_col, text_col, source_col, docs.columns)
    kept = out.where("copies > 0").select(F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"), *[f"keep_{k}" for k in range(len(docs.columns))])
    return kept.select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: float, power: float, seed: int, id_col: str, text_col: str, source_col: str, keep=()) -> DataFrame:
    """What both return, with the columns ``keep`` by number.

    The text is read once, for sizes; all later steps use a narrow table. The
    hot source is never in one task: its documents are summed by bins of their
    rank, and only the bin in which the target falls is ordered.
    """
    text = F.col(text_col)
    mark = uniform(F.lit(seed), F.col(id_col), F.col(source_col), F.md5(F.coalesce(text, F.lit(""))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), mark.alias("u"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    sized = stored(sized.withColumn("level", F.floor(F.log2(F.col("size") + F.lit(1.0))).cast("int")), "mix-sizes")

    by_level = sized.groupBy("source", "level").agg(F.sum("size").cast("double").alias("words"))
    sources = by_level.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"), F.array_sort(F.collect_list(F.struct("level", "words"))).alias("levels"))
    planned = source_targets(sources, weights, most)
    planned = planned.select("source", "source_size", "target", _rate(F.col("levels"), F.col("target"), power, most).alias("rate"))
    planned = stored(planned, "mix-targets")

    p = planned.withColumnRenamed("source", "p_source")
    odds = sized.join(p, sized["source"].eqNullSafe(p["p_source"])).drop("p_source")
    expected = F.least(F.lit(float(most)), F.col("rate") * _tilt(F.col("level"), power))
    odds = odds.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))
    whole = F.floor(F.col("expected") + 1e-9).cast("long")
    odds = odds.withColumn("whole", whole).withColumn("part", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    odds = odds.withColumn("drawn", (F.col("part") > 1e-9) & (F.col("size") > 0))
    logit = lambda x: F.log(x) - F.log(1 - x)
    odds = odds.withColumn("rank", F.when(F.col("drawn"), logit(F.col("u")) - logit(F.col("part"))))
    odds = odds.withColumn("bin", F.least(F.greatest(F.floor((F.col("rank") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int"))

    sums = odds.groupBy("source", "target", "bin").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum(F.when(F.col("drawn"), F.col("size"))).alias("words"))
    by_source = Window.partitionBy("source")
    sums = sums.withColumn("left", F.col("target") - F.sum("certain").over(by_source))
    # the bins are few beside the documents: at most BINS a source
    sums = sums.withColumn("upto", F.sum(F.coalesce("words", F.lit(0))).over(by_source.orderBy(F.col("bin").asc_nulls_first())))
    cut = sums.where(F.col("bin").isNotNull() & (F.col("upto") >= F.col("left")))
    cut = cut.groupBy("source").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "left"), "bin").alias("cut"))
    c = stored(cut, "mix-cuts").withColumnRenamed("source", "c_source")
    ranked = odds.join(c, odds["source"].eqNullSafe(c["c_source"]), "left").drop("c_source")

    inside = F.col("drawn") & (F.col("bin") == F.col("cut.bin"))
    edge = ranked.where(F.coalesce(inside, F.lit(False)))
    order = Window.partitionBy("source").orderBy("rank", "u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # a document is taken if that brings the sum nearer to what is left
    edge = edge.withColumn("hit", F.col("cut.before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("cut.left"))
    rest = ranked.where(~F.coalesce(inside, F.lit(False)))
    rest = rest.withColumn("hit", F.col("drawn") & (F.col("cut.bin").isNull() | (F.col("bin") < F.col("cut.bin"))))
    copies = (F.col("whole") + F.when(F.col("hit"), 1).otherwise(0)).cast("long")
    return edge.unionByName(rest).withColumn("copies", copies)


def op8_pareto_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
