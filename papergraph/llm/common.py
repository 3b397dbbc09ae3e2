"""What several operators share: table access, text rules, arrays as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.sources.shared import shared_dir, stored  # noqa: F401

#: A word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(docs: DataFrame, *replaced: str) -> list[str]:
    """The table's columns but those of these names (in any case): what an operator adds
    under a name that is there already takes that column's place."""
    gone = {c.lower() for c in replaced}
    return [c for c in docs.columns if c.lower() not in gone]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(word_array(F.coalesce(text, F.lit("")))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def record(**fields: Column) -> Column:
    """A struct with these names, also inside a lambda."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (as a lambda's variable)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step, zero: Column, width: int = 256) -> Column:
    """Running fold of an array of longs under an associative ``step``.

    Appending to an array copies it, so one fold over n values costs n squared;
    folding pieces of ``width`` and then the pieces' totals costs about
    n * width, which keeps very long texts affordable.
    """
    empty = F.array().cast("array<bigint>")

    def fold(piece: Column) -> Column:
        return F.aggregate(
            piece,
            record(last=zero.cast("bigint"), all=empty),
            lambda acc, x: let(step(acc["last"], x).cast("bigint"), lambda y: record(last=y, all=F.concat(acc["all"], F.array(y)))),
            lambda acc: acc["all"],
        )

    def joined(parts: Column) -> Column:
        before = let(F.transform(parts, lambda p: F.element_at(p, -1)), fold)
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: step(F.get(b, i - 1), x).cast("bigint"))))))

    def pieces(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(width)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: fold(F.slice(v, i * width + 1, F.lit(width))))

    return F.when(F.size(values) == 0, empty).otherwise(let(values, lambda v: F.when(F.size(v) <= width, fold(v)).otherwise(let(pieces(v), joined))))


def rank_of(sorted_values: Column, key, x: Column) -> Column:
    """How many elements of a sorted array have ``key(element) <= x``: binary search."""
    start = record(lo=F.lit(0), hi=F.size(sorted_values))

    def halve(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = key(F.get(sorted_values, mid)) <= x
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            record(lo=F.when(below, mid + 1).otherwise(acc["lo"]), hi=F.when(below, acc["hi"]).otherwise(mid))
        )

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_values) + F.lit(2.0))).cast("int") + 1), start, halve, lambda acc: acc["lo"])


def pieces_of(batches, rows: int = 512, size: int = 4_000_000):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
