"""Fill-in-the-middle transformation, as a pyarrow.compute pipeline a batch.

Texts are split into units (a word with the white space before it; trailing white space
is a unit of its own) as list arrays, flattened with their parents' indices and numbered;
units are filtered by role (prefix, middle, suffix), rebuilt into lists and joined, and the
pieces are joined with the marks. No text is walked in Python.

Which texts are changed, and where they are cut, goes by the sha256 of ``seed:id``, so that
reruns agree whatever the partitioning.

Defined cases: a null or empty text is plain and comes out empty; a text that holds a mark
is plain, since it could not be rebuilt; a text of white space alone is one unit; a null id
counts as the empty text, so that its rows share one draw; repeated rows come out alike; a
very long text is cut whole, in memory in step with it; an empty table gives an empty
result; columns that are not named go through, but those with the name of an added one are
replaced. No ties arise: the cuts are the smaller and the larger of two draws.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, others, pieces_of, table

BLANK = r"[\x20\x09-\x0D]+"
PREFIX, MIDDLE, SUFFIX = range(3)
MARKS = ("<P>", "<M>", "<S>")
ADDED = {"fim_form": (pa.string(), "string"), "fim_text": (pa.string(), "string"), "n_units": (pa.int64(), "long"), "prefix_chars": (pa.int64(), "long"), "middle_chars": (pa.int64(), "long")}


def draws(doc_id: Column, seed: int) -> Column:
    """The first four groups of 8 hex digits of the sha256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(digest.substr(8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def remainder(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def starts(parents: pa.Array, rows: int) -> np.ndarray:
    """Offsets of ``rows`` lists whose elements have these (sorted) parents."""
    return np.searchsorted(parents.to_numpy(), np.arange(rows + 1))


def units_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All units of all texts (no nulls), and the text's index of each."""
    gaps, words = pc.split_pattern_regex(texts, WORD), pc.split_pattern_regex(texts, BLANK)
    blank, parent = pc.list_flatten(gaps), pc.list_parent_indices(gaps)
    word = pc.list_flatten(words)
    word = word.filter(pc.not_equal(word, ""))
    # a text has one gap more than words: its last gap has no word behind it
    last = np.diff(parent.to_numpy(), append=len(texts)) > 0
    behind = pc.fill_null(word.take(pa.array(np.cumsum(~last) - 1, mask=last)), "")
    units = pc.binary_join_element_wise(blank, behind, "")
    real = pc.not_equal(units, "")
    return units.filter(real), parent.filter(real)


def transform(texts: pa.Array, drawn: list[pa.Array], rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """The added columns of a batch of texts; ``drawn``: four arrays of numbers."""
    rows = len(texts)
    texts = pc.fill_null(texts, "")
    units, parent = units_of(texts)
    first = starts(parent, rows)
    n = pa.array(np.diff(first))
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pa.array(first[:-1]).take(parent))
    cuts = [remainder(h, pc.add(n, 1)) for h in drawn[:2]]
    lo, hi = (f(*cuts).take(parent) for f in (pc.min_element_wise, pc.max_element_wise))
    role = pc.add(pc.greater_equal(ordinal, lo).cast(pa.int8()), pc.greater_equal(ordinal, hi).cast(pa.int8()))

    def joined(of: int) -> pa.Array:
        mine = pc.equal(role, of)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(parent.filter(mine), rows), pa.int32()), units.filter(mine)), "")

    prefix, middle, suffix = joined(PREFIX), joined(MIDDLE), joined(SUFFIX)
    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(remainder(drawn[2], 100), rate))
    for mark in MARKS:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(remainder(drawn[3], 100), spm_rate)
    p, m, s = MARKS
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    none = pa.scalar(None, pa.int64())
    return {
        "fim_form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "fim_text": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
        "n_units": n.cast(pa.int64()),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
    }


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with fim_form (plain, psm or spm), fim_text, n_units, prefix_chars and
    middle_chars (code points; null if plain).

    ``rate`` percent of the texts are rearranged, of those ``spm_rate`` percent with the
    suffix first. One narrow pass; nothing is shuffled.
    """
    kept = others(docs, *ADDED)
    out = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, (_, t) in ADDED.items()])

    def run(batches):
        for batch in pieces_of(batches):
            drawn = batch.column(len(kept))
            found = transform(batch.column(kept.index(text_col)), [pc.list_element(drawn, k) for k in range(4)], rate, spm_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(found[c].cast(t) for c, (t, _) in ADDED.items())], [*kept, *ADDED])

    return docs.select(*kept, draws(F.col(id_col), seed).alias("__fim_draws__")).mapInArrow(run, out.schema)


def restored(form: Column, text: Column) -> Column:
    """The text before the transformation, from its form and output alone.

    Changed texts hold each mark once, and no mark can arise where a piece meets a mark.
    """
    piece = F.split(text, "<[PMS]>", -1)
    return F.when(form == "plain", text).when(form == "psm", F.concat(F.get(piece, 1), F.get(piece, 3), F.get(piece, 2))).otherwise(F.concat(F.get(piece, 2), F.get(piece, 3), F.get(piece, 1)))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("n_units").alias("n"),
        F.col("fim_form").alias("form"),
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_form"), F.col("fim_text")), 256).alias("restored_sha256"),
    )
