"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram binds its letters'
vectors, each permuted by its place, into one; a text bundles its n-grams into
a sum; a language's prototype bundles its texts. A text gets the language whose
prototype has the greatest cosine with its own vector.

Defined cases: a null text and one without letters are ``und`` with score 0, as
is every text if nothing could be learned; rows without a language are not
learned from; ids, repeated rows and extra columns do not matter, and an extra
column with the name of an added one is replaced; a very long text is one text, its
vector built a million pairs at a time; an empty table gives an empty result; ties
go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others as others_of
from .common import pieces_of, remainder, table

#: Components of a vector; letters of an n-gram is fixed at 3.
DIMENSIONS = 1024
#: A text's vector is scaled to this length and rounded, so that sums are exact.
UNIT = 1000


class Letters:
    """Places of letters in a growing table, and the table's vectors."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.place = np.full(0x110000, -1, np.int32)
        self.vectors = np.zeros((0, dimensions), np.int8)
        self._add(32)

    def _vector(self, letter: int) -> np.ndarray:
        return np.random.default_rng((self.seed, letter)).choice(np.array([-1, 1], np.int8), self.dimensions)

    def _add(self, letter: int) -> None:
        self.place[letter] = len(self.vectors)
        self.vectors = np.vstack([self.vectors, self._vector(letter)])

    def places(self, text: str) -> np.ndarray:
        """Lower-case letters by place, runs of all else as one blank (0), a blank at both ends."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.place[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]):
                if chr(p).isalpha():
                    self._add(int(p))
                else:
                    self.place[p] = 0
            found = self.place[points]
        return found[(found > 0) | np.append(True, found[:-1] > 0)]

    def profile(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None without letters."""
        seq = self.places(text or "")
        if not seq.any():
            return None
        own, seq = np.unique(seq, return_inverse=True)
        n, total = len(own), np.zeros(self.dimensions)
        third = self.vectors[own].astype(np.float32)
        first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
        pairs, at = np.unique(seq[:-2] * n + seq[1:-1], return_inverse=True)
        # binding distributes over bundling: a pair binds the sum of its third letters
        step = max(1, 1_000_000 // max(n, self.dimensions))
        for lo in range(0, len(pairs), step):
            here = pairs[lo : lo + step]
            inside = (at >= lo) & (at < lo + step)
            counts = np.bincount((at[inside] - lo) * n + seq[2:][inside], minlength=len(here) * n).reshape(len(here), n)
            bound = (counts.astype(np.float32) @ third) * first[here // n] * second[here % n]
            total += bound.sum(axis=0, dtype=np.float64)
        return total


_letters: dict[tuple[int, int], Letters] = {}


def letters(dimensions: int, seed: int) -> Letters:
    """One table for a worker's life."""
    return _letters.setdefault((dimensions, seed), Letters(dimensions, seed))


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes, from every row that has a language.

    Tasks send one integer a language and component; their sums are exact, so
    that neither the order of tasks nor a lost executor changes them. The result
    holds ``dimensions`` numbers a language, whatever the size of the corpus.
    """

    def run(batches):
        table_, sums = letters(dimensions, seed), {}
        for batch in pieces_of(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = table_.profile(text)
                if v is not None:
                    v = np.rint(v * (UNIT / np.linalg.norm(v))).astype(np.int64) if v.any() else v.astype(np.int64)
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], ["lang", "at", "value"])

    known = docs.where(F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias("lang"))
    sums = known.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("vector")).orderBy("lang").collect()
    return [r["lang"] for r in found], np.array([r["vector"] for r in found], np.float64).reshape(len(found), dimensions)


def predict_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` without the text, with lang_pred and score (the cosine, at least 0), which
    replace columns of these names."""
    others = others_of(docs, text_col, "lang_pred", "score")
    out = docs.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    dimensions = prototypes.shape[1]
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = np.divide(prototypes, lengths, out=np.zeros_like(prototypes), where=lengths > 0)

    def run(batches):
        table_ = letters(dimensions, seed)
        for batch in pieces_of(batches):
            langs, scores = [], []
            for text in batch.column(text_col).to_pylist():
                v = table_.profile(text) if names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = unit @ v / (np.linalg.norm(v) or 1.0)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"])

    return docs.select(*others, text_col).mapInArrow(run, out.schema)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def op1_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = learn_prototypes(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(rows, names, prototypes)
