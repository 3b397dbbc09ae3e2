"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the words (repeated words, stems) that a text holds, with an L1
penalty. Labelled texts that name an identity group are also written with the
group swapped for another of its kind, and the squared change of the score is
penalised: the mention alone can then not move the score, which spares neutral
texts about a group.

The model is fitted on a bounded sample of labelled rows: ``most_toxic`` and
``most_other`` rows at most, those with the smallest hash of the id. Of their features those
take part that are seen LEAST_SEEN times and whose counts under the two labels differ from
chance by LEAST_STRANGE; scoring reads whole texts and has no limit.

Defined cases: a null or empty text is scored by the intercept alone; rows whose
label or id is null are not learned from, an id with several labels counts as
toxic if one says so; repeated rows and extra columns do not matter, and a column
with the name of an added one is replaced; a text of any length is one set of
features; an empty table gives an
empty result; without labelled rows every score is 0.5, with one class alone its
smoothed share.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others as others_of
from .common import pieces_of, remainder, stored, table

#: Kinds of identity groups; a term is swapped for the next one of its kind.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("woman", "man"), ("women", "men"), ("she", "he"), ("girl", "boy"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "blind", "deaf"),
    ("musulman", "chrétien", "juif", "athée"), ("femme", "homme"), ("femmes", "hommes"),
    ("moslem", "christ", "jude", "atheist"), ("frau", "mann"), ("frauen", "männer"),
    ("musulmán", "cristiano", "judío", "ateo"), ("mujer", "hombre"), ("mujeres", "hombres"),
)

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4


def features(text: str | None) -> np.ndarray:
    """Sorted 32-bit hashes of the words, of repeated ones and of the stems of longer ones."""
    words = Counter(LETTERS.findall((text or "").lower()))
    stems = {w[:STEM] for w in words if len(w) > STEM} | {w[: STEM + 1] for w in words if len(w) > STEM + 1}
    again = [w for w, n in words.items() if n > 1]
    hashed = {xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), k) for k, part in enumerate((words, stems, again)) for w in part}
    return np.array(sorted(hashed), np.uint32)


@lru_cache
def swap_table(kinds: tuple) -> dict[str, str]:
    """Each term and the next of its kind; a term of several kinds turns within the first."""
    return {t: kind[(i + 1) % len(kind)] for kind in reversed(kinds) for i, t in enumerate(kind)}


def swapped(text: str | None, kinds=IDENTITY_TERMS) -> str | None:
    """The text with each identity term replaced by the next of its kind; None if it has none."""
    turn = swap_table(kinds)
    out = LETTERS.sub(lambda m: turn.get(m[0].lower(), m[0]), text or "")
    return out if out != (text or "") else None


@dataclass
class Model:
    """Weights by feature hash (sorted), and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, found: np.ndarray) -> float:
        if not len(self.keys) or not len(found):
            return float(1 / (1 + np.exp(-self.intercept)))
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        total = self.intercept + self.weights[at][self.keys[at] == found].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


@dataclass
class Rows:
    """Feature numbers of many texts, end to end; products take some texts at a time to stay small."""

    columns: np.ndarray
    ends: np.ndarray
    step: int = 500

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([np.zeros(0, np.uint8), *texts]), np.cumsum([0, *map(len, texts)]))

    def _parts(self):
        for lo in range(0, len(self.ends) - 1, self.step):
            ends = self.ends[lo : lo + self.step + 1]
            yield slice(lo, lo + len(ends) - 1), self.columns[ends[0] : ends[-1]], ends - ends[0]

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each text the sum of its features' weights."""
        out = np.zeros(len(self.ends) - 1)
        for here, columns, ends in self._parts():
            out[here] = np.diff(np.concatenate([[0.0], np.cumsum(w[columns])])[ends])
        return out

    def back(self, e: np.ndarray, width: int) -> np.ndarray:
        """For each feature the sum of ``e`` over the texts that have it."""
        out = np.zeros(width)
        for here, columns, ends in self._parts():
            out += np.bincount(columns, weights=np.repeat(e[here], np.diff(ends)), minlength=width)
        return out


def _class_counts(rows: list[np.ndarray], labels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, in how many rows each is, and in how many of label 1."""
    counted = lambda some: np.unique(np.concatenate([np.zeros(0, np.uint32), *some]), return_counts=True)
    keys, seen = counted(rows)
    some, times = counted([r for r, label in zip(rows, labels, strict=True) if label])
    toxic = np.zeros(len(keys), np.int64)
    toxic[np.searchsorted(keys, some)] = times
    return keys, seen, toxic


def _strangeness(seen, toxic, share: float):
    """How far the count among label 1 is from its expectation, of numbers or columns alike."""
    return (toxic - seen * share) ** 2 / (seen * (share * (1 - share)))


#: A feature takes part if seen as often as this, and as strange as this.
LEAST_SEEN, LEAST_STRANGE = 3, 4


def _places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Numbers of the features that are among ``keys``, in the smallest type that holds them."""
    kind = np.min_scalar_type(len(keys))
    if not len(keys):
        return np.zeros(0, kind)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return at[keys[at] == found].astype(kind)


def _change(keys: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features gained and lost by swapping."""
    a, b = _places(keys, own), _places(keys, other)
    return np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)


def _one_class(y_sum: int, n: int) -> Model:
    """What is known without both labels: nothing, or a smoothed share."""
    p = (y_sum + 0.5) / (n + 1) if n else 0.5
    return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(p / (1 - p))))


def fit(rows: list[np.ndarray], labels: np.ndarray, others: list[tuple[int, np.ndarray]], share: float | None = None, **options) -> Model:
    """Fit on feature arrays; ``others`` has (row, features of the swapped text)."""
    y, n = labels.astype(np.float64), len(rows)
    if n == 0 or y.min() == y.max():
        return _one_class(y.sum(), n)
    keys, seen, toxic = _class_counts(rows, labels)
    strange = _strangeness(seen, toxic, y.mean())
    keys = keys[(seen >= LEAST_SEEN) & (strange > LEAST_STRANGE)]
    changes = [_change(keys, rows[k], x) for k, x in others]
    return _solved(keys, Rows.of([_places(keys, r) for r in rows]), y, Rows.of([x for x, _ in changes]), Rows.of([x for _, x in changes]), share, **options)


def _solved(keys: np.ndarray, rows: Rows, y: np.ndarray, gained: Rows, lost: Rows, share: float | None, l1: float = 1e-4, swap: float = 1.0, rounds: int = 400) -> Model:
    """Minimises the mean log loss + ``l1`` * sum |w| + ``swap`` * the mean squared
    change of the linear score under swapping, by accelerated proximal steps.
    ``share`` is the share of label 1 that the intercept is set for.
    """
    n, m, width = len(y), max(1, len(gained.ends) - 1), len(keys)

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z, change = rows.times(w) + b, gained.times(w) - lost.times(w)
        return np.mean(np.logaddexp(0, z) - y * z) + swap / m * (change**2).sum(), z, change

    def gradient(z: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, float]:
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        return rows.back(e, width) + 2 * swap / m * (gained.back(change, width) - lost.back(change, width)), float(e.sum())

    w, b, step, momentum = np.zeros(width), float(np.log(y.mean() / (1 - y.mean()))), 1.0, 1.0
    v, vb = w, b
    for _ in range(rounds):
        here, z, change = loss(v, vb)
        g, gb = gradient(z, change)
        while True:  # the step shrinks until the quadratic bound holds
            t = v - step * g
            new, nb = np.sign(t) * np.maximum(np.abs(t) - step * l1, 0), vb - step * gb
            d, db = new - v, nb - vb
            if step < 1e-6 or loss(new, nb)[0] <= here + g @ d + gb * db + (d @ d + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / following * (new - w), nb + (momentum - 1) / following * (nb - b)
        w, b, momentum = new, nb, following
        step *= 1.1
    if share and 0 < share < 1:
        b += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    used = w != 0
    return Model(keys[used], w[used], float(b))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_other: int = 8000, label_col: str = "toxic", text_col: str = "text", kinds=IDENTITY_TERMS, **options) -> Model:
    """A model from the texts whose ids ``labels`` (doc_id, ``label_col``) marks.

    Features are found, counted and chosen on the executors; to the driver come
    only the chosen ones, as small numbers, of the rows within the two limits.
    An id with several texts is learned from once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total, toxic = known.agg(F.count("*"), F.sum("y")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(most_toxic).unionByName(known.where("y = 0").orderBy(*order).limit(most_other))
    as_array = lambda x: np.frombuffer(x, np.uint32)
    binary = lambda arrays: pa.array([None if x is None else x.tobytes() for x in arrays], pa.binary())

    def find(batches):
        for batch in pieces_of(batches):
            texts = batch.column(2).to_pylist()
            other = (swapped(t, kinds) for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary(map(features, texts)), binary(None if s is None else features(s) for s in other)], ["doc_id", "y", "own", "other"])

    def count(batches):
        for batch in pieces_of(batches):
            counts = _class_counts([as_array(x) for x in batch.column("own").to_pylist()], batch.column("y").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in counts], ["key", "seen", "toxic"])

    texts = docs.select("doc_id", text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", text_col)
    found = texts.mapInArrow(find, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, own binary, other binary")
    found = stored(found.groupBy("doc_id").agg(F.min(F.struct("y", "own", "other")).alias("row")).select("row.*"), "features")
    n, ones = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if ones in (0, n):
        return _one_class(ones, n)
    tallied = found.mapInArrow(count, "key long, seen long, toxic long").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    strange = tallied.where(F.col("seen") >= LEAST_SEEN).select("key", _strangeness(F.col("seen"), F.col("toxic"), ones / n).alias("strange"))
    best = strange.where(F.col("strange") > LEAST_STRANGE).select("key")
    keys = np.sort(best.toArrow().column("key").to_numpy().astype(np.uint32))

    def code(batches):
        for batch in pieces_of(batches):
            own, other = ([None if x is None else as_array(x) for x in batch.column(c).to_pylist()] for c in ("own", "other"))
            changes = [(None, None) if y is None else _change(keys, x, y) for x, y in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), binary(_places(keys, x) for x in own), binary(x for x, _ in changes), binary(x for _, x in changes)], ["y", "own", "gained", "lost"])

    coded = found.mapInArrow(code, "y int, own binary, gained binary, lost binary").toArrow()
    taken = sorted(zip(*(coded.column(c).to_pylist() for c in ("y", "own", "gained", "lost")), strict=True), key=lambda x: (x[0], x[1], x[2] or b"", x[3] or b""))
    del coded
    kind = np.min_scalar_type(len(keys))
    as_rows = lambda k: Rows.of([np.frombuffer(x[k], kind) for x in taken if x[k] is not None])
    return _solved(keys, as_rows(1), np.array([x[0] for x in taken], np.float64), as_rows(2), as_rows(3), toxic / total, **options)


def score_texts(docs: DataFrame, model: Model, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score and predicted, which replace columns of these names."""
    others = others_of(docs, text_col, "score", "predicted")
    out = docs.select(*others, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches):
        for batch in pieces_of(batches):
            scores = [model.score(features(t)) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32())], [*others, "score", "predicted"])

    return docs.select(*others, text_col).mapInArrow(run, out.schema)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""

    def run(batches):
        for batch in pieces_of(batches):
            clean = [model.score(features(t)) < limit for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1


def learned_model(spark, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels")
    return learn(table(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"))))


def op4_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), learned_model(spark, sf_dir))
