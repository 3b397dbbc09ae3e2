"""Hidden Markov language model, with word counts over the whole corpus.

A text is a sequence of words and one end. Words fall into a fixed number of
classes (short words by themselves, longer ones by their ending, hashed). The
hidden states emit classes; a class gives its words by their training counts:

    p(text) = p(classes | HMM) * product of (c + 0.1) / (mass of the word's class)

Every round of Baum-Welch runs over all training texts, until one gains too
little likelihood. Texts are cut into segments of SEGMENT words that advance
together; a later segment starts from a distribution of its own, not from the
state before it, so steps over segment edges are not counted in training. Each task sums its expected counts, the sums over tasks give the
next parameters. Scoring is the scaled forward recursion over whole texts.

Texts are read once and kept as units: some thousand texts with one sorted list
of their distinct words. Each unit sends a distinct word once to be counted and
gets one count back: counting is a grouped sum over words, a unit's counts meet it by
the unit's number, and so every group is bounded by a unit or summed up before the
shuffle, however large the corpus.

Defined cases: a null or empty text is its end alone; null and repeated ids are
texts of their own; without training texts all counts are 0 and the states stay
even; very long texts are scored whole, a unit being as large as its longest text; ties
and clashing names don't occur, since columns that are not named are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, remainder, stored, table
from .hashing import RangeHash, mixed

CLASS_BITS = 14
CLASSES, STATES, SEGMENT = 1 << CLASS_BITS, 8, 128
END = CLASSES - 1
#: Words after which forward probabilities are scaled.
SCALED = 4
#: Expected counts travel as integers of this fraction, so that sums are exact.
FRACTION = 1 << 12
ADD = 0.1

UNIT_SCHEMA = "unit long, ids binary, n_ids int, held binary, lengths binary, words binary, tokens binary, trained binary"


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of integers, one plane a byte place; the length goes first."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def expand(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


_letters = mixed(np.arange(256, dtype=np.uint64), 11)
_whole, _ending = RangeHash(0x9E3779B97F4A7C15), RangeHash(0xD6E8FEB86659FD93)


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, one after another, as 50 bits of their hash and then their
    class; and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    byte = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = turn[::2], turn[1::2]
    bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
    values = _letters[byte]
    long = end - start > 5  # classes: short words by themselves, longer ones by their ending
    key = _ending.of(values, np.where(long, end - 3, start), end) + long.astype(np.uint64)
    word = _whole.of(values, start, end)
    token = (word >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS)) | (mixed(key, 7) % np.uint64(END))
    return token, np.diff(np.searchsorted(start, bounds))


def make_units(docs: DataFrame, id_col: str, text_col: str, held_col: str, rows: int = 2048, size: int = 8_000_000) -> DataFrame:
    """One row a unit; see UNIT_SCHEMA. ``ids`` is an Arrow stream, the others number arrays."""

    def run(batches):
        count = 0
        for batch in pieces_of(batches, rows, size):
            # hashed some texts at a time, whose powers take little memory
            parts = [tokens_of([t or "" for t in x.column(1).to_pylist()]) for x in pieces_of([batch], rows, 1_000_000)]
            tokens, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            lengths = np.concatenate([x for _, x in parts]).astype(np.uint32)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            trained = np.bincount(at[np.repeat(held == 0, lengths)], minlength=len(tokens)).astype(np.uint32)
            sink = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"])
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            number = (TaskContext.get().partitionId() << 32) | count
            count += 1
            row = [number, sink.getvalue().to_pybytes(), batch.num_rows, held.tobytes(), lengths.tobytes(), squeeze(at.astype(np.uint32)), squeeze(tokens), squeeze(trained)]
            yield pa.RecordBatch.from_pydict(dict(zip(["unit", "ids", "n_ids", "held", "lengths", "words", "tokens", "trained"], ([x] for x in row), strict=True)), schema=schema)

    schema = pa.schema([("unit", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int32()), *((c, pa.binary()) for c in ("held", "lengths", "words", "tokens", "trained"))])
    return docs.select(id_col, text_col, F.col(held_col)).mapInArrow(run, UNIT_SCHEMA)


def sent_words(units: DataFrame) -> DataFrame:
    """token, unit, at, trained: a row for each distinct word of a unit and its place there."""

    def send(batches):
        for batch in batches:
            for unit, tokens, trained in zip(*(batch.column(c).to_pylist() for c in ("unit", "tokens", "trained")), strict=True):
                tokens, trained = expand(tokens, np.uint64), expand(trained, np.uint32)
                for lo in range(0, len(tokens), 65_536):
                    part = tokens[lo : lo + 65_536].view(np.int64)
                    columns = [part, np.full(len(part), unit), np.arange(lo, lo + len(part), dtype=np.int32), trained[lo : lo + 65_536].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "unit", "at", "trained"])

    return units.select("unit", "tokens", "trained").mapInArrow(send, "token long, unit long, at int, trained long")


def class_totals(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trained words, and trained words, of each class; ``totals`` has token, n."""
    cls = F.col("token").bitwiseAND(F.lit(CLASSES - 1))
    rows = totals.where("n > 0").groupBy(cls.cast("int").alias("class")).agg(F.count("*"), F.sum("n"))
    kinds, number = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, k, n in rows.toLocalIterator():
        kinds[c], number[c] = k, n
    return kinds, number


@dataclass
class Chain:
    """Parameters: of the first state, of a segment's first state, of steps, of emissions."""

    first: np.ndarray
    inside: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # classes x states


def unit_sequences(row: dict, train_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a unit's texts, ends included, one after another; the texts' lengths."""
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    classes = (expand(row["tokens"], np.uint64) & np.uint64(CLASSES - 1)).astype(np.int64)[expand(row["words"], np.uint32)]
    if train_only:
        free = np.frombuffer(row["held"], np.uint8) == 0
        classes, lengths = classes[np.repeat(free, lengths)], lengths[free]
    ends = np.cumsum(lengths)
    return np.insert(classes, ends, END), lengths + 1


def expected_counts(seq: np.ndarray, lengths: np.ndarray, chain: Chain, segment: int = SEGMENT) -> dict[str, np.ndarray]:
    """Forward-backward over segments of at most ``segment`` words, all in step.

    Emissions are taken relative to a class's mean over the states, which changes no
    expected count and keeps products near 1, so that they are scaled every SCALED words.
    ``fit`` is the segments' log-likelihood under ``chain``.
    """
    k = len(chain.first)
    out = {"first": np.zeros(k), "inside": np.zeros(k), "step": np.zeros((k, k)), "emit": np.zeros((CLASSES, k)), "fit": np.zeros(1)}
    if not len(seq):
        return out
    cuts = -(-lengths // segment)
    text_at = np.cumsum(lengths) - lengths
    which = np.repeat(np.arange(len(lengths)), cuts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = text_at[which] + nth * segment
    size = np.minimum(segment, lengths[which] - nth * segment)
    order = np.argsort(-size, kind="stable")
    start, size, head = start[order], size[order], nth[order] == 0
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    mean = np.maximum(chain.emit.mean(axis=1), 1e-300)
    emit, step = (chain.emit / mean[:, None]).astype(np.float32), chain.step.astype(np.float32)
    words = [seq[start[:n] + t] for t, n in enumerate(live)]
    flat = np.concatenate(words)
    alphas: list[np.ndarray] = []
    given: list[np.ndarray] = []
    norms: dict[int, np.ndarray] = {}
    a = np.where(head[:, None], chain.first, chain.inside).astype(np.float32)
    for t, n in enumerate(live):
        given.append(emit[words[t]])
        a = (a if t == 0 else a[:n] @ step) * given[t]
        if t % SCALED == SCALED - 1:
            norms[t] = a.sum(axis=1, keepdims=True)
            a = a / norms[t]
            out["fit"] += np.log(norms[t], dtype=np.float64).sum()
        alphas.append(a)
    out["fit"] += np.log(mean)[flat].sum()
    beta = np.ones((0, k), np.float32)
    for t in range(len(live) - 1, -1, -1):
        n, later = live[t], len(beta)
        if later:  # beta stands for the words after t
            ahead = beta * given[t + 1]
            if t + 1 in norms:
                ahead /= norms[t + 1]
            out["step"] += alphas[t][:later].T @ ahead
            beta = ahead @ step.T
        if later < n:  # segments that end here
            last = alphas[t][later:].sum(axis=1, keepdims=True)
            out["fit"] += np.log(last, dtype=np.float64).sum()
            beta = np.concatenate([beta, np.repeat(1 / last, k, axis=1)])
        alphas[t] = alphas[t] * beta
    out["step"] *= chain.step
    out["first"] += alphas[0][head].sum(axis=0)
    out["inside"] += alphas[0][~head].sum(axis=0)
    every = np.ascontiguousarray(np.concatenate(alphas).T)
    for s in range(k):
        out["emit"][:, s] = np.bincount(flat, weights=every[s], minlength=CLASSES)
    return out


def maximised(counts: dict[str, np.ndarray], share: np.ndarray, prior: float = 200.0) -> Chain:
    """The next parameters; emissions are smoothed towards the classes' shares."""
    scaled = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = counts["emit"] + prior * share[:, None]
    return Chain(scaled(counts["first"] + 1), scaled(counts["inside"] + 1), scaled(counts["step"] + 1), emit / emit.sum(axis=0))


def starting_chain(share: np.ndarray, states: int, seed: int) -> Chain:
    noise = np.random.default_rng(seed).gamma(2.0, 0.5, (CLASSES, states))
    emit = share[:, None] * noise
    even = np.full(states, 1 / states)
    return Chain(even, even, 0.8 * np.eye(states) + 0.2 / states, emit / emit.sum(axis=0))


def baum_welch_round(units: DataFrame, chain: Chain, share: np.ndarray) -> tuple[Chain, float]:
    """One round over every training text: expected counts by task, then their sums.

    Returns the next parameters and the log-likelihood under ``chain``."""
    k = len(chain.first)

    def run(batches):
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                got = expected_counts(*unit_sequences(row, True), chain)
                total = got if total is None else {c: total[c] + got[c] for c in got}
        if total is not None:
            stack = np.vstack([total["emit"], total["step"], total["first"][None], total["inside"][None], np.resize(total["fit"], (1, k))])
            stack = np.rint(stack * FRACTION).astype(np.int64)
            some = np.flatnonzero(stack.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(stack[some, s]) for s in range(k))], ["at", *(f"s{s}" for s in range(k))])

    kind = "at long, " + ", ".join(f"s{s} long" for s in range(k))
    sums = units.select("lengths", "held", "words", "tokens").mapInArrow(run, kind).groupBy("at").agg(*[F.sum(f"s{s}") for s in range(k)])
    stack = np.zeros((CLASSES + k + 3, k))
    at, *found = (c.to_numpy() for c in sums.toArrow().columns)  # a row a class at most
    stack[at] = np.column_stack(found)
    stack /= FRACTION
    return maximised({"emit": stack[:CLASSES], "step": stack[CLASSES:-3], "first": stack[-3], "inside": stack[-2]}, share), stack[-1, 0]


def train_chain(units: DataFrame, share: np.ndarray, n_words: float, states: int = STATES, tolerance: float = 1e-3, seed: int = 7) -> Chain:
    """Baum-Welch over the whole training part, until a round gains at most ``tolerance``
    nats of log-likelihood a word (ends count as words)."""
    chain, before = starting_chain(share, states, seed), -np.inf
    while True:
        chain, fit = baum_welch_round(units, chain, share)
        if fit - before <= tolerance * n_words:
            return chain
        before = fit


def log_likelihoods(seq: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """log10 of each sequence's probability: the scaled forward recursion, all in step."""
    order = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    mean = np.maximum(chain.emit.mean(axis=1), 1e-300)
    emit, log_mean = chain.emit / mean[:, None], np.log10(mean)
    total = np.zeros(len(lengths))
    a = np.tile(chain.first, (len(lengths), 1))
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left") if len(size) else []
    for t, n in enumerate(live):
        now = seq[start[:n] + t]
        a = (a[:n] if t == 0 else a[:n] @ chain.step) * emit[now]
        total[:n] += log_mean[now]
        done = live[t + 1] if t + 1 < len(live) else 0  # texts from here on end with this word
        if t % SCALED == SCALED - 1:
            done = 0
        if done < n:
            z = a[done:].sum(axis=1)
            a[done:] /= z[:, None]
            total[done:n] += np.log10(z)
    out = np.zeros(len(lengths))
    out[order] = total
    return out


def score_units(units: DataFrame, counted: DataFrame, chain: Chain, kinds: np.ndarray, number: np.ndarray, id_type: str) -> DataFrame:
    """One row a text: ids, counts and both scores."""
    n, v = float(number.sum()), float(kinds.sum())
    mass = np.log10(number + ADD * (kinds + 1))  # of a class: its words and one unseen
    below = np.log10(n + ADD * (v + 1))
    ends = float(number[END])

    def run(unit: pa.Table, found: pa.Table) -> pa.Table:
        row = unit.to_pylist()[0]
        classes = (expand(row["tokens"], np.uint64) & np.uint64(CLASSES - 1)).astype(np.int64)
        counts = np.zeros(len(classes))
        counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
        words = expand(row["words"], np.uint32)
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        sums = lambda x: np.bincount(text, weights=x[words], minlength=len(lengths))
        lift = np.log10(counts + ADD)
        tokens = lengths + 1
        base = sums(lift) + np.log10(ends + ADD) - tokens * below
        inside = sums(lift - mass[classes]) + (np.log10(ends + ADD) - mass[END])
        whole = inside + log_likelihoods(*unit_sequences(row, False), chain)
        known = sums((counts > 0).astype(np.float64)) + (ends > 0)
        ids = pa.ipc.open_stream(row["ids"]).read_all().column(0)
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        columns = [ids, pa.array(held), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(len(tokens), int(n))), pa.array(base), pa.array(whole)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = units.select("unit", "ids", "held", "lengths", "words", "tokens").groupBy("unit")
    return whole.cogroup(counted.groupBy("unit")).applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def hidden_markov_scores(docs: DataFrame, held_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """Scores of all texts by a model of those whose ``held_col`` is false."""
    units = stored(make_units(docs, id_col, text_col, held_col), "units")
    sent = sent_words(units)
    totals = stored(sent.groupBy("token").agg(F.sum("trained").alias("n")), "word-counts")
    counted = sent.join(totals, "token").select("unit", "at", "n")
    kinds, number = class_totals(totals)

    def trained_texts(batches):
        for batch in batches:
            n = sum(h.count(b"\x00") for h in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    texts = units.select("held").mapInArrow(trained_texts, "n long").agg(F.sum("n")).first()[0] or 0
    number[END], kinds[END] = texts, min(1, texts)
    share = (number + 0.5) / (number.sum() + 0.5 * CLASSES)
    chain = train_chain(units, share, float(number.sum()), **training)
    return score_units(units, counted, chain, kinds, number, dict(docs.dtypes)[id_col])


def op7_hidden_markov(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hidden_markov_scores(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 10) == 0).alias("held_out")))
