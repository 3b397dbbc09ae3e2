"""Substring dedup by hashing lines and the sentences and clauses in them.

Texts are cut at line ends and, inside lines, after a mark of ``.!?,;:`` before a blank,
so that a passage set into other prose is found too. Pieces are normalised and hashed;
equal digests are grouped over the whole corpus; of each group the occurrence of the
earliest rank (id, then place) stays and the others are removed, told by their offsets
in the original text.

Pieces of ``least_words`` words and more are units by themselves. Shorter ones join the
same grouping in three ways. In a run of them, from each piece the fewest pieces that have
``least_words`` words are hashed, forwards and backwards, so that a repeated passage of
short pieces is found from its first to its last. A run that has fewer words is hashed with
the long piece before it and again with the one after it, so that a repeated passage keeps
neither holes nor frayed ends. A text that has fewer words in all is one unit.
Digests are 128-bit hashes of a unit's normalised text itself.
Spans that overlap, or that only a blank within a line parts, are joined.

``repeats`` is the verdict on a document. Documents that share a stock line share units too,
and lose it (``n_removed``); ``repeats`` therefore asks for a run of repeated units of at least
``least_run`` words: a passage of over 50 words can lose, at either end, a clause that its
edge cuts.

Defined cases: a null text has no units; null ids rank first; rows equal in id
and text are one document, whose units share their rank and so stay or go
alike; ties between equal units go to the lower id, then place; very long texts are
handled whole, in memory proportional to the text; an empty table gives an empty result;
columns that are not named are not read, and ``remove_units`` keeps them as they are,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, table

UNIT = "start long, end long, first_word int, words int, link boolean, inline boolean, d1 long, d2 long"
STOPS = np.array([ord(c) for c in ".!?,;:"], np.uint32)
SPANS = "array<struct<start:bigint,end:bigint>>"

_lower: list[np.ndarray] = []


def lower_points(points: np.ndarray) -> np.ndarray:
    """Code points in lower case, one for one (others stay as they are)."""
    if not _lower:
        _lower.append(np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)], np.uint32))
    return _lower[0][points]


def digests(points: np.ndarray, blank: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes (two longs) of parts of a text that begin and end with a word: in lower
    case, with one blank for each run of white space."""
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    text = np.where(blank, np.uint32(32), lower_points(points))[keep].tobytes()
    upto = np.cumsum(keep) * 4
    spans = zip((upto[start] - 4).tolist(), upto[end - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)


def text_units(texts: list[str], least_words: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each unit its text's number, and the columns of UNIT; all texts at once."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in texts])
    text_end = np.cumsum(size)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    turn = np.flatnonzero(np.diff(blank, prepend=True))
    w_start, w_end = turn[::2], turn[1::2]

    # a piece ends at a line's end, or at a blank after the end of a sentence or clause
    stops = np.isin(points, STOPS)
    cut = np.flatnonzero((points == 10) | ((points == 32) & np.append(False, stops[:-1])))
    piece = np.searchsorted(cut, w_start)
    piece, first, n = np.unique(piece, return_index=True, return_counts=True)
    p_start, p_end = np.append(0, cut + 1)[piece], cut[piece]
    text = np.searchsorted(text_end, p_start, side="right")

    upto = np.cumsum(n)
    before, long = upto - n, n >= least_words
    longs = np.cumsum(long)
    short = np.flatnonzero(~long)
    alike = lambda i, j: (text[i] == text[j]) & (longs[i] == longs[j])
    i, j = short, np.searchsorted(upto, before[short] + least_words)
    here = j < len(n)
    i, j = i[here], j[here]
    x = alike(i, j)
    runs = [i[x] * len(n) + j[x]]
    i, j = np.searchsorted(before, upto[short] - least_words, side="right") - 1, short
    here = (i >= 0) & (upto[short] >= least_words)
    i, j = i[here], j[here]
    x = alike(i, j) & ~long[i]
    runs = np.stack(np.divmod(np.unique(np.concatenate([*runs, i[x] * len(n) + j[x]])), max(1, len(n))))
    whole = np.flatnonzero(long)
    # a short run beside a long piece: from the long piece before it (or the text's edge) to the next
    head, tail = np.searchsorted(text, text[whole]), np.searchsorted(text, text[whole], side="right")
    same = text[whole[1:]] == text[whole[:-1]]
    left, right = head.copy(), tail.copy()
    left[1:][same], right[:-1][same] = whole[:-1][same] + 1, whole[1:][same]
    words_of = lambda i, j: np.append(0, upto)[j] - np.append(0, upto)[i]  # noqa: E731  of the pieces from i up to j
    few = lambda x: (x > 0) & (x < least_words)
    x, y = few(words_of(left, whole)), few(words_of(whole + 1, right))
    links = np.concatenate([np.stack([left[x], whole[x]]), np.stack([whole[y], right[y] - 1])], axis=1)
    head, tail = (np.unique(text, return_index=True)[1], np.append(np.flatnonzero(np.diff(text)), len(text) - 1)) if len(text) else (whole, whole)
    tiny = few(words_of(head, tail + 1))
    i, j = np.concatenate([np.stack([whole, whole]), runs, np.stack([head[tiny], tail[tiny]]), links], axis=1)

    lo, hi = first[i], first[j] + n[j]
    text_start = text_end - size
    base, word_base = text_start[text[i]], np.searchsorted(w_start, text_start)[text[i]]
    d1, d2 = digests(points, blank, w_start[lo], w_end[hi - 1]).T
    link = np.repeat([False, True], [len(i) - links.shape[1], links.shape[1]])
    return text[i], {
        "start": p_start[i] - base, "end": p_end[j] - base, "first_word": (lo - word_base).astype(np.int32), "words": (hi - lo).astype(np.int32),
        "link": link, "inline": points[p_end[j]] != 10, "d1": d1, "d2": d2,
    }


def joined_spans(spans: list[tuple[int, int]], apart: set[int]) -> list[list[int]]:
    """Spans in order, with those joined that overlap or that one of the places ``apart`` parts."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and (start < out[-1][1] or (start == out[-1][1] + 1 and out[-1][1] in apart)):
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def longest_run(runs: list[tuple[int, int]]) -> int:
    """Words in the longest stretch that ``runs`` (first word, words) cover without a gap."""
    best = start = end = 0
    for lo, n in sorted(runs):
        if lo > end:
            start = lo
        end = max(end, lo + n) if lo <= end else lo + n
        best = max(best, end - start)
    return best


def unit_rows(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, same (a hash of the text), n_units, UNIT: a row a unit, and one a document
    that has n_units (links left out) instead of a unit."""
    names = [c.split()[0] for c in UNIT.split(", ")]
    kinds = {"start": pa.int64(), "end": pa.int64(), "first_word": pa.int32(), "words": pa.int32(), "link": pa.bool_(), "inline": pa.bool_(), "d1": pa.int64(), "d2": pa.int64()}

    def run(batches):
        for batch in pieces_of(batches, 2048, 1_000_000):
            texts = batch.column(2).to_pylist()
            at, found = text_units(texts, least_words)
            ids = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.nulls(len(at), pa.int32()), *(pa.array(found[c], kinds[c]) for c in names)], ["doc_id", "same", "n_units", *names])
            n = np.bincount(at[~found["link"]], minlength=len(texts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *(pa.nulls(len(texts), kinds[c]) for c in names)], ["doc_id", "same", "n_units", *names])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, same long, n_units int, {UNIT}")


def repeated_units(docs: DataFrame, least_words: int = 10, least_run: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_units, n_removed, removed_chars, removed (start:end,
    comma-joined), repeat_words, repeats.

    n_units counts long pieces, units within short runs and short texts; n_removed counts spans.
    repeat_words is the longest run of words in units that another document has as well,
    first occurrences included; ``repeats`` tells whether it has ``least_run`` words.

    The text is read once; only digests and places move. The earliest place of a
    digest is a minimum, summed up before the shuffle, so a very common line is
    no hot group; singles never meet their document again.
    """
    return _measured(docs, least_words, least_run, id_col, text_col).drop("same", "spans")


def _measured(docs: DataFrame, least_words: int, least_run: int, id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    rows = stored(unit_rows(docs, least_words, id_col, text_col), "units")
    unit = rows.where("d1 is not null")
    owner, place = F.struct("doc_id", "same"), F.struct("doc_id", "same", "start")
    first = unit.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(owner).alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = ~F.struct("first.doc_id", "first.same").eqNullSafe(F.col("last"))
    # stored, so that the join is one of two plain tables: Spark can send a small one to all
    # tasks, and splits the tasks of a very common unit where it can't
    first = stored(first.select("d1", "d2", "first", shared.alias("shared")), "repeats")
    met = unit.join(first, ["d1", "d2"]).withColumn("later", ~place.eqNullSafe(F.col("first"))).where("later or shared")
    met = met.groupBy("doc_id", "same").agg(F.collect_set(F.struct("start", "end", "first_word", "words", "inline", "later", "shared")).alias("met"))

    def measure(batches):
        for batch in batches:
            spans, runs = [], []
            for met_ in batch.column("met").to_pylist():
                gone = [(x["start"], x["end"]) for x in met_ if x["later"]]
                spans.append([{"start": a, "end": b} for a, b in joined_spans(gone, {x["end"] for x in met_ if x["inline"]})])
                runs.append(longest_run([(x["first_word"], x["words"]) for x in met_ if x["shared"]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(runs, pa.int64())], ["g_id", "g_same", "spans", "run"])

    gone = met.mapInArrow(measure, f"g_id {kind}, g_same long, spans {SPANS}, run long")
    own = rows.where("n_units is not null").groupBy("doc_id", "same").agg(F.first("n_units").cast("long").alias("n_units"), F.count("*").cast("int").alias("copies"))
    out = own.join(gone, own["same"].eqNullSafe(gone["g_same"]) & own["doc_id"].eqNullSafe(gone["g_id"]), "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))).withColumn("run", F.coalesce("run", F.lit(0).cast("long")))
    return out.select(
        "doc_id", "n_units", F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.col("run").alias("repeat_words"), (F.col("run") >= least_run).alias("repeats"), "same", "spans",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove_units(docs: DataFrame, least_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later occurrences of repeated units cut out of the texts.

    Null texts and documents without such units stay as they are; no row goes. Only spans
    are joined to the texts, by id and a hash of the text.
    """
    found = _measured(docs, least_words, 0, id_col, text_col).where("n_removed > 0").select("doc_id", "same", "spans").distinct()
    found = found.select(F.col("doc_id").alias("_cut_id"), F.col("same").alias("_cut_same"), F.col("spans").alias("_cut_spans"))
    same = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_cut_id"]) & (same == found["_cut_same"]), "left").drop(found["_cut_id"], found["_cut_same"])
    names = docs.columns
    place = names.index(text_col)

    def cut(batches):
        for batch in pieces_of(batches):
            texts = batch.column(place).to_pylist()
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(texts[k])]
                    texts[k] = "".join(texts[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))
