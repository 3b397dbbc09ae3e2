"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's signature has one minimum a hash function. Documents are posted
under coordinate-value pairs; two documents whose signatures agree in at least
``least_matches`` coordinates share a pair among the rarest
``coordinates - least_matches + 1`` of either (prefix), whatever fixed order
ranks them. Pairs that meet are counted over all coordinates and, above the
match threshold, confirmed on the full shingle sets.

Large lists are never paired out. Equal sets are one class. Each list is first
joined to its smallest member alone; lists whose members are by then in one
component are skipped, and in the others only members of different components
are compared: short lists pair by pair, long ones in blocks of bounded size
whose tasks return links, not pairs. In long lists signatures meet first, without
texts; only classes that agree in enough coordinates with another of their list
form families, whose texts then meet in blocks.

Defined cases: a null text or one without words is linked with nothing; a text
with fewer words than a shingle is one shingle; equal rows fall in one class; a
component of null ids alone has a null id and all its rows are kept; very long texts
are hashed whole; of equal sets the least id stands for all; an empty table gives an
empty result; columns that are not named are not read, and ``drop_near_duplicates``
keeps them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, table
from .components import components

COORDINATES, LEAST_MATCHES = 32, 15
#: Counters of the sketch that ranks coordinate-value pairs by how common they are.
SKETCH_BITS = 16
#: Lists up to this length are paired; longer ones go in blocks of this many documents.
SHORT_LIST, BLOCK = 32, 256
#: Signatures are small, so that their blocks are larger.
SIGNATURE_BLOCK = 512
#: Up to so many keys a broadcast filter spares the other texts a shuffle; it has 16 buckets a key.
MOST_SENT = 1 << 20

_rng = np.random.default_rng(10)
_SCALE = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | bytes | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles, A-Z lower-cased."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        whole = b" ".join(words)
        return np.array([xxhash.xxh64_intdigest(whole, 1)], np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out += hashed[k : len(words) - width + 1 + k] * _MIX[k % 8]
        out ^= out >> np.uint64(31)
        out *= _ODD
    return np.unique(out)


def packed(text: str) -> bytes:
    """The text as it travels: its length, then compressed bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each coordinate and its minimum.

    A minimum of n hashes varies in its low bits alone, so all of it is hashed: unrelated
    documents then share a coordinate-value pair with probability 2**-64 each, however
    long they are.
    """
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingle_set), 4096):
        low = np.minimum(low, (shingle_set[at : at + 4096, None] * _SCALE + _SHIFT).min(axis=0))
    low ^= _SHIFT
    for shift, odd in ((30, _ODD), (27, _MIX[0])):
        low = (low ^ (low >> np.uint64(shift))) * odd
    return (low ^ (low >> np.uint64(31))).view(np.int64)


def signed_documents(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, cls (a hash of the set; null if empty), sig."""

    def run(batches):
        for batch in pieces_of(batches):
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig = np.concatenate([signature(s) for s in sets]) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, COORDINATES), pa.int32()), pa.array(sig))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(cls, pa.binary()), lists], ["doc_id", "mark", "n_shingles", "cls", "sig"])

    kind = dict(docs.dtypes)[id_col]
    marked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), text_col)
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, cls binary, sig array<long>")


def _tokens(batch) -> np.ndarray:
    """Coordinate-value pairs of a batch's signatures: documents x coordinates."""
    return batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """How often pairs fall into each of 2**SKETCH_BITS counters: a fixed size, over all classes."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(_tokens(batch)).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in classes.select("sig").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def prefix_postings(classes: DataFrame, sketch: np.ndarray, least_matches: int) -> DataFrame:
    """token, cls, n_shingles: each class under its rarest coordinate-value pairs.

    The sketch only ranks the pairs; any ranking loses nothing.
    """
    length = COORDINATES - least_matches + 1
    rank = np.unique(sketch, return_inverse=True)[1].astype(np.int64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = _tokens(batch)
                order = np.lexsort((tokens, rank[_bucket(tokens)]), axis=1)[:, :length]
                best = np.take_along_axis(tokens, order, axis=1)
                who = pa.array(np.repeat(np.arange(batch.num_rows), length))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), batch.column("cls").take(who), batch.column("n_shingles").take(who)], ["token", "cls", "n_shingles"])

    return classes.select("cls", "n_shingles", "sig").mapInArrow(run, "token long, cls binary, n_shingles long")


def _short_signatures(classes: DataFrame) -> DataFrame:
    """cls, sig of 16 bits a coordinate: a quarter of the bytes, and what agrees still does.

    Other values agree once in 2**16, which adds a candidate at most.
    """
    return classes.select("cls", F.transform("sig", lambda x: F.shiftright(x, 48).cast("smallint")).alias("sig"))


def enough_matches(pairs: DataFrame, classes: DataFrame, least_matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    sig = _short_signatures(classes)
    both = pairs.join(sig.withColumnsRenamed({"cls": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"cls": "b", "sig": "sb"}), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.where(same >= least_matches).select("a", "b")


def _near(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are near; a text travels once a pair, as ``b``."""

    def run(batches):
        last, own = None, None
        for batch in pieces_of(batches):
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:
                    last, own = a, shingles(unpacked(ta), width)
                other = shingles(unpacked(tb), width)
                common = len(own) + len(other) - len(np.union1d(own, other))
                keep.append(bool(_near(common, len(own), len(other), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    with_b = pairs.join(texts.withColumnsRenamed({"cls": "b", "text": "tb"}), "b")
    return with_b.join(texts.withColumnsRenamed({"cls": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _block_pairs(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of a key, dealt into its ``blocks``, once for each pair (i, j) of blocks."""
    block = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    cut = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select(key, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", *columns)


def list_candidates(long: DataFrame, classes: DataFrame, percent: int, least_matches: int) -> DataFrame:
    """Candidates (a, b) in long lists (token, cls, root, n_shingles, n): members of different
    roots and like sizes whose signatures agree in enough coordinates, as a spanning set of
    each pair of blocks. Whatever candidates there are, their ends are connected by these.
    """
    rows = long.withColumn("blocks", F.ceil(F.col("n") / SIGNATURE_BLOCK).cast("int")).join(_short_signatures(classes), "cls")
    cut = _block_pairs(rows, "token", "cls", "root", "n_shingles", "sig")

    def run(group: pa.Table) -> pa.Table:
        a, b = _candidates_of(group, percent, least_matches)
        cls = group.column("cls")
        return pa.table({"a": cls.take(pa.array(a, pa.int64())), "b": cls.take(pa.array(b, pa.int64()))})

    return cut.groupBy("token", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def _candidates_of(group: pa.Table, percent: int, least_matches: int) -> tuple[list, list]:
    """Places of a spanning set of the candidates in one pair of blocks."""
    out: tuple[list, list] = ([], [])
    root = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)[1]
    sig = group.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
    size, block = group.column("n_shingles").to_numpy(), group.column("block").to_numpy()
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    same = np.zeros((len(left), len(right)), np.int8)
    for k in range(COORDINATES):
        same += sig[left, k][:, None] == sig[right, k][None, :]
    n, m = size[left][:, None], size[right][None, :]
    fit = (same >= least_matches) & (root[left][:, None] != root[right][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    label = np.arange(len(size))
    for p, some in zip(left, fit, strict=True):
        if some.any():
            near = right[some]
            for x, at in zip(*np.unique(label[near], return_index=True), strict=True):
                if x != label[p]:
                    out[0].append(p)
                    out[1].append(near[at])
                    label[label == x] = label[p]
    return out


def block_links(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between members (family, cls, root) of one family but different roots.

    A family is cut into blocks of about BLOCK; every pair of blocks is a task's
    group, in which intersections come from products of membership matrices.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = _block_pairs(members.join(sizes, "family").join(texts, "cls"), "family", "cls", "root", "text")

    def run(group: pa.Table) -> pa.Table:
        a, b = _links_of(group, percent, width)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return cut.groupBy("family", "i", "j").applyInArrow(run, "a binary, b binary")


def _links_of(group: pa.Table, percent: int, width: int) -> tuple[list, list]:
    """A spanning set of the links in one pair of blocks."""
    cls, roots, block = (group.column(c).to_pylist() for c in ("cls", "root", "block"))
    above: dict = {}

    def find(x):
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    out: tuple[list, list] = ([], [])
    if len(set(roots)) < 2:
        return out
    sets = [shingles(unpacked(t), width) for t in group.column("text").to_pylist()]
    size = np.array([len(s) for s in sets])
    block = np.array(block)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    place = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[shared]]
    place = place[shared]
    order = np.argsort(column, kind="stable")
    column, place = column[order], place[order]
    common = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        here = slice(*np.searchsorted(column, (lo, lo + 4096)))
        m = np.zeros((len(sets), 4096), np.float32)
        m[place[here], column[here] - lo] = 1
        common += m[left] @ m[right].T
    near = _near(common, size[left][:, None], size[right][None, :], percent)
    for x, y in np.argwhere(near):
        p, q = left[x], right[y]
        rp, rq = find(roots[p]), find(roots[q])
        if rp != rq:
            above[rp] = rq
            out[0].append(cls[p])
            out[1].append(cls[q])
    return out


def _maybe_in(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose key may be in ``wanted``: a broadcast set of bucket numbers, built
    without a shuffle of ``rows``, keeps most others out of the join to come.

    With more than MOST_SENT keys nothing is broadcast and all ``rows`` go on to that join.
    """
    n = wanted.count()
    if n > MOST_SENT:
        return rows
    bucket = F.pmod(F.xxhash64(*key), F.lit(max(1024, 16 * n))).cast("int")
    some = wanted.select(bucket.alias("bucket")).distinct()
    return rows.withColumn("bucket", bucket).join(F.broadcast(some), "bucket", "left_semi").drop("bucket")


def class_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, text (packed) for the classes wanted (cls, doc_id, mark); repeated rows repeat it."""

    def run(batches):
        for batch in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(packed, batch.column(2).to_pylist()), pa.binary())], ["doc_id", "mark", "text"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    d = _maybe_in(d, wanted, "doc_id", "mark").select("doc_id", "mark", "text")
    d = d.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, mark long, text binary")
    w = wanted.withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"})
    return d.join(w, (d["mark"] == w["w_mark"]) & d["doc_id"].eqNullSafe(w["w_id"])).select("cls", "text")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, least_matches: int = LEAST_MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, mark (a hash of the text).

    Documents are linked if 100 * common shingles >= ``percent`` * all of both.
    ``least_matches`` of COORDINATES suits a percent of 80 and more: a pair at 80 is
    missed with probability 7e-6, one at 85 with 5e-8 (binomial tails).
    """
    signed = stored(signed_documents(docs, id_col, text_col, width), "signed")
    first = F.min(F.struct("doc_id", "mark"))
    classes = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(first.alias("first"), F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    classes = stored(classes.select("cls", "first.doc_id", "first.mark", "least_id", "n_shingles", "sig"), "classes")
    # sets of too different a size can't be near, so such pairs go before anything else is read
    alike = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """Only classes of pairs that passed the count of matches, or of long lists, need a text."""
        keys = stored(wanted.distinct().join(classes.select("cls", "doc_id", "mark"), "cls"), f"{name}-keys")
        return stored(class_texts(docs, keys, id_col, text_col), name)

    ends = lambda pairs: pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    postings = prefix_postings(classes, frequency_sketch(classes), least_matches)
    lists = postings.groupBy("token").agg(F.min(F.struct("cls", "n_shingles")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    live = stored(postings.join(lists.select("token", F.col("hub.cls").alias("hub"), F.col("hub.n_shingles").alias("hub_n"), "n"), "token"), "postings")

    star = live.where("cls != hub").where(alike(F.col("n_shingles"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    star = stored(enough_matches(star, classes, least_matches), "star")
    links = stored(confirmed(star, texts_of(ends(star), "star-texts"), percent, width), "links")
    roots = components(links, "first")

    placed = live.where("n > 2").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = stored(placed.drop("hub_n"), "placed")
    split = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    open_ = stored(placed.join(split, "token"), "open")

    short = open_.where(F.col("n") <= SHORT_LIST)
    x, y = (short.select("token", F.col("cls").alias(c), F.col("root").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("hub").alias(f"h{c}")) for c in ("a", "b"))
    pairs = x.join(y, "token").where("a < b and ra != rb and a != ha").where(alike(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    pairs = stored(enough_matches(pairs, classes, least_matches), "pairs")

    long = open_.where(F.col("n") > SHORT_LIST)
    families = components(list_candidates(long, classes, percent, least_matches), "families").withColumnsRenamed({"node": "cls", "root": "family"})
    members = stored(long.select("cls", "root").distinct().join(families, "cls"), "members")

    texts = texts_of(ends(pairs).unionByName(members.select("cls")), "other-texts")
    more = stored(confirmed(pairs, texts, percent, width).unionByName(block_links(members, texts, percent, width)), "more-links")

    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "second")
    grouped = classes.select("cls", "least_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    grouped = stored(grouped, "grouped")
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "root").select("cls", "component_id")
    out = signed.select("doc_id", "mark", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "mark")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (id) of each component; rows without an id stay.

    Rows go by id and text, so an id that has two texts may keep one and lose the other.
    """
    found = near_duplicates(docs, percent, width, id_col=id_col, text_col=text_col)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    return docs.join(gone, (docs[id_col] == gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_mark"]), "left_anti")


def op10_minhash_postings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3).drop("mark")
