"""Best-fit packing into sequences by hierarchical residual packing.

Each task packs its own pieces best-fit and closes bins that are nearly full.
The others travel as items of the size they have: fewer tasks pack them again,
accept more slack each round, and so on up a tree. No task holds more than
``most_items`` items; where even that leaves several tasks and no round makes
them fewer, each closes what it has.

Defined cases: a null text is empty, and an empty one is its end token alone;
null and repeated ids are packed as they come; a very long text is encoded whole
and cut; pieces of one size are packed in the order in which they come; an empty table
gives an empty result; columns that are not named are not read, so clashing names do
not matter.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, table
from .hashing import RangeHash, mixed

#: Longer chunks are not kept: their texts go to the library whole.
MOST_BYTES = 64
#: A word of letters that the vocabulary's file takes for one piece.
PLAIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
BLANK, LETTER, SIGN, OTHER = 0, 1, 2, 3
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[[32, *range(9, 14)]] = BLANK
_KINDS[[c for c in range(128) if chr(c).isalnum()]] = LETTER
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = SIGN


def chunk_bounds(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks: cut at blanks, and where a letter meets an ASCII sign.

    The vocabulary's file cuts there too, whatever follows; an apostrophe, which can open
    a shortened word, and letters beyond U+00FF stay with what they touch.
    """
    kind = _KINDS[byte]
    lead = np.flatnonzero(byte[:-1] == 0xC3)  # U+00C0 to U+00FF, all letters but two
    lead = lead[(byte[lead + 1] != 0x97) & (byte[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    cut = kind[:-1] * kind[1:] == LETTER * SIGN
    full = kind != BLANK
    start = np.flatnonzero(full & np.append(True, cut | ~full[:-1]))
    end = np.flatnonzero(full & np.append(cut | ~full[1:], True)) + 1
    return start, end


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, with a table of chunks.

    A text's ids are those of its chunks, one after another. Chunks are found, hashed
    (twice 64 bits) and looked up for many texts at once; the library encodes each new
    chunk, and whole texts with a special token or a long chunk.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.most_words = Tokenizer.from_file(path), most_words
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for word, i in self.model.get_vocab().items() if word.endswith("</w>")]] = True
        self.letters = mixed(np.arange(256, dtype=np.uint64), 9)
        self.hashes = RangeHash(0x9E3779B97F4A7C15), RangeHash(0xD6E8FEB86659FD93)
        self._clear(most_words)

    def _clear(self, room: int) -> None:
        self.room, self.slot_bits = room, (2 * room - 1).bit_length()
        self.keys = np.zeros((2, 1 << self.slot_bits), np.uint64)
        self.entry = np.zeros(1 << self.slot_bits, np.int32)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ends = [0, *accumulate(4 * len(x) for x in ids)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
        return [flat[lo:hi] for lo, hi in pairwise(ends)]

    def _of_words(self, chunks: list[str], together: int = 64) -> list[bytes]:
        """Ids of each chunk. Plain words go to the library many in a text, which costs it a
        third; each is one piece, and a piece's last token is marked as a word's end."""
        plain = [k for k, c in enumerate(chunks) if PLAIN_WORD.fullmatch(c)]
        texts = [" ".join([chunks[k] for k in plain[lo : lo + together]]) for lo in range(0, len(plain), together)]
        flat = np.frombuffer(b"".join(self._library(texts)), "<u4")
        ends = [0, *(np.flatnonzero(self.ends[flat]) + 1).tolist()]
        if len(ends) != len(plain) + 1:
            plain, ends = [], [0]
        out: list[bytes | None] = [None] * len(chunks)
        data = flat.tobytes()
        for k, lo, hi in zip(plain, ends, ends[1:], strict=False):
            out[k] = data[4 * lo : 4 * hi]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._library([chunks[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashed chunks (2 x n); -1 where there is none."""
        out = np.full(h.shape[1], -1, np.int32)
        todo, slot = np.arange(h.shape[1]), (h[0] >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        while len(todo):
            here = self.keys[0][slot]
            same = (here == h[0][todo]) & (self.keys[1][slot] == h[1][todo])
            out[todo[same]] = self.entry[slot[same]]
            on = ~same & (here != 0)
            todo, slot = todo[on], (slot[on] + 1) % len(self.entry)
        return out

    def _learn(self, chunks: list[str], h: np.ndarray) -> None:
        ids = self._of_words(chunks)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        entry = len(self.start) + np.arange(len(ids), dtype=np.int32)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
        self.count, self.flat = np.append(self.count, count), np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
        slot = (h[0] >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        while len(slot):  # each free slot takes one of those that want it, the others go on
            free = np.flatnonzero(self.keys[0][slot] == 0)
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[:, slot[take]], self.entry[slot[take]] = h[:, take], entry[take]
            left = np.ones(len(slot), bool)
            left[take] = False
            slot, h, entry = (slot[left] + 1) % len(self.entry), h[:, left], entry[left]

    def _of_chunks(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entries of the chunks between these places; new ones are learned."""
        values = self.letters[np.frombuffer(data, np.uint8)]
        h = np.stack([x.of(values, start, end) for x in self.hashes])
        h[0] |= np.uint64(1)  # 0 marks a free slot
        found = self._find(h)
        while (new := np.flatnonzero(found < 0)).size:
            new = new[np.unique(h[0][new], return_index=True)[1]]
            if len(self.start) + len(new) > self.room:
                self._clear(max(self.most_words, 2 * len(np.unique(h[0]))))
                found[:] = -1
                continue
            self._learn([data[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)], h[:, new])
            found = self._find(h)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        # the library lower-cases the rest; a special token is found before that
        raw = [b"" if "<|" in t else t.encode().lower() for t in texts]
        data = b"\n".join(raw) + b"\n"
        byte = np.frombuffer(data, np.uint8)
        start, end = chunk_bounds(byte)
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
        whole = np.zeros(len(texts), bool)
        whole[text[end - start > MOST_BYTES]] = True
        if whole.any():
            here = ~whole[text]
            start, end, text = start[here], end[here], text[here]
        entry = self._of_chunks(data, start, end)
        count = self.count[entry]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[entry] - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.cumsum(np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)) if len(texts) else []
        flat, out = ids.tobytes(), []
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=False)):
            out.append(None if whole[k] or "<|" in texts[k] else flat[4 * lo : 4 * hi])
        rest = iter(self._library([t for t, x in zip(texts, out, strict=True) if x is None]))
        return [next(rest) if x is None else x for x in out]


_encoders: dict[str, WordIds] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32.

    ``vocabulary`` is the path of the tokenizer's file; without it each worker
    asks the installed package.
    """

    def run(batches):
        path = vocabulary or default_vocabulary()
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        encoder = _encoders[path]
        end = np.array([end_id], "<u4").tobytes()
        for batch in pieces_of(batches, size=1_000_000):
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[lo : lo + 4 * size]
                    at.append(row)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins stand in lists by what is left in them; the bits of one integer
    tell which lists have any, so the tightest bin is found in a step.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[list[int]] = [[] for _ in range(room + 1)]
    used: list[int] = []
    some = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = some >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            b = left[free].pop()
            if not left[free]:
                some &= ~(1 << free)
        else:
            free, b = room, len(used)
            used.append(0)
        bins[item], offsets[item] = b, used[b]
        used[b] += size
        left[free - size].append(b)
        some |= 1 << (free - size)
    return bins, offsets, np.array(used, np.int64)


ITEM = ["doc_id", "piece", "start", "length", "ids_crc32"]
NAMES = [*ITEM, "sequence_id", "offset", "used", "open"]


def _packed(rows: pa.Table, bins: np.ndarray, offsets: np.ndarray, used: np.ndarray, number: int, room: int, slack: int) -> pa.Table:
    columns = [rows.column(c) for c in ITEM]
    fill = used[bins] if len(used) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([*columns, pa.array(bins + number), pa.array(offsets), pa.array(fill), pa.array(fill < room - slack)], NAMES)


def _first_number(level: int) -> int:
    """Where a task's sequence numbers start: level, task, then 2**32 of its own."""
    task = TaskContext.get().partitionId()
    if task >= 1 << 25:
        raise ValueError(f"task {task}: sequence numbers reach to 2**25 tasks a round")
    return (level << 57) | (task << 32)


def pack_locally(pieces: DataFrame, room: int, slack: int, most_items: int) -> DataFrame:
    """Round 0: every task packs the pieces of its partition, ``most_items`` at a time."""

    def run(batches):
        number, waiting, count = _first_number(0), [], 0

        def pack():
            rows = pa.Table.from_batches(waiting)
            bins, offsets, used = best_fit(rows.column("length").to_numpy(), room)
            return _packed(rows, bins, offsets, used, number, room, slack), len(used)

        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= most_items:
                out, n = pack()
                yield from out.to_batches()
                number, waiting, count = number + n, [], 0
        if count:
            yield from pack()[0].to_batches()

    kind = dict(pieces.dtypes)["doc_id"]
    return pieces.select(*ITEM).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long, open boolean")


def pack_again(rows: DataFrame, tasks: int, level: int, room: int, slack: int) -> DataFrame:
    """Underfull bins, as items, are packed into bins of fewer tasks."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])  # whatever order they came in
        old = rows.column("sequence_id").to_numpy()
        _, first, item = np.unique(old, return_index=True, return_inverse=True)
        bins, offsets, used = best_fit(rows.column("used").to_numpy()[first], room)
        yield from _packed(rows, bins[item], offsets[item] + rows.column("offset").to_numpy(), used, _first_number(level), room, slack).to_batches()

    return rows.repartition(tasks, "sequence_id").mapInArrow(run, rows.schema)


def pack(pieces: DataFrame, room: int = 2048, slack: int = 4, widening: int = 8, fan_in: int = 8, most_items: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A bin is nearly full, and closed, within ``slack`` ids of ``room``; each round
    allows ``widening`` times the slack of the one before.
    """
    done = []
    now = stored(pack_locally(pieces, room, slack, most_items), "pack-0")
    level, tasks = 0, None
    while True:
        done.append(now.where(~F.col("open")))
        rest = now.where("open")
        # open bins, and the tasks they come from
        n, sources = rest.agg(F.count_if(F.col("offset") == 0), F.countDistinct(F.shiftright("sequence_id", 32))).first()
        if n == 0:
            break
        level, slack = level + 1, slack * widening
        fewer = max(-(-n // most_items), -(-(tasks or sources) // fan_in))
        last = fewer == 1 or (tasks is not None and fewer >= tasks)
        tasks = fewer
        now = stored(pack_again(rest, tasks, level, room, room if last else slack), f"pack-{level}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*ITEM, "sequence_id", "offset")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(stored(token_pieces(docs, **options), "pieces"), options.get("size", 2048))


def op6_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
