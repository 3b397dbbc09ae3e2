"""Media columns: baseline JPEG in numpy.

Reading: markers are parsed, scans are Huffman-decoded, and the DC coefficients
of the luminance give a thumbnail with one sample an 8x8 block. All restart
intervals of a batch of images that share tables advance together, one symbol a
step, so that the work is in whole arrays.

Writing: a payload becomes a grey JPEG whose blocks hold nothing but a DC
coefficient. With a quantiser of 8 the thumbnail is the payload, byte for byte.

Defined cases: null media give null columns; what is no baseline JPEG gives
nulls and a reason in ``media_error``; null text is empty text; a text too long for
one image becomes several in one stored form; ids, repeated rows, ties and extra columns
go through untouched, but for columns with the name of an added one, which are replaced;
an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others as others_of
from .common import pieces_of, table

# The standard's example table for luminance DC (lengths, symbols),
# and an AC table whose only code, one bit, ends the block.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_LENGTHS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)

#: Blocks a row, and so payload bytes a restart interval; rows an image can have.
WIDTH, MOST_ROWS = 64, 8191


def huffman(lengths, symbols) -> list[tuple[int, int, int]]:
    """Canonical codes: (code, length, symbol)."""
    out, code, at = [], 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((code, n, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(lengths, symbols) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for code, n, symbol in huffman(lengths, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + symbol
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    frame = bytes((8,)) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes((1, 1, 0x11, 0))
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes((0,)) + bytes((8,)) * 64),
        _segment(0xC0, frame),
        _segment(0xC4, bytes((0x00, *DC_LENGTHS, *DC_SYMBOLS))),
        _segment(0xC4, bytes((0x10, *AC_LENGTHS, *AC_SYMBOLS))),
        _segment(0xDD, WIDTH.to_bytes(2, "big")),
        _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0))),
    ))


_CODE, _SIZE = np.zeros(12, np.int64), np.zeros(12, np.int64)
for _c, _n, _s in huffman(DC_LENGTHS, DC_SYMBOLS):
    _CODE[_s], _SIZE[_s] = _c, _n
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG (or several in a row, for very long ones) for each payload of 64 n bytes, n > 0."""
    images = [p[at : at + WIDTH * MOST_ROWS] for p in payloads for at in range(0, len(p), WIDTH * MOST_ROWS)]
    if not images:
        return []
    heights = np.array([len(x) // WIDTH for x in images])
    samples = np.frombuffer(b"".join(images), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    diff = np.diff(samples, axis=1, prepend=0)
    category = _CATEGORY[diff + 255]
    value = np.where(diff < 0, diff + (1 << category) - 1, diff)
    size = _SIZE[category] + category + 1
    code = ((_CODE[category] << category) | value) << 1  # the last bit, 0, ends the block
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.concatenate(([0], np.cumsum(n_bytes)))
    bit = (row_at[:-1, None] * 8 + ends - size).ravel()
    window = (code.ravel() << (24 - (bit & 7) - size.ravel())).astype(np.int64)
    place, total = bit >> 3, int(row_at[-1])
    packed = np.zeros(total + 3)
    for k in range(3):
        packed += np.bincount(place + k, weights=(window >> (16 - 8 * k)) & 255, minlength=total + 3)
    packed = packed[:total].astype(np.uint8)
    packed[row_at[1:] - 1] |= ((1 << (n_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    stuffed = packed == 255
    row = np.repeat(np.arange(len(n_bytes)), n_bytes)
    before = np.cumsum(stuffed)
    out = np.zeros(total + int(before[-1]) + 2 * len(n_bytes), np.uint8)
    out[np.arange(total) + before - stuffed + 2 * row] = packed
    row_end = row_at[1:] + before[row_at[1:] - 1] + 2 * np.arange(1, len(n_bytes) + 1)
    first = np.concatenate(([0], np.cumsum(heights)))
    mark = 0xD0 + (np.arange(len(n_bytes)) - np.repeat(first[:-1], heights)) % 8
    mark[first[1:] - 1] = 0xD9
    out[row_end - 2], out[row_end - 1] = 255, mark
    edges = np.concatenate(([0], row_end[first[1:] - 1]))
    made = iter([_header(int(h)) + out[a:b].tobytes() for h, a, b in zip(heights, edges[:-1], edges[1:], strict=True)])
    return [b"".join(next(made) for _ in range(0, len(p), WIDTH * MOST_ROWS)) for p in payloads]


@dataclass
class Image:
    """One parsed image: its luminance grid and its restart intervals."""

    width: int
    height: int
    layout: tuple = ()  # of one MCU: (component, table of DC, of AC, row, column) a block
    across: int = 0
    wide: int = 1
    tall: int = 1
    quantum: int = 1
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    thumb: np.ndarray | None = None


def parse(media: bytes) -> list[Image]:
    """The images of a stream; ValueError where it is no baseline JPEG."""
    at, out, frame, tables, quanta, interval = 0, [], None, {}, {}, 0
    while at < len(media):
        if media[at] != 0xFF or at + 1 >= len(media):
            raise ValueError("no marker where one is due")
        marker = media[at + 1]
        at += 1 if marker == 0xFF else 2
        if marker == 0xD8:
            frame, tables, quanta, interval = None, {}, {}, 0
        elif marker not in (0xFF, 0x01, 0xD9):
            n = int.from_bytes(media[at : at + 2], "big")
            body, at = media[at + 2 : at + n], at + n
            if n < 2 or len(body) != n - 2:
                raise ValueError("cut off segment")
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quanta[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    count = sum(body[1:17])
                    tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + count]))
                    body = body[17 + count :]
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1):
                frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])])
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDA:
                if not frame or not all(frame[:2]):
                    raise ValueError("no frame size")
                image, at = _scan(media, at, body, frame, tables, quanta, interval)
                if image:
                    out.append(image)
    if not out:
        raise ValueError("no luminance scan")
    return out


def _scan(media, at, body, frame, tables, quanta, interval) -> tuple[Image | None, int]:
    width, height, components = frame
    chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    parts = [c for c in components if c[0] in chosen]
    data = np.frombuffer(media, np.uint8, offset=at)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    ends = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(ends[0]) if len(ends) else len(data)
    if components[0] not in parts:
        return None, at + stop
    data, ff, after = data[:stop], ff[ff < stop], after[ff < stop]
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(stop, bool)
    keep[ff[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    kept = np.cumsum(keep)
    starts = np.concatenate(([0], kept[restarts])).astype(np.int64)
    alone = len(parts) == 1
    most_h, most_v = (max(c[k] for c in components) for k in (1, 2))
    layout = []
    for k, (name, h, v, _) in enumerate(parts):
        for y in range(1 if alone else v):
            for x in range(1 if alone else h):
                t = chosen[name]
                if t >> 4 not in tables or 16 + (t & 15) not in tables:
                    raise ValueError("missing Huffman table")
                layout.append((k, tables[t >> 4], tables[16 + (t & 15)], y, x))
    _, h, v, q = components[0]
    unit = (8, 8) if alone else (8 * most_h, 8 * most_v)
    across, down = -(-width // unit[0]), -(-height // unit[1])
    step = interval or across * down
    counts = np.minimum(step, across * down - step * np.arange(len(starts)))
    if len(starts) != -(-across * down // step):
        raise ValueError("restart intervals do not add up")
    return Image(width, height, tuple(layout), across, 1 if alone else h, 1 if alone else v, quanta.get(q, 1), data[keep], starts, counts), at + stop


def decode(images: list[Image]) -> None:
    """Fill in the thumbnails."""
    groups: dict[tuple, list[Image]] = {}
    for x in images:
        groups.setdefault(x.layout, []).append(x)
    for layout, group in groups.items():
        at = np.cumsum([0, *(len(x.data) for x in group)])
        data = np.concatenate([*(x.data for x in group), np.full(16, 255, np.uint8)])
        starts = np.concatenate([x.starts + a for x, a in zip(group, at[:-1], strict=True)])
        counts = np.concatenate([x.counts for x in group])
        values = _levels(data, starts, counts, layout)
        lane = 0
        for x in group:
            own = values[lane : lane + len(x.counts)]
            lane += len(x.counts)
            flat = np.concatenate([v[:n] for v, n in zip(own, x.counts, strict=True)]) if (x.counts != own.shape[1]).any() else own.reshape(-1, own.shape[2])
            down = len(flat) // x.across
            grid = flat.reshape(down, x.across, x.tall, x.wide).swapaxes(1, 2).reshape(down * x.tall, x.across * x.wide)
            grid = grid[: -(-x.height // 8), : -(-x.width // 8)]
            x.thumb = np.clip((grid * x.quantum + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _levels(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, layout: tuple) -> np.ndarray:
    """DC coefficients of the first component: intervals x MCUs x its blocks."""
    order = np.argsort(-counts, kind="stable")
    ordered = counts[order]
    lumen = sum(b[0] == 0 for b in layout)
    out = np.zeros((len(starts), int(ordered[0]) if len(ordered) else 0, lumen), np.int32)
    luts = {t: lookup(*t) for b in layout for t in b[1:3]}
    d = data.astype(np.int64)
    words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]  # the 32 bits from each byte on
    most = len(words) * 8 - 8
    place = starts[order] * 8
    before = np.zeros((max((b[0] for b in layout), default=0) + 1, len(starts)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        return (words[p >> 3] >> (16 - (p & 7))) & 0xFFFF

    def symbol(p: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = lut[peek(p)]
        if not found.all():
            raise ValueError("bad Huffman code")
        return found >> 8, found & 255

    for m in range(out.shape[1]):
        n = int(np.searchsorted(-ordered, -m, side="left"))  # intervals longer than m
        p, k = place[:n], 0
        for part, dc, ac, _, _ in layout:
            length, size = symbol(p, luts[dc])
            p = p + length
            bits = peek(p) >> (16 - size)
            p = p + size
            before[part, :n] += np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            if part == 0:
                out[order[:n], m, k] = before[0, :n]
                k += 1
            length, coded = symbol(p, luts[ac])
            p = p + length
            if coded.any():
                p = _skip(p, coded, luts[ac], symbol)
            if (p > most).any():
                raise ValueError("the scan ends early")
        place[:n] = p
    return out


def _skip(p: np.ndarray, coded: np.ndarray, lut: np.ndarray, symbol) -> np.ndarray:
    """Past the AC coefficients of a block, whose first symbol has been read."""
    filled, live = np.ones(len(p), np.int64), np.arange(len(p))
    while True:
        going = coded != 0
        live, coded = live[going], coded[going]
        p[live] += coded & 15
        filled[live] += (coded >> 4) + 1
        going = filled[live] < 64
        live = live[going]
        if not len(live):
            return p
        length, coded = symbol(p[live], lut)
        p[live] += length


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Mean hash and gradient hash of the thumbnail pooled to 8 x 9 samples."""

    def pooled(across: int) -> np.ndarray:
        rows, columns = (np.arange(k) * n // k for k, n in ((8, thumb.shape[0]), (across, thumb.shape[1])))
        total = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), columns, axis=1)
        area = np.maximum(np.diff(np.append(rows, thumb.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(columns, thumb.shape[1])), 1)
        return total / area

    square, wider = pooled(8), pooled(9)
    return (np.packbits(square > square.mean()).tobytes() + np.packbits(wider[:, 1:] > wider[:, :-1]).tobytes()).hex()


def describe(media: list[bytes | None]) -> list[dict]:
    """Width, height, number of images, thumbnail bytes and hash, or the error, of each."""
    parsed: list[list[Image] | str | None] = []
    for x in media:
        try:
            parsed.append(None if x is None else parse(x))
        except (ValueError, IndexError) as e:
            parsed.append(str(e) or "cut off")
    good = [p for p in parsed if isinstance(p, list)]
    try:
        decode([x for p in good for x in p])
    except (ValueError, IndexError):  # one bad scan spoils the batch: each on its own then
        for k, p in enumerate(parsed):
            if isinstance(p, list):
                try:
                    decode(p)
                except (ValueError, IndexError) as e:
                    parsed[k] = str(e) or "cut off"
    out = []
    for p in parsed:
        if not isinstance(p, list):
            out.append({"width": None, "height": None, "n_images": None, "thumbnail": None, "thumbnail_hash": None, "media_error": p})
            continue
        whole = p[0].thumb if len({x.thumb.shape[1] for x in p}) > 1 else np.concatenate([x.thumb for x in p])
        out.append({"width": p[0].width, "height": p[0].height, "n_images": len(p), "thumbnail": b"".join(x.thumb.tobytes() for x in p), "thumbnail_hash": thumbnail_hash(whole), "media_error": None})
    return out


def texts_to_jpeg(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, payload_bytes and media (the stored JPEG),
    which replace columns of these names."""
    others = others_of(docs, text_col, "n_bytes", "payload_bytes", "media")
    out = docs.select(*others, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("payload_bytes"), F.lit(b"").alias("media"))

    def run(batches):
        for batch in pieces_of(batches):
            texts = [(x or "").encode() for x in batch.column(text_col).to_pylist()]
            padded = [x + bytes(-len(x) % 64 if x else 64) for x in texts]
            columns = [batch.column(c) for c in others] + [pa.array(map(len, texts), pa.int64()), pa.array(map(len, padded), pa.int64()), pa.array(encode(padded), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_bytes", "payload_bytes", "media"])

    return docs.select(*others, text_col).mapInArrow(run, out.schema)


def read_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` with width, height, n_images, thumbnail, thumbnail_hash and media_error, which
    replace columns of these names."""
    kinds = {"width": (pa.int32(), "int"), "height": (pa.int32(), "int"), "n_images": (pa.int32(), "int"), "thumbnail": (pa.binary(), "binary"), "thumbnail_hash": (pa.string(), "string"), "media_error": (pa.string(), "string")}
    others = others_of(rows, *kinds)
    out = rows.select(*others, *[F.lit(None).cast(t).alias(c) for c, (_, t) in kinds.items()])

    def run(batches):
        for batch in pieces_of(batches):
            found = describe(batch.column(media_col).to_pylist())
            columns = [batch.column(c) for c in others] + [pa.array([x[c] for x in found], t) for c, (t, _) in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, [*others, *kinds])

    return rows.select(*others).mapInArrow(run, out.schema)


def op3_jpeg_payload(spark, sf_dir: str) -> DataFrame:
    stored = texts_to_jpeg(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = read_media(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "width", "height", "n_images", "thumbnail_hash").alias("feature"),
    )
