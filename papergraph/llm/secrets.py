"""Secret scans with multipart credential linking.

Certain spans (assignments, access identifiers, long hex) are reported as they
are. Weak candidates - account names, token-like strings of any length from 20, short assigned values,
endpoints - are reported only if a complementary part lies in their interval: at
most ``reach`` code points away and in the same scope (a block without blank
line). The interval join runs inside a document's row over sorted arrays, by
binary search, so nothing is shuffled and no pairs are listed.

Defined cases: a null text is empty (and stays null when masked); null ids, repeated rows
and extra columns go through untouched, but for a column named ``secret_scan``, which
``scan_secrets`` replaces; of spans that start together the kinds' order decides; very long texts
cost time in step with their length and spans; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rank_of, record, running, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The least lengths are part of the pattern where that finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAME = r"""(?i)(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?"""
SCOPE_END = r"\n[\x20\x09\r]*\n"

#: Order of the kinds among spans that start together.
KINDS = ("assign", "access", "hex", "name", "opaque", "short", "endpoint")
#: ``redact``'s own column, which no table has.
SCAN = "__secret_scan__"
EMPTY = "array<struct<start:bigint,end:bigint,text:string,part:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: start, end (code points), text, part (``group``)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = let(gaps, lambda g: F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("bigint")))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        return let(ends, lambda e: let(parts, lambda p: F.transform(m, lambda x, i: record(start=F.get(e, i) - F.length(x), end=F.get(e, i), text=x, part=F.get(p, i)))))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(EMPTY))


def near(parts: Column, lo: Column, hi: Column) -> Column:
    """Whether one of ``parts`` (sorted, disjoint) shares a place with [lo, hi)."""
    return let(F.get(parts, rank_of(parts, lambda x: x["end"], lo)), lambda x: F.coalesce(x["start"] < hi, F.lit(False)))


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """``docs`` with a column ``secret_scan``: one array of spans a kind.

    Weak kinds are already reduced to those that a complementary part supports.
    """
    return _scanned(docs, "secret_scan", text_col, reach)


def _scanned(docs: DataFrame, out: str, text_col: str, reach: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {
        "assign_all": matches(text, ASSIGN, 2),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
        "name": matches(text, NAME),
        "opaque": F.filter(matches(text, OPAQUE), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[a-z]") & x["text"].rlike("[A-Z]")),
        "endpoint": matches(text, ENDPOINT),
    }

    def split(p: Column) -> Column:
        """Assignments by the length of their value; bound once, since every weak candidate looks at them."""
        short = lambda x: F.length(x["part"]) < 6
        rest = {k: p[k] for k in found if k != "assign_all"}
        return record(assign=F.filter(p["assign_all"], lambda x: ~short(x)), short=F.filter(p["assign_all"], short), **rest)

    def linked(p: Column) -> Column:
        assign, short = p["assign"], p["short"]
        sure = [assign, p["access"], p["hex"]]
        names, secrets, places = [p["access"], p["name"]], [assign, p["hex"], p["opaque"], short], [p["endpoint"]]
        complement = {"name": (p["name"], secrets), "opaque": (p["opaque"], names + places), "short": (short, names + places), "endpoint": (p["endpoint"], secrets)}

        def supported(kind: str, scopes: Column) -> Column:
            weak, others = complement[kind]

            def holds(w: Column) -> Column:
                block = rank_of(scopes, lambda x: x["end"], w["start"])
                lo = F.greatest(w["start"] - reach, F.coalesce(F.get(scopes, block - 1)["end"], F.lit(0)))
                hi = F.least(w["end"] + reach, F.coalesce(F.get(scopes, block)["start"], F.lit(2**62)))
                free = ~reduce(or_, [near(s, w["start"], w["end"]) for s in sure])
                return free & reduce(or_, [near(o, lo, hi) for o in others])

            return F.filter(weak, holds)

        none = F.array().cast(EMPTY)
        weak_there = (F.size(p["name"]) + F.size(p["opaque"]) + F.size(short) + F.size(p["endpoint"])) > 0
        scopes = matches(text, SCOPE_END)
        weak = F.when(weak_there, let(scopes, lambda s: record(**{k: supported(k, s) for k in complement}))).otherwise(record(**dict.fromkeys(complement, none)))
        return let(weak, lambda w: record(assign=assign, access=p["access"], hex=p["hex"], name=w["name"], opaque=w["opaque"], short=w["short"], endpoint=w["endpoint"]))

    return docs.withColumn(out, let(let(record(**found), split), linked))


def span_list(scan: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of these kinds, sorted by start and then kind: structs start, k, end."""

    def marked(kind: str) -> Column:
        return F.transform(scan[kind], lambda x: record(start=x["start"], k=F.lit(KINDS.index(kind)), end=x["end"]))

    return F.sort_array(F.concat(*map(marked, kinds)))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def slices(text: Column, block: int = 4096):
    """A function (start, end) to that part of ``text``, by code points.

    A substring is found from the text's start on, so many of them cost the text's length
    each; here the text is cut into blocks once and a part costs what it takes from them.
    """
    of = lambda blocks, i: F.coalesce(F.get(blocks, i), F.lit(""))

    def part(blocks: Column, start: Column, end: Column) -> Column:
        i, j = (F.floor(x / block).cast("int") for x in (start, end))
        at = (start % block).cast("int") + 1
        across = F.concat(of(blocks, i).substr(at, F.lit(block)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), of(blocks, j).substr(F.lit(1), (end % block).cast("int")))
        return F.when(i == j, of(blocks, i).substr(at, (end - start).cast("int"))).otherwise(across)

    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), part


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each of ``spans`` (sorted, start and end) replaced by ``mark``; those that
    overlap get one."""
    whole, part = slices(text)

    def rebuilt(s: Column) -> Column:
        upto = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))

        def pieces(m: Column, blocks: Column) -> Column:
            before = lambda i: F.coalesce(F.get(m, i - 1), F.lit(0).cast("long"))
            kept = F.transform(s, lambda x, i: F.when((i > 0) & (x["start"] < before(i)), "").otherwise(F.concat(part(blocks, before(i), x["start"]), F.lit(mark))))
            return F.concat(F.array_join(kept, ""), part(blocks, F.element_at(m, -1), F.length(text).cast("long")))

        return let(upto, lambda m: let(whole, lambda blocks: pieces(m, blocks)))

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(rebuilt(s)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans get one."""
    scanned = _scanned(docs, SCAN, text_col, reach)
    return scanned.withColumn(text_col, masked(F.col(text_col), span_list(F.col(SCAN), KINDS), mark)).drop(SCAN)


def op2_linked_secrets(spark, sf_dir: str) -> DataFrame:
    scan = F.col("secret_scan")
    base = span_text(span_list(scan, KINDS[:3]))
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[F.size(scan[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        span_text(span_list(scan, KINDS)).alias("spans"),
    )
