"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Exact rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and telephone numbers;
these base spans are always reported. Four looser generators propose overlapping candidates
of high recall: mail-like, telephone-like (no plus needed), number-like and dotted. What a
candidate looks like and what stands around it are small whole numbers; the checks that
decide the base kinds (the plus, the checksum, the parts' range) are not among them.

Boosted trees learn to tell candidates that a base span confirms from those that none
touches, on the counts of distinct feature rows of all documents but a fifth. On that fifth
each generator's threshold is calibrated: the least score from which on the share of
confirmed candidates reaches ``precision``. Candidates at or above it that touch no base span
are reported beside the base spans: well-formed data that a base rule misses. A generator
that never gets there adds nothing.

The trees are fitted on at most ``most_rows`` distinct feature rows (those with the smallest
hash); counts, calibration and the search itself cover all documents. Scores are sums of CASE
expressions in the document's row, so that nothing but counts is shuffled.

Defined cases: a null text is empty (and stays null when masked); null ids and repeated rows
are documents like others; extra columns go through, but one named ``personal_data`` is
replaced; spans of different kinds may overlap, of one kind none do; candidates of equal score
share their fate; very long texts cost time in step with their length and spans; an empty
table, and one without confirmed or unconfirmed candidates, adds no spans to the base ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, rank_of, record, remainder, running, stored, table
from .secrets import masked

# The patterns are those of the kinds with their possessive forms: they find the same spans,
# but keep no stack, and start at a run's first character alone (\G: where a match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
QUAD = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MAIL_LIKE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+"
PHONE_LIKE = r"\+?(?:[0-9]{1,3}[\x20.-]?)?\([0-9]{1,6}\)[\x20.-]?[0-9]{2,8}(?:[\x20.-][0-9]{2,8})?"

BASE = ("email", "ip", "card", "phone")
LOOSE = ("mail_like", "phone_like", "number_like", "address_like")
KINDS = BASE + LOOSE
FEATURES = ("generator", "length", "digits", "letters", "groups", "open", "dots", "hyphens", "blanks", "at", "first_digits", "before", "after", "cue")
#: Words before a candidate, by what they speak of; the first kind that occurs counts.
CUES = (r"mail|contact|write", r"phone|tel\b|mobile|call|fax", r"card|visa|account|iban|konto", r"version|token|key|hash|build|serial")
SCAN = "__personal_scan__"
SPAN = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spotted(text: Column, pattern: str, around: int = 24) -> Column:
    """All leftmost non-overlapping matches: start, end (code points), text, and up to
    ``around`` code points before and after, as far as the neighbouring matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column, g: Column) -> Column:
        steps = F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("bigint"))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        return let(ends, lambda e: F.transform(m, lambda x, i: record(start=F.get(e, i) - F.length(x), end=F.get(e, i), text=x, before=F.right(F.get(g, i), F.lit(around)), after=F.left(F.get(g, i + 1), F.lit(around)))))

    return F.when(text.rlike(pattern), let(found, lambda m: let(gaps, lambda g: placed(m, g)))).otherwise(F.array().cast(SPAN))


def count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def edge_class(c: Column) -> Column:
    """0 at the text's edge (or another match), 1 blank, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def described(x: Column, generator: int) -> Column:
    """The features of a candidate, in the order of FEATURES."""
    t = x["text"]
    before = ascii_lower(x["before"])
    cue = reduce(lambda rest, k: F.when(before.rlike(CUES[k]), k + 1).otherwise(rest), reversed(range(len(CUES))), F.lit(0))
    numbers = [
        F.lit(generator), F.least(F.length(t), F.lit(40)), count_of(t, "0123456789"), F.least(count_of(t, LETTERS), F.lit(20)), F.least(F.size(F.split(t, r"[\x20().-]+", -1)), F.lit(9)),
        count_of(t, "(["), count_of(t, "."), count_of(t, "-"), count_of(t, " "), count_of(t, "@"), F.length(F.regexp_extract(t, r"^\+?\(?([0-9]*)", 1)),
        edge_class(F.right(x["before"], F.lit(1))), edge_class(F.left(x["after"], F.lit(1))), cue,
    ]
    return F.array(*[F.least(n, F.lit(99)).cast("double") for n in numbers])


def touching(parts: Column, start: Column, end: Column, use) -> Column:
    """``use(part)`` of the first of ``parts`` (sorted, disjoint) that ends behind ``start``."""
    return let(F.get(parts, rank_of(parts, lambda p: p["end"], start)), lambda p: F.coalesce(use(p), F.lit(False)))


def scanned(docs: DataFrame, text_col: str = "text", out: str = SCAN) -> DataFrame:
    """``docs`` with a struct of base spans by kind, and ``loose``: candidates (start, end,
    generator, f) with ``label``: 1 confirmed, 0 untouched, null if a base span touches them
    otherwise (a leading plus apart)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    with_char = lambda c, pattern: F.when(text.contains(c), spotted(text, pattern)).otherwise(none)
    found = record(
        email=with_char("@", EMAIL),
        quad=with_char(".", QUAD),
        digits=spotted(text, DIGITS),
        phone=with_char("+", PHONE),
        mail_like=spotted(text, MAIL_LIKE),
        phone_like=with_char("(", PHONE_LIKE),
    )
    n_digits = lambda x: count_of(x["text"], "0123456789")

    def in_range(x: Column) -> Column:
        # more than three digits behind leading zeros are over 255, however many they are
        return F.forall(F.split(x["text"], r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))

    def is_card(x: Column) -> Column:
        return n_digits(x).between(13, 19) & F.call_function("luhn_check", F.translate(x["text"], " -", ""))

    def sorted_out(p: Column) -> Column:
        return record(
            email=p["email"], ip=F.filter(p["quad"], in_range), card=F.filter(p["digits"], is_card), phone=F.filter(p["phone"], lambda x: n_digits(x).between(9, 15)),
            mail_like=p["mail_like"], phone_like=F.filter(p["phone_like"], lambda x: n_digits(x).between(9, 15)), number_like=F.filter(p["digits"], lambda x: n_digits(x).between(7, 40)), address_like=p["quad"],
        )

    def labelled(p: Column) -> Column:
        places = {k: F.transform(p[k], lambda x: record(start=x["start"], end=x["end"])) for k in BASE}

        def candidate(x: Column, generator: int) -> Column:
            same = lambda b: (b["end"] == x["end"]) & b["start"].between(x["start"] - 1, x["start"])
            confirmed = reduce(or_, [touching(p[k], x["start"], x["end"], same) for k in BASE])
            touched = reduce(or_, [touching(p[k], x["start"], x["end"], lambda b: b["start"] < x["end"]) for k in BASE])
            return record(start=x["start"], end=x["end"], generator=F.lit(generator), f=described(x, generator), label=F.when(confirmed, 1).when(~touched, 0))

        of = lambda g: lambda x: candidate(x, g)
        loose = F.concat(*[F.transform(p[k], of(g)) for g, k in enumerate(LOOSE)])
        return record(**places, loose=loose)

    return docs.withColumn(out, let(let(found, sorted_out), labelled))


@dataclass
class Model:
    """Weighted trees, each a number or (feature, threshold, left, right), and the generators'
    thresholds; without a threshold a generator adds nothing."""

    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, f: Column) -> Column:
        """The probability of a feature array, to three places."""

        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            at, cut, left, right = tree
            return F.when(F.get(f, F.lit(at)) <= cut, value(left)).otherwise(value(right))

        margin = reduce(add, [F.lit(w) * value(t) for w, t in self.trees], F.lit(0.0))
        return F.round(1 / (1 + F.exp(-2 * margin)), 3)


def _walked(node) -> float | tuple:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _walked(node.leftChild()), _walked(node.rightChild())


def _boosted(rows: DataFrame, trees: int, depth: int) -> list[tuple]:
    """Trees fitted on feature rows (f, pos, neg)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    cases = rows.select("f", F.explode(F.array(record(label=F.lit(1.0), weight=F.col("pos").cast("double")), record(label=F.lit(0.0), weight=F.col("neg").cast("double")))).alias("x"))
    cases = cases.where("x.weight > 0").select(array_to_vector("f").alias("features"), "x.label", "x.weight")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=128, seed=7, weightCol="weight").fit(cases)
    return [(float(w), _walked(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _thresholds(counts: DataFrame, model: Model, precision: float) -> dict[int, float]:
    """By generator the least score from which on ``pos / (n + 2)`` reaches ``precision``."""
    by_score = counts.groupBy("generator", model.score(F.col("f")).alias("score")).agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    down = Window.partitionBy("generator").orderBy(F.desc("score"))
    reached = by_score.select("generator", "score", (F.sum("pos").over(down) / (F.sum("n").over(down) + 2) >= precision).alias("ok"))
    return {r["generator"]: r["least"] for r in reached.where("ok").groupBy("generator").agg(F.min("score").alias("least")).collect()}


def learn(docs: DataFrame, precision: float = 0.9, most_rows: int = 20_000, trees: int = 20, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trees and thresholds from the documents themselves; labels come from the base spans."""
    held = (remainder(F.col(id_col), 5) == 0).alias("held")
    seen = scanned(docs.select(id_col, text_col), text_col).select(held, F.explode(f"{SCAN}.loose").alias("c")).where("c.label is not null")
    counts = seen.groupBy("held", F.col("c.generator").alias("generator"), F.col("c.f").alias("f")).agg(F.count_if(F.col("c.label") == 1).alias("pos"), F.count_if(F.col("c.label") == 0).alias("neg"))
    counts = stored(counts, "candidates")
    fitted = stored(counts.where("not held").orderBy(F.xxhash64("f"), "f").limit(most_rows), "feature-rows")
    if len([1 for c in ("pos", "neg") if not fitted.where(F.col(c) > 0).isEmpty()]) < 2:
        return Model()
    model = Model(_boosted(fitted, trees, depth))
    model.thresholds = _thresholds(counts.where("held"), model, precision)
    return model


def find_personal_data(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``personal_data``: an array of spans (start, end) a kind of KINDS."""
    return _found(docs, model, text_col, "personal_data")


def _found(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    def chosen(p: Column) -> Column:
        base = {k: p[k] for k in BASE}

        def some(g: int) -> Column:
            if g not in model.thresholds:
                return F.array().cast("array<struct<start:bigint,end:bigint>>")
            good = F.filter(p["loose"], lambda c: (c["generator"] == g) & c["label"].eqNullSafe(F.lit(0)) & (model.score(c["f"]) >= model.thresholds[g]))
            return F.transform(good, lambda c: record(start=c["start"], end=c["end"]))

        return record(**base, **{k: some(g) for g, k in enumerate(LOOSE)})

    return scanned(docs, text_col, out).withColumn(out, let(F.col(out), chosen))


def span_text(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind and start, comma-joined."""
    one = lambda k: F.transform(found[k], lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[PRIVATE]") -> DataFrame:
    """``docs`` with every span reported replaced by ``mark``; overlapping spans get one."""
    found = _found(docs, model, text_col, SCAN)
    spans = F.sort_array(F.concat(*[F.col(SCAN)[k] for k in KINDS]))
    return found.withColumn(text_col, masked(F.col(text_col), spans, mark)).drop(SCAN)


def op13_boosted_candidates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("personal_data")
    return find_personal_data(docs, learn(docs)).select(
        "doc_id",
        *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(span_text(found, BASE), 256).alias("base_sha256"),
        span_text(found, KINDS).alias("spans"),
        *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in LOOSE],
    )
