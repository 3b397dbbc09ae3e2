"""Fill-in-the-middle, zone-map clusters and personal data against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papergraph.llm import fill_in_middle, personal_data, zone_clusters

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
AWKWARD = [None, "", " ", " \n\t\r\x0b\x0c", "one", " one", "one ", "a b  c\nd ", "é ß 漢字 😀 text here", "with <P> mark", "<S>", "<M> x", "ends <", "P> S> M> < <P", "\x00 nul \x00"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    d = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle_equals_a_walk_and_is_restored(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice(["a", "bé", " ", "\n", "<", "P>", "😀"]) for _ in range(rng.randrange(60))) for _ in range(150)] + ["word " * 60_000, "x" * 200_000]
    rows = [(None if i in (3, 4) else i, t, "kept", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, other string, FIM_FORM string").repartition(5)
    got = fill_in_middle.fill_in_middle(docs).withColumn("back", fill_in_middle.restored(F.col("fim_form"), F.col("fim_text"))).collect()
    assert len(got) == len(rows) + 20
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, [r[0] for r in rows + rows[:20]]))
    for r in got:
        assert (r["n_units"], r["fim_form"], r["fim_text"], r["prefix_chars"], r["middle_chars"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["other"] == "kept"
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    empty = fill_in_middle.fill_in_middle(docs.limit(0))
    assert empty.count() == 0 and empty.columns[-5:] == list(fill_in_middle.ADDED)


def test_hilbert_keys_step_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = zone_clusters.hilbert_keys(cells, bits)
        assert len(set(keys.tolist())) == len(cells)
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_box_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    pruned = 0
    for _ in range(100):
        centroids = rng.integers(-50, 50, (9, 4))
        points = rng.integers(-5, 5, (30, 4)) + rng.integers(-40, 40, 4)
        lo, hi = points.min(0), points.max(0)
        apart = ((points[:, None] - centroids) ** 2).sum(2)
        some = zone_clusters.candidates(lo, hi, centroids)
        pruned += 9 - len(some)
        assert set(apart.argmin(1)) <= set(some.tolist())
        number, distance = zone_clusters.nearest(points, lo, hi, centroids)
        assert (number == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert pruned > 300


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    points = [[max(-zone_clusters.LIMIT, min(zone_clusters.LIMIT, math.floor(1024 * x))) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (sha(f"3:{'' if kept[j][0] is None else kept[j][0]}"), kept[j][1]))
    centroids = [points[j] for j in order[:k]]
    apart = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    assign = lambda: [min((apart(p, c), n) for n, c in enumerate(centroids)) for p in points]
    for _ in range(rounds):
        mine = {}
        for p, (_, n) in zip(points, assign(), strict=True):
            mine.setdefault(n, []).append(p)
        for n, some in mine.items():
            centroids[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    found = assign()
    inertia = {n: sum(d for d, m in found if m == n) for n in range(len(centroids))}
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, centroids[n])))) for (i, _), (d, n) in zip(kept, found, strict=True))


@pytest.mark.parametrize("dims", [1, 64])
def test_clusters_equal_plain_rounds(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.normal(i % 3, 0.4, dims)).tolist()) for i in range(240)]
    rows += [(1000 + i, [0.25] * dims) for i in range(100)] + [(7, [0.25] * dims)] * 20 + [(None, [0.5] * dims)] * 2
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dims + 1)), (2003, [math.nan] * dims), (2004, [math.inf] + [0.0] * (dims - 1)), (2005, [None] * dims), (2006, [1e30] * dims)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(6)
    got = zone_clusters.cluster(df, k=8, rounds=10, dims=dims, block=16).collect()
    want = plain_clusters(rows, 8, 10, dims)
    short = [r for r in want if r[0] != "2006"]  # sums that hold the huge vector are over a long at most
    assert sorted((str(r[0]), *r[1:]) for r in got if r[0] != 2006) == [(*r[:3], min(r[3], 2**63 - 1), min(r[4], 2**63 - 1), r[5]) for r in short]


def test_clusters_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.1, 0.2])], "vec_id int, embedding array<float>")
    got = zone_clusters.cluster(few, dims=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(1, 0), (2, 0)] and len({r["cluster"] for r in got}) == 2
    assert zone_clusters.cluster(few.limit(0), dims=2).collect() == []
    assert zone_clusters.cluster(few, dims=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def luhn(digits):
    x = [int(c) for c in digits][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(x)) % 10 == 0


def plain_base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m)] for k, p, ok in rules]


def cards(rng):
    """A number of 16 digits that passes the checksum."""
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_personal_base_spans_equal_the_rules(spark):
    rng = random.Random(5)
    parts = ["a.b@c.de", "@x.y", "a@b", "a@b.c_d@e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.0255.1", "1..2.3", cards(rng), "4111 1111-1111 1111", "4111  1111", "+1 (407) 555-7710", "+1((((", "+49 170 1234567.", "++12345678901", "é", "😀", " ", "\n", "-", ".", "12", "x9", "(555) 123-4567", "me (at) home.org", "0000000000000", "+12 3"]
    texts = [None, "", *["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(12))) for _ in range(300)]]
    long = {"1" * 300_000: "", "1 " * 150_000 + "a@b.c": "email:300000:300005", "a.b" * 100_000: "", "x@" + "a.b." * 50_000: "email:0:200001", "+1" + "(" * 100_000: "", "0" * 300_000 + ".1.2.3": "ip:0:300006"}
    long |= {"1." * 80_000: ",".join(f"ip:{k}:{k + 7}" for k in range(0, 160_000, 8)), "a@b.cc " * 20_000: ",".join(f"email:{k}:{k + 6}" for k in range(0, 140_000, 7)), "+1(": ""}
    texts += long
    rows = [(None if i == 5 else i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string, personal_data string").repartition(6)
    found = F.col("personal_data")
    got = personal_data.find_personal_data(docs, personal_data.Model()).select("text", personal_data.span_text(found, personal_data.BASE).alias("base"), personal_data.span_text(found, personal_data.KINDS).alias("all")).collect()
    assert len(got) == len(rows) + 7
    for r in got:
        want = long[r["text"]] if r["text"] in long else ",".join(sum(plain_base(r["text"]), []))
        assert r["base"] == want == r["all"]
    masked = {r[0]: r[1] for r in personal_data.redact(docs, personal_data.Model()).select("text", "doc_id").collect()}
    assert None in masked and len(masked) > 250


@pytest.fixture(scope="module")
def private_docs(spark):
    rng = random.Random(9)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(1000):
        prose = "some quiet words about nothing much".split()
        put = [f"+1 ({number(3)}) 555-{number(4)}", f"a{i}@mail.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), cards(rng) if i % 2 else number(16), number(9)][i % 5]
        prose.insert(rng.randrange(1, 6), put)
        texts.append(" ".join(prose))
    texts += ["please call (407) 555-7710 today", "300.1.2.3 is no address but looks like one", "order 1234567890123456 is no card", None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def private_model(private_docs):
    return personal_data.learn(private_docs, trees=6)


def test_trees_add_what_looks_confirmed_and_no_more(spark, private_docs, private_model):
    model = private_model
    assert len(model.trees) == 6 and personal_data.LOOSE.index("number_like") not in model.thresholds
    found = F.col("personal_data")
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(private_docs, model).select("doc_id", "text", personal_data.span_text(found, personal_data.BASE).alias("base"), personal_data.span_text(found, personal_data.KINDS).alias("all")).collect()}
    assert got[1000]["all"] == "phone_like:12:26" and got[1002]["all"] == "" == got[1003]["all"]
    assert all(r["all"].startswith(r["base"]) for r in got.values())
    assert all(r["all"] == r["base"] for i, r in got.items() if i < 1000)
    masked = {r[0]: r[1] for r in personal_data.redact(private_docs, model).collect()}
    assert masked[1000] == "please call [PRIVATE] today" and masked[1003] is None and masked[1004] == ""


def test_scores_equal_the_trees_walked_by_hand(spark, private_docs, private_model):
    model = private_model

    def value(tree, f):
        while not isinstance(tree, float):
            at, cut, left, right = tree
            tree = left if f[at] <= cut else right
        return tree

    rows = personal_data.scanned(private_docs).select(F.explode(f"{personal_data.SCAN}.loose").alias("c")).select("c.f", model.score(F.col("c.f")).alias("score")).collect()
    assert len(rows) > 300
    for r in rows:
        want = 1 / (1 + math.exp(-2 * sum(w * value(t, r["f"]) for w, t in model.trees)))
        assert abs(r["score"] - want) < 6e-4 and len(r["f"]) == len(personal_data.FEATURES)


def test_nothing_to_learn_adds_nothing(spark):
    for texts in ([None, "", *["1234567890"] * 9],):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        model = personal_data.learn(docs)
        assert model == personal_data.Model()
        assert personal_data.find_personal_data(docs, model).count() == len(texts)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.learn(empty) == personal_data.Model() and personal_data.redact(empty, personal_data.Model()).collect() == []
