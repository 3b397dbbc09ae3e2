"""Long lists of near_dedup: texts travel only for classes whose signatures agree."""

import numpy as np
import pyarrow as pa

from papergraph.llm import near_dedup


def _texts():
    """60 short texts that share one stock phrase and no more, and 40 variants of a long one in
    pairs of links that no other variant has."""
    phrase = "this page is kept"
    stock = [f"{phrase} " + " ".join(f"w{k}x{j}" for j in range(4)) for k in range(60)]
    base = [f"b{j}" for j in range(200)]
    near = [" ".join(f"v{k}y{j}" if j % 8 == k % 8 else w for j, w in enumerate(base)) for k in range(40)]
    return stock, near


def _linked(texts, percent, width):
    """Least place of each text's component, pair by pair."""
    sets = [set(near_dedup.shingles(t, width).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    return [label.index(x) for x in label]


def test_stock_phrases_send_no_texts(spark, monkeypatch):
    """A phrase that many texts share makes a long list; its texts used to meet in blocks."""
    stock, _ = _texts()
    sent = []
    plain = near_dedup.class_texts
    monkeypatch.setattr(near_dedup, "class_texts", lambda docs, wanted, *rest: sent.append(wanted.count()) or plain(docs, wanted, *rest))
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    docs = spark.createDataFrame(list(enumerate(stock)), "doc_id long, text string")
    out = near_dedup.near_duplicates(docs, 85, 3).collect()
    assert sent == [0, 0]
    assert all(r["kept"] for r in out) and len(out) == len(stock)


def test_long_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    monkeypatch.setattr(near_dedup, "SIGNATURE_BLOCK", 7)
    stock, near = _texts()
    texts = stock + near + [t + " tail" for t in near[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (60, 85):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, percent, 3, 6 if percent == 60 else 15).collect()}
        assert [got[k] for k in range(len(texts))] == _linked(texts, percent, 3)


def test_spanning_candidates_connect_all():
    rng = np.random.default_rng(3)
    n = 60
    sig = rng.integers(0, 4, (n, near_dedup.COORDINATES)).astype(np.int16)
    root, size = rng.integers(0, 20, n), rng.integers(80, 120, n)
    wanted = lambda p, q: root[p] != root[q] and (sig[p] == sig[q]).sum() >= 12 and 100 * min(size[p], size[q]) >= 85 * max(size[p], size[q])

    def parts(pairs):
        label = list(range(n))
        for p, q in pairs:
            label = [label[q] if x == label[p] else x for x in label]
        return [label.index(x) for x in label]

    every = [(p, q) for p in range(n) for q in range(p) if wanted(p, q)]
    group = lambda at, block: pa.table({"root": pa.array([root[k].tobytes() for k in at], pa.binary()), "n_shingles": size[at], "block": np.array(block), "sig": pa.array(sig[at].tolist(), pa.list_(pa.int16()))})
    one = list(zip(*near_dedup._candidates_of(group(np.arange(n), [0] * n), 85, 12), strict=True))
    assert every and parts(one) == parts(every) and all(wanted(p, q) for p, q in one)
    two = list(zip(*near_dedup._candidates_of(group(np.arange(n), [0] * 25 + [1] * 35), 85, 12), strict=True))
    assert parts(two) == parts([(p, q) for p, q in every if (p < 25) != (q < 25)])
