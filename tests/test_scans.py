"""LaTeX scanners and multi-pattern matching against plain versions."""

import random
import re
import time

from papergraph.operators import latex, matching, tex_scan


def regions(text):
    return list(tex_scan.Regions(text, latex.DISPLAYS))


def test_regions_end_at_their_marks():
    assert regions(r"a $x$ $$y$$ \[z\] \(w\) \begin{align*}v\end{align*} \begin{figure}u\end{figure}") == ["x", "y", "z", "w", "v"]
    assert regions(r"$$ never closed $a$ and \[ open \( b \)") == ["$ never closed ", r" and \[ open \( b \)"][:1] + [" b "]
    assert regions(r"$$ $x$ $$") == [" $x$ "]
    assert regions(r"\[\] \(\) $a\] $") == ["", "", r"a\] "]
    assert regions(r"\begin{equation}a\end{align} \begin{equation}b") == ["a"]
    assert regions("") == []


def test_unclosed_marks_cost_no_second_search():
    text = (r"\[ \( $$ \begin{equation} " * 40_000).replace("$$", r"\$" * 0)
    began = time.perf_counter()
    assert regions(text) == [] and len(regions("$x " * 100_001)) == 50_000
    assert time.perf_counter() - began < 5


def test_notation_equals_a_plain_reading():
    script = r"\{?[\\a-zA-Z0-9]{1,12}\}?"
    plain = re.compile("(?:[a-zA-Z]|" + "|".join(rf"\\{g}" for g in latex.GREEK) + f")(?:_{script})?(?:\\^{script})?")
    rng = random.Random(3)
    parts = ["a", "Q", r"\alpha", r"\alphabet", r"\eta", r"\xi", "_", "^", "{", "}", "12", "bc", " ", "\\", r"\frac", "x" * 14, "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(tex_scan.notation(text, latex.GREEK)) == plain.findall(text)


def test_commonest_notation_limits_and_ties(spark):
    text = " ".join(f"$a_{{{k}}}$" * (1 + k % 5) for k in range(60)) + r" $Q$ $Q$ $Q$ $e$ $e$ $e$ $I I I$ x_9 x_9 x_9"
    counts = {f"a_{k}": 1 + k % 5 for k in range(60)} | {"Q": 3}
    ranked = sorted(counts, key=lambda t: (-counts[t], list(counts).index(t)))
    tex = spark.createDataFrame([(1, text), (2, None), (3, "no mathematics")], "doc_id long, tex string")
    got = sorted((r["ord"], r["token"], r["count"]) for r in latex.symbols(tex, least=3, most=30).collect())
    assert got == [(k + 1, t, counts[t]) for k, t in enumerate(ranked[:30]) if counts[t] >= 3]


def test_definitions_in_every_form():
    text = r"""\newcommand{\a}{x{y}} \newcommand\b{z} \renewcommand*{\c}[2]{#1 \{ #2} \newcommand {\d} [1]
 {w} \newcommandx{\no}{n} \newcommand{\e} text \newcommand{\f}[x]{n} \newcommand{\g}{open \newcommand{3}{n}"""
    assert tex_scan.definitions(text, latex.DEFINING) == [("a", "x{y}"), ("b", "z"), ("c", r"#1 \{ #2"), ("d", "w")]
    assert tex_scan.definitions(r"\newcommand{\long}{" + "x" * 3000 + "}", latex.DEFINING) == []


def test_statements_nested_aliased_and_broken():
    scan = lambda t: tex_scan.statements(t, latex.THEOREM_KINDS)
    text = r"""\newtheorem{obs}[lem]{Key Remark}\newtheorem*{thm}{Main Theorem}\newtheorem{odd}{Oddity}
\begin{obs}[Far] out \begin{claim} in \begin{thm}deep\end{thm} \end{claim} rest\end{obs}
\begin{claim}one \begin{claim}two\end{claim} three\end{claim} \begin{odd}x\end{odd} \end{lemma} \begin{lemma} never ends"""
    assert scan(text) == [
        ("claim", "", r" in \begin{thm}deep\end{thm} ", 1), ("claim", "", r"one \begin{claim}two", 0),
        ("remark", "Far", r" out \begin{claim} in \begin{thm}deep\end{thm} \end{claim} rest", 0), ("theorem", "", "deep", 2),
    ]
    assert scan(r"\newtheorem{lemma}{My Corollary}\begin{lemma}x\end{lemma}") == [("corollary", "", "x", 0)]
    assert scan("") == [] and scan(r"\newtheorem{") == []


def test_theorems_move_no_text(spark):
    plan = latex.theorems(spark.createDataFrame([(1, "x")], "doc_id long, tex string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_patterns_are_found_as_by_looking_for_each(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abx_") for _ in range(rng.randrange(1, n)))
    keys = [(d, f"l{k}", word(4)) for d in range(6) for k in range(12)] + [(0, "twin", "ab"), (0, "empty", ""), (0, None, "a"), (9, "alone", "a")]
    texts = [(d, d * 100 + k, word(20)) for d in range(6) for k in range(30)] + [(0, 7, ""), (0, 8, None), (8, 9, "abx"), (1, 100, "ab"), (1, 100, "ab")]
    got = matching.contained(spark.createDataFrame(keys, "doc_id long, label string, key string"), spark.createDataFrame(texts, "doc_id long, at long, blob string"), "at")
    want = [(d, x, at) for d, x, k in set(keys) for e, at, t in texts if d == e and k and t and k in t]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 500
