"""Scans of LaTeX sources (doc_id, tex): labels, references, macros, theorems, symbols."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from papergraph.functions.scan import array_of, scanner
from papergraph.functions.text import clean_text, or_empty, strip, strip_comments
from papergraph.operators import tex_scan

# Theorem-like kinds, names of Greek letters, tokens that are no notation, commands
# that refer, display environments, commands that mark structure in a macro's body.
THEOREM_KINDS = ("theorem", "lemma", "corollary", "proposition", "definition", "assumption", "remark", "claim", "example", "conjecture")
GREEK = (
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau",
    "upsilon", "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega", "ell",
)
NO_NOTATION = ("a", "A", "I", "e", "i", "j", "s", "t", "o", "O")
REF_COMMANDS = tuple(prefix + ref for prefix in ("", "auto", "eq", "page", "c", "C") for ref in ("ref", "Ref"))
DISPLAYS = ("equation", "align", "gather", "multline", "eqnarray")
MATH_ALPHABETS = ("mathbb", "mathcal", "mathbf", "mathrm", "text", "vec", "hat")

OPTION, ARGUMENT = r"\[[^\]]*\]", r"\{([^}]+)\}"


def command(*names: str, starred: bool = True, options: str = "") -> str:
    """A pattern for these commands, whose group is the argument; ``options`` is ? or * for square brackets."""
    return r"\\(?:" + "|".join(names) + ")" + r"\*?" * starred + (f"(?:{OPTION})" + options) * bool(options) + ARGUMENT


LABEL = command("label", starred=False)
GROUPS = array_of(name=StringType(), body=StringType(), tail=StringType())


def all_of(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sources(files: DataFrame, text_col: str = "tex") -> DataFrame:
    """doc_id, tex without comments: what the scans below take."""
    return files.select("doc_id", strip_comments(F.col(text_col)).alias("tex"))


LABELS = array_of(label=StringType(), kind=StringType())
_EVENT = re.compile(r"\\(?:(?P<turn>begin|end)\{(?P<env>[a-zA-Z*]+)\}|label\{(?P<label>[^}]+)\})")


def open_environments(text: str) -> dict[str, str]:
    """Each label and the environment around it, in one pass.

    A running count an environment tells how many of its openings are still open (they
    are the first ones); the label takes the open one that stands last.
    """
    begins: dict[str, list[int]] = defaultdict(list)
    ends: Counter[str] = Counter()
    out: dict[str, str] = {}
    for m in _EVENT.finditer(text or ""):
        if m["turn"] == "begin":
            begins[m["env"]].append(m.start())
        elif m["turn"] == "end":
            ends[m["env"]] += 1
        else:
            last = {places[len(places) - ends[env] - 1]: env for env, places in begins.items() if len(places) > ends[env]}
            label = m["label"].strip()
            out.pop(label, None)
            out[label] = last[max(last)] if last else "text"
    return out


@F.pandas_udf(LABELS)
def _label_kinds(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"label": k, "kind": v} for k, v in open_environments(t).items()])


def labels(tex: DataFrame) -> DataFrame:
    """doc_id, label, kind: the environment open around each label, else ``text``.

    A repeated label keeps the last. A paper's labels come from its own row: no shuffle.
    """
    return tex.select("doc_id", F.explode(_label_kinds("tex")).alias("x")).select("doc_id", "x.label", "x.kind")


def _listed(tex: DataFrame, pattern: str, name: str) -> DataFrame:
    """doc_id, ord, part: comma-separated arguments of a command, in order."""
    keys = F.flatten(F.transform(all_of(F.col("tex"), pattern, 1), lambda x: F.split(x, ",", -1)))
    return tex.select("doc_id", F.posexplode(keys).alias("ord", "k")).select("doc_id", "ord", strip(F.col("k")).alias(name))


def refs(tex: DataFrame) -> DataFrame:
    return _listed(tex, command(*REF_COMMANDS), "ref")


def cite_keys(tex: DataFrame) -> DataFrame:
    return _listed(tex, command("[cC]ite[a-zA-Z]*", options="*"), "key")


def bibliography(tex: DataFrame) -> DataFrame:
    r"""doc_id, key, text: ``\bibitem`` entries; a repeated key keeps the last."""
    item = command("bibitem", starred=False, options="?")
    entries = F.arrays_zip(all_of(F.col("tex"), item, 1).alias("key"), F.slice(F.split("tex", item, -1), 2, 1 << 30).alias("body"))
    body = F.substring_index(F.substring_index("e.body", r"\bibitem", 1), r"\end{thebibliography}", 1)
    rows = tex.select("doc_id", F.posexplode(entries).alias("ord", "e")).select("doc_id", "ord", strip(F.col("e.key")).alias("key"), F.substring(clean_text(body), 1, 600).alias("text"))
    return rows.groupBy("doc_id", "key").agg(F.max_by("text", "ord").alias("text"), F.min("ord").alias("ord"))


#: Commands that define a macro.
DEFINING = ("newcommand", "renewcommand")
_HEADING = re.compile(r"\\((?:sub){0,2}section)\*?(?=\{)")


def groups_after(opener: re.Pattern, name: int, most: int = 2000):
    """A column function: text to array of (name, body, tail) for what ``opener`` finds; the
    body is the brace group that follows, of fewer than ``most`` characters."""

    def groups(text: str | None) -> list[dict]:
        found = list(opener.finditer(text or ""))
        pairs = tex_scan.brace_pairs(text) if found else {}
        ends = ((m, pairs.get(m.end())) for m in found)
        return [{"name": m[name], "body": text[m.end() + 1 : end], "tail": text[m.end() + 1 : m.end() + 201]} for m, end in ends if end is not None and end - m.end() < most]

    @F.pandas_udf(GROUPS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(groups)

    return run


def macros(tex: DataFrame) -> DataFrame:
    """doc_id, ord, name, body: the last definition counts, operators over commands."""
    found = scanner(array_of(name=StringType(), body=StringType()), lambda t: tex_scan.definitions(t, DEFINING))
    commands = tex.select("doc_id", F.posexplode(found("tex")).alias("at", "m")).select("doc_id", F.lit(0).alias("pass"), "at", "m.name", strip(F.col("m.body")).alias("body"))
    operator = r"\\DeclareMathOperator\*?" + r"\{\\([a-zA-Z]+)\}" + ARGUMENT.replace("+", "*")
    pairs = F.arrays_zip(all_of(F.col("tex"), operator, 1).alias("name"), all_of(F.col("tex"), operator, 2).alias("body"))
    operators = tex.select("doc_id", F.posexplode(pairs).alias("at", "m")).select("doc_id", F.lit(1).alias("pass"), "at", "m.name", "m.body")
    place = F.struct("pass", "at")
    kept = commands.unionByName(operators).groupBy("doc_id", "name").agg(F.min(place).alias("first"), F.max_by("body", place).alias("body"))
    order = Window.partitionBy("doc_id").orderBy("first")
    return kept.select("doc_id", F.row_number().over(order).alias("ord"), "name", "body")


def theorems(tex: DataFrame) -> DataFrame:
    """doc_id, ord, kind, title, label, statement, depth of theorem-like environments, declared
    ones too: one pass over a paper's own row, no shuffle."""
    kind = array_of(kind=StringType(), title=StringType(), body=StringType(), depth=IntegerType())
    rows = tex.select("doc_id", F.posexplode(scanner(kind, lambda t: tex_scan.statements(t, THEOREM_KINDS))("tex")).alias("nth", "t"))
    statement = clean_text(F.regexp_replace("t.body", LABEL, ""))
    return rows.select("doc_id", (F.col("nth") + 1).alias("ord"), "t.kind", strip(F.col("t.title")).alias("title"), strip(F.regexp_extract("t.body", LABEL, 1)).alias("label"), F.substring(statement, 1, 1200).alias("statement"), "t.depth")


def tex_sections(tex: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, label of sectioning commands."""
    found = tex.select("doc_id", F.posexplode(groups_after(_HEADING, 1)("tex")).alias("ord", "s"))
    return found.select("doc_id", "ord", F.col("s.name").alias("level"), clean_text(F.col("s.body")).alias("title"), strip(F.regexp_extract("s.tail", LABEL, 1)).alias("label"))


def symbols(tex: DataFrame, least: int = 3, most: int = 40) -> DataFrame:
    """doc_id, token, count, ord: the commonest notation of a paper's mathematics; ties by first
    sight. Counted in the paper's own row."""
    kind = array_of(token=StringType(), count=LongType())
    found = scanner(kind, lambda t: tex_scan.commonest_notation(t, DISPLAYS, GREEK, NO_NOTATION, least, most))
    return tex.select("doc_id", F.posexplode(found("tex")).alias("at", "x")).select("doc_id", "x.token", "x.count", (F.col("at") + 1).alias("ord"))


def structured_body(body: Column) -> Column:
    """Whether a macro's expansion has scripts or a math alphabet."""
    out = body.contains("_") | body.contains("^")
    for name in MATH_ALPHABETS:
        out = out | or_empty(body).contains("\\" + name)
    return out
