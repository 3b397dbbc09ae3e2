"""Many patterns at once in a paper's texts, by an Aho-Corasick automaton a paper."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def found_in(texts: list[str], labels: list[str], keys: list[str]) -> list[tuple[int, str]]:
    """(number of the text, label) for every text in which a label's key stands, once each.

    Time goes with the texts and the hits, however many keys there are.
    """
    by_key: dict[str, list[str]] = {}
    for label, key in zip(labels, keys, strict=True):
        by_key.setdefault(key, []).append(label)
    automaton = ahocorasick.Automaton()
    for key in by_key:
        automaton.add_word(key, key)
    automaton.make_automaton()
    return [(n, label) for n, text in enumerate(texts) for key in sorted({k for _, k in automaton.iter(text)}) for label in by_key[key]]


def contained(patterns: DataFrame, texts: DataFrame, place: str) -> DataFrame:
    """doc_id, label, ``place``: the texts (doc_id, ``place``, blob) of a paper in which the key
    of a pattern (doc_id, label, key) stands, once each.

    A paper's patterns and its texts meet in one row; texts times patterns are never rows.
    Null and empty keys and texts match nothing; places may repeat.
    """
    kind = f"array<struct<label:string,place:{dict(texts.dtypes)[place]}>>"

    @F.pandas_udf(kind)
    def hits(labels: pd.Series, keys: pd.Series, places: pd.Series, blobs: pd.Series) -> pd.Series:
        return pd.Series([[{"label": x, "place": p[n]} for n, x in found_in(list(b), list(s), list(k))] for s, k, p, b in zip(labels, keys, places, blobs, strict=True)])

    asked = patterns.where("key != ''").groupBy("doc_id").agg(F.collect_set(F.struct("label", "key")).alias("p"))
    given = texts.where("blob != ''").groupBy("doc_id").agg(F.collect_list(F.struct(F.col(place).alias("place"), "blob")).alias("t"))
    met = asked.join(given, "doc_id").select("doc_id", F.explode(hits("p.label", "p.key", "t.place", "t.blob")).alias("x"))
    return met.select("doc_id", "x.label", F.col("x.place").alias(place))
