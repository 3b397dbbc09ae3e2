"""Plain scans of single texts as column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType


def array_of(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(c, t) for c, t in fields.items()]))


def scanner(kind: ArrayType, scan):
    """A column function: each text (null: empty) to the tuples that ``scan`` finds in it."""
    names = kind.elementType.names

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in scan(t or "")])

    return run
