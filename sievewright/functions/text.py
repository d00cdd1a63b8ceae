"""Unicode functions Spark has no expression for, as Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


@pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.str.casefold()


def folded_name(name: str) -> str:
    """Header name for matching: NFKC, without zero-width characters, white space folded, case folded."""
    plain = "".join(c for c in unicodedata.normalize("NFKC", name) if c not in "\u200b\u200c\u200d\u2060\ufeff")
    return " ".join(plain.split()).casefold()
