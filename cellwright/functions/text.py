"""Text helpers that Spark lacks (Unicode normal forms), as Arrow functions over distinct values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(value: str) -> str:
    """Lower case, NFC, white space of any kind trimmed at the ends and inside cut to one blank."""
    return " ".join(unicodedata.normalize("NFC", value.lower()).split())


@F.pandas_udf(T.StringType())
def fold_udf(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")
