"""Missing-value handling for text read from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.schemas import NA_STRINGS


def null_na_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn every pandas-style missing marker (``NA``, ``None``, ``n/a`` …) into null.

    Spark's CSV reader only nulls empty fields; pandas treats 19 markers as
    missing, so without this the fill steps would miss them.
    """
    columns = columns if columns is not None else df.columns
    markers = [F.lit(s) for s in NA_STRINGS]
    return df.withColumns({c: F.when(~F.col(c).isin(*markers), F.col(c)) for c in columns})
