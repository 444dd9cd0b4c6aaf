"""Identifiers between Spark and Python workers: a column of longs with a null reaches pandas as doubles, which change ids above 2^53."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(*columns: str) -> list[Column]:
    """For each column of longs, itself with 0 for null, and ``<name>_known``: neither has nulls, so both stay what they are."""
    return [c for name in columns for c in (F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name), F.col(name).isNotNull().alias(f"{name}_known"))]


def ids_of(pdf: pd.DataFrame, column: str) -> pd.api.extensions.ExtensionArray:
    """A column that ``exact`` sent, nulls back in their places."""
    return masked(pdf[column].to_numpy(np.int64), pdf[f"{column}_known"].to_numpy(bool))


def masked(values: np.ndarray, known: np.ndarray) -> pd.api.extensions.ExtensionArray:
    """64-bit integers, null where not known."""
    return pd.arrays.IntegerArray(np.array(values, np.int64), ~np.array(known, bool))


def listed(values: list[int | None]) -> pd.api.extensions.ExtensionArray:
    """A list of integers and nulls as it is: a frame made from rows would turn it into doubles first."""
    return pd.array(values, dtype="Int64")
