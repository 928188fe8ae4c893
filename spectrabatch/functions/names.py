"""Column-name rules of the sample table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the sample table.
TARGET = "Penicillin concentration(P:g/L)"
TIME = "Time (h)"
BATCH = "Batch ID"
BATCH_REFERENCE = "Batch reference(Batch_ref:Batch ref)"
PAT_CONTROL = "2-PAT control(PAT_ref:PAT ref)"
FIRST_SPECTRAL = "2400"


# Fixed value: a spectral column is named by digits and dots only.
SPECTRAL_NAME = re.compile(r"\.*[0-9][0-9.]*")


def looks_spectral(name: str) -> bool:
    return SPECTRAL_NAME.fullmatch(name) is not None


def spectral_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and looks_spectral(f.name)]


def process_columns(df: DataFrame) -> list[str]:
    spectral = set(spectral_columns(df))
    return [name for name in df.columns if name not in spectral]


def quoted(name: str):
    """Column reference that is safe for dots and other signs in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def file_stem(kind: Column) -> Column:
    """A model kind as the first part of a file name: lower case, blanks as underscores."""
    return F.replace(F.lower(kind), F.lit(" "), F.lit("_"))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def last_part(path: Column, mark: str) -> Column:
    """What follows the last mark, or the whole text."""
    return F.substring_index(path, mark, -1)


def plain_name(name: str) -> str:
    """Lower-case identifier for use in SQL, e.g. ``time_h`` for ``Time (h)``."""
    cleaned = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
    return "c_" + cleaned if cleaned[:1].isdigit() else cleaned


def plain_names(columns: list[str]) -> dict[str, str]:
    """Map of original to plain names; a clash gets a running number."""
    taken: dict[str, str] = {}
    for original in columns:
        candidate = base = plain_name(original)
        number = 2
        while candidate in taken.values():
            candidate, number = f"{base}_{number}", number + 1
        taken[original] = candidate
    return taken
