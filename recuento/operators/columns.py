"""Schema operators: strict projections, renames, name cleaning, typed maps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require(df: DataFrame, names: Sequence[str]) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")


def select_strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; an error names every absent one."""
    _require(df, names)
    return df.select(*[F.col(f"`{name}`") for name in names])


def drop_strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that must be there (``drop`` alone ignores a wrong name)."""
    _require(df, names)
    return df.drop(*names)


def rename(df: DataFrame, new_from_old: Mapping[str, str]) -> DataFrame:
    """Rename ``{new: old}``; the old names must be there."""
    _require(df, list(new_from_old.values()))
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def mutate(df: DataFrame, *stages: Mapping[str, Column]) -> DataFrame:
    """Derived columns, stage by stage: a stage sees the results of those before it.

    The columns of one stage are one projection and see the table as it was
    before the stage, an overwritten column included. So a column that reads
    another new or changed one belongs in a later stage.
    """
    for stage in stages:
        df = df.withColumns(dict(stage))
    return df


def map_columns_of_type(df: DataFrame, kind: type[T.DataType], change: Callable[[Column], Column]) -> DataFrame:
    """Apply ``change`` to every column of one type, in a single projection."""
    return df.select(
        *[
            change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kind) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def lower_text_columns(df: DataFrame) -> DataFrame:
    return map_columns_of_type(df, T.StringType, F.lower)


def cast_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _require(df, names)
    return df.withColumns({name: F.col(f"`{name}`").cast("string") for name in names})


def clean_name(name: str) -> str:
    """One column name as ASCII snake case."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"\W+", "_", text)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"_+", "_", text).strip("_").lower()
    if not text or text[0].isdigit():
        text = "x" + text
    return text


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every column name; a repeated one gets ``_2``, ``_3`` and so on."""
    cleaned: list[str] = []
    for name in map(clean_name, df.columns):
        unique, n = name, 1
        while unique in cleaned:
            n += 1
            unique = f"{name}_{n}"
        cleaned.append(unique)
    return df.toDF(*cleaned)
