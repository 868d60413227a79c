"""Query records, table access and the pieces of the comparison SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from recuento.functions.categories import Band


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values_sql(rows: Sequence[Sequence], names: Sequence[str], alias: str = "v") -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"


def nearest_sql(x: str, digits: int) -> str:
    """Nearest value with ``digits`` decimals, ties to even, for ``x >= 0``."""
    p = f"1e{digits}"
    down, up = f"floor(({x}) * {p}) / {p}", f"ceil(({x}) * {p}) / {p}"
    return (
        f"CASE WHEN ({x}) - {down} < {up} - ({x}) THEN {down} "
        f"WHEN ({x}) - {down} = {up} - ({x}) AND floor(({x}) * {p}) % 2 = 0 THEN {down} "
        f"ELSE {up} END"
    )


def band_sql(x: str, bands: Sequence[Band]) -> str:
    arms = []
    for b in bands:
        if b.below is not None:
            test = f"({x}) < {b.below}"
        elif b.high is None:
            test = f"({x}) >= {b.low}"
        else:
            test = f"({x}) >= {b.low} AND ({x}) <= {b.high} AND ({x}) = floor({x})"
        arms.append(f"WHEN {test} THEN {literal(b.label)}")
    return "CASE " + " ".join(arms) + " END"


def case_sql(x: str, pairs: Sequence[tuple[object, object]], otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {literal(old)} THEN {literal(new)}" for old, new in pairs)
    return f"CASE {x} {arms} ELSE {x if otherwise is None else otherwise} END"


def position_sql(x: str, levels: Sequence[str]) -> str:
    return case_sql(x, [(level, i + 1) for i, level in enumerate(levels)], "NULL")
