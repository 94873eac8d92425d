"""How clients show results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import ascii_lower, col


def short_path(path: Column | str) -> Column:
    """More than 50 characters: ``...`` and the last 47."""
    p = col(path)
    return F.when(F.length(p) > 50, F.concat(F.lit("..."), F.right(p, F.lit(47)))).otherwise(p)


def result_line() -> Column:
    return F.format_string("%-50s %-10s %s:%s", "name", "kind", short_path("file"), F.col("line").cast("string"))


def absolute(root: str, file: Column | str = "file") -> Column:
    return F.when(F.startswith(col(file), F.lit("/")), col(file)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), col(file)))


def summary() -> Column:
    return F.format_string("%s [%s]", "name", "kind")


def exact_or_all(rows: DataFrame, identifier: str) -> DataFrame:
    """Rows named exactly ``identifier`` in any case; if there are none, all rows. Two passes instead of a one-partition window."""
    hit = ascii_lower("name") == ascii_lower(F.lit(identifier))
    found = rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("__any"))
    return rows.crossJoin(F.broadcast(found)).where(hit | ~F.col("__any")).drop("__any")


def result_json() -> Column:
    return F.to_json(F.struct("name", "kind", "file", "line", "score"))
