"""Duplicates by one field, numbering, and rows set apart or changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.derive import text
from meibo.operators.filters import Request, predicate


def js_trim(c: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(c, r"^[\s 　﻿]+|[\s 　﻿]+$", "")


def keep_first(df: DataFrame, column: str, order: list[str], unicode_trim: bool = False) -> DataFrame:
    """The first row, by ``order``, of each value of ``column``; rows with a blank value all stay.

    The smallest order of each value is an aggregate with partial sums, joined back, so a value that
    very many rows have is no task's burden; blank values are not gathered at all. ``order`` must tell
    rows apart; of rows that it does not, all are kept.
    """
    key = js_trim(text(column)) if unicode_trim else F.trim(text(column))
    rows = df.withColumns({"_key": key, "_at": F.struct(*order)})
    first = rows.where("_key <> ''").groupBy("_key").agg(F.min("_at").alias("_first"))
    kept = rows.join(first, "_key", "left").where("_key = '' OR _at = _first")
    return kept.select(*df.columns)


def duplicates(df: DataFrame, column: str, order: list[str], request: Request | None = None, scope: Request | None = None) -> DataFrame:
    """The rows that ``keep_first`` would drop, of those that a request and the user's scope select."""
    rows = df if request is None and scope is None else df.where(predicate(request or Request(), scope))
    return rows.join(keep_first(rows, column, order).select(*order), order, "left_anti")


def dedupe_companies(df: DataFrame, column: str, request: Request | None = None, scope: Request | None = None) -> DataFrame:
    """Companies without later copies of a value; rows that the request or the scope leaves out stay."""
    return df.join(duplicates(df, column, ["id"], request, scope).select("id"), "id", "left_anti")


def number_rows(df: DataFrame, order: list[Column] | None = None, name: str = "n", start: int | Column = 0) -> DataFrame:
    """``df`` with consecutive numbers, in the given order or in that of its partitions.

    Rows are range-sorted, counted by partition, and numbered from the sum of the partitions before; no
    task sees more than its partition. The sorted rows are checkpointed, since both passes must see
    the same partitions.
    """
    from pyspark.sql import Window

    from meibo.sources.shared import cut

    rows = df if order is None else df.orderBy(*order)
    rows = cut(rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_k"), F.min("_m").alias("_low"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", "_low", before.alias("_before"))  # one row for each partition
    first = start if isinstance(start, Column) else F.lit(start)
    out = rows.join(F.broadcast(counts), "_p").withColumn(name, (first + F.col("_before") + F.col("_m") - F.col("_low")).cast("long"))
    return out.drop("_p", "_m", "_low", "_before")


def assign_missing_ids(df: DataFrame, id_col: str = "id", order: list[Column] | None = None) -> DataFrame:
    """Rows without an id get the numbers after the greatest one, in the given order or in that of their partitions."""
    top = df.agg(F.max(id_col)).first()[0] or 0
    new = number_rows(df.where(F.col(id_col).isNull()).drop(id_col), order, name=id_col, start=top + 1)
    return df.where(F.col(id_col).isNotNull()).unionByName(new.select(*df.columns))


def delete_rows(df: DataFrame, request: Request, scope: Request | None = None) -> DataFrame:
    """What is left when the selected rows are deleted; a row that is not known to match stays."""
    return df.where(~predicate(request, scope))


def null_fields(df: DataFrame, columns: list[str], request: Request, scope: Request | None = None) -> DataFrame:
    """The ``columns`` of the selected rows in the user's scope set to null."""
    hit = predicate(request, scope)
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})
