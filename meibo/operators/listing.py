"""Ordering, paging, facets and counts of the company list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions import derive
from meibo.functions.derive import text
from meibo.operators.filters import Request, predicate
from meibo.schema import NAMES, PREFECTURES


def list_order(sort: str | None = None, descending: bool = False) -> list[Column]:
    """The requested field as text, then name, address and id; by code points."""
    keys = [] if sort is None else [text(sort).desc() if descending else text(sort).asc()]
    return [*keys, text("company").asc(), text("address").asc(), F.col("id").asc()]


def page_of_rows(df: DataFrame, page: int = 1, size: int = 200, sort: str | None = None, descending: bool = False) -> DataFrame:
    """One page in list order: top-k of the rows up to it, not a sort of all."""
    page, size = max(1, page), max(1, size)
    return df.select("id", *NAMES).orderBy(*list_order(sort, descending)).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, last: dict | None, size: int = 200, sort: str | None = None, descending: bool = False) -> DataFrame:
    """The ``size`` rows after a row in list order, from the first if ``last`` is null.

    ``last`` has the id, name, address and sort field of the last row shown. Rows up to it are left out by a
    filter, so that a page far down costs what the first one does.
    """
    keys = [*([(text(sort), descending, last and (last[sort] or ""))] if sort else []), *[(text(c), False, last and (last[c] or "")) for c in ("company", "address")], (F.col("id"), False, last and last["id"])]
    rows = df.select("id", *NAMES)
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for key, down, value in keys:
            beyond = beyond | (same & ((key < F.lit(value)) if down else (key > F.lit(value))))
            same = same & (key == F.lit(value))
        rows = rows.where(beyond)
    return rows.orderBy(*list_order(sort, descending)).limit(max(1, size))


def page_count(total: int, size: int = 200) -> int:
    """Pages of a list, one at least."""
    return max(1, -(-total // max(1, size)))


def total_count(df: DataFrame, request: Request, scope: Request | None = None) -> DataFrame:
    return df.where(predicate(request, scope)).agg(F.count("*").alias("total"))


def facet_values(df: DataFrame, column: str, request: Request, search: str = "", scope: Request | None = None) -> DataFrame:
    """Rows in the user's scope per text of a column, with all filters but the column's own; ``search`` narrows the texts."""
    out = df.where(predicate(request, scope, skip=column)).groupBy(text(column).alias("value")).agg(F.count("*").alias("n"))
    return out.where(F.ilike("value", F.lit(f"%{search.strip()}%"))) if search.strip() else out


def facet_page(facet: DataFrame, offset: int = 0, size: int = 200) -> DataFrame:
    """A page of a facet in order of its values; 1 to 1000 of them."""
    return facet.orderBy("value").offset(max(0, offset)).limit(min(max(size, 1), 1000))


def facet_summary(
    df: DataFrame, column: str, request: Request, search: str = "", checked: list[str] | None = None, offset: int = 0, size: int = 200,
    scope: Request | None = None,
) -> DataFrame:
    """Of one facet: distinct values and rows that match the search, rows with a value, checked rows, whether more follow.

    All are sums over the facet's own rows, so the table is grouped once.
    """
    every = facet_values(df, column, request, scope=scope)
    hit = F.ilike("value", F.lit(f"%{search.strip()}%")) if search.strip() else F.lit(True)
    filled = F.trim("value") != ""
    ticked = filled if checked is None else filled & F.col("value").isin([v for v in checked if v.strip()])
    rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    out = every.agg(F.count_if(hit).alias("n_values"), rows(hit).alias("n_matched"), rows(filled).alias("n_filled"), rows(ticked).alias("n_checked"))
    return out.withColumn("has_more", F.col("n_values") > offset + size)


def facet_prefecture_city(df: DataFrame, request: Request = Request(), scope: Request | None = None) -> DataFrame:
    """Rows per prefecture and city, a row with null city for the prefecture's total, in the order of prefectures."""
    src = df.where(predicate(request, scope)).select(derive.prefecture().alias("prefecture"), derive.city().alias("city"))
    cities = src.where("prefecture IS NOT NULL").groupBy("prefecture", "city").agg(F.count("*").alias("n"))
    totals = cities.groupBy("prefecture").agg(F.sum("n").alias("n")).select("prefecture", F.lit(None).cast("string").alias("city"), "n")
    out = totals.unionByName(cities.where("city IS NOT NULL"))
    place = F.array_position(F.array(*[F.lit(p) for p in PREFECTURES]), F.col("prefecture")).cast("int")
    return out.select(derive.region(F.col("prefecture")).alias("region"), place.alias("place"), "prefecture", "city", "n")


def facet_industry(df: DataFrame, request: Request = Request(), scope: Request | None = None) -> DataFrame:
    """Rows per trimmed big and small industry with the parent's name; a null small industry is the total."""
    trim = lambda c: F.regexp_replace(text(c), r"^[\s 　﻿]+|[\s 　﻿]+$", "")
    src = df.where(predicate(request, scope)).select(trim("big_industry").alias("big"), trim("small_industry").alias("small"))
    groups = src.where("big <> ''").groupBy("big", "small").agg(F.count("*").alias("n"))
    totals = groups.groupBy("big").agg(F.sum("n").alias("n")).select("big", F.lit(None).cast("string").alias("small"), "n")
    return totals.unionByName(groups.where("small <> ''")).withColumn("parent", derive.industry_parent("big"))


def facet_established(df: DataFrame, request: Request = Request(), scope: Request | None = None) -> DataFrame:
    """Years with the months in which companies were founded, each once and in order."""
    ym = df.where(predicate(request, scope)).select(derive.established_ym().alias("ym")).where("ym IS NOT NULL").distinct()
    months = F.array_sort(F.collect_set(F.substring("ym", 5, 2)))
    return ym.groupBy(F.substring("ym", 1, 4).alias("year")).agg(F.array_join(months, ",").alias("months"))


def explode_tags(df: DataFrame) -> DataFrame:
    """A row for each tag of a company."""
    return df.select("id", F.explode(derive.tags()).alias("tag"))


def facet_tags(df: DataFrame, request: Request = Request(), scope: Request | None = None) -> DataFrame:
    """Rows per tag with its parent, and the parent's total beside it."""
    tags = explode_tags(df.where(predicate(request, scope))).groupBy("tag").agg(F.count("*").alias("n"))
    tags = tags.withColumn("parent", derive.tag_parent(F.col("tag")))
    return tags.withColumn("parent_n", F.sum("n").over(Window.partitionBy("parent")))
