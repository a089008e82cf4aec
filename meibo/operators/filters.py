"""A filter request on the company list, compiled into one predicate.

``FieldFilter`` holds one field's condition and value list, ``AdvancedFilter`` the derived values, and
``predicate`` joins them, with a user's stored scope, into a Column that is never null: rows that are
not known to match do not match. Derived columns are read if ``derived`` is true (see
``enrich_companies``), else computed in place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions import derive
from meibo.functions.derive import text
from meibo.schema import REGIONS

CONDITIONS = ("contains", "not_contains", "equals", "not_equals", "starts_with", "ends_with", "is_empty", "is_not_empty")


def clean(values: Iterable[str] | None) -> list[str]:
    """Values trimmed, blank ones dropped, each once, in order."""
    return list(dict.fromkeys(v.strip() for v in (str(x) for x in values or () if x is not None) if v.strip()))


def number(value: object) -> float | None:
    """A bound of a range; commas are dropped, what is no number is no bound."""
    try:
        out = float(str(value).replace(",", "").strip())
    except ValueError:
        return None
    return out if out == out and abs(out) != float("inf") else None


def blank(c: str | Column, strict_space: bool = False) -> Column:
    """True for a null or blank value. ``strict_space`` trims ASCII spaces only, else all white space and U+3000."""
    t = text(c)
    return (F.trim(t) if strict_space else F.regexp_replace(t, r"[\s　]+", "")) == ""


def not_blank(c: str | Column, strict_space: bool = False) -> Column:
    return ~blank(c, strict_space)


@dataclass(frozen=True)
class FieldFilter:
    """``condition`` with ``value``; and, if ``values_on``, ``values`` as a list of which one must match."""

    condition: str = "contains"
    value: str = ""
    values_on: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Range:
    least: object = None
    most: object = None


@dataclass(frozen=True)
class AdvancedFilter:
    company: str = ""
    regions: tuple[str, ...] = ()
    prefectures: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    big_industries: tuple[str, ...] = ()
    small_industries: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    months: tuple[str, ...] = ()
    month_from: str = ""
    month_to: str = ""
    capital: Range = Range()
    employees: Range = Range()
    tags: tuple[str, ...] = ()
    tag_parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class Request:
    fields: dict[str, FieldFilter] = field(default_factory=dict)
    advanced: AdvancedFilter = AdvancedFilter()


def condition(c: str, kind: str, value: str = "") -> Column | None:
    """One condition on a column's text. Letters' case does not count but for equality; ``%`` and ``_`` in a value stay patterns."""
    if kind not in CONDITIONS:
        raise ValueError(f"no such condition: {kind}")
    t, like = text(c), lambda p: F.ilike(text(c), F.lit(p))
    if kind == "is_empty":
        return blank(c)
    if kind == "is_not_empty":
        return not_blank(c)
    value = value.strip()
    if not value:
        return None
    return {
        "contains": lambda: like(f"%{value}%"),
        "not_contains": lambda: ~like(f"%{value}%"),
        "equals": lambda: t == value,
        "not_equals": lambda: t != value,
        "starts_with": lambda: like(f"{value}%"),
        "ends_with": lambda: like(f"%{value}"),
    }[kind]()


def value_filter(c: str, values: Iterable[str]) -> Column:
    """The text is one of ``values``; an empty text in the list stands for blank. An empty list matches nothing."""
    values = list(values)
    named = clean(values)
    tests = [text(c).isin(named)] if named else []
    if any(not str(v).strip() for v in values):
        tests.append(blank(c))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def fields_predicate(fields: dict[str, FieldFilter], skip: str | None = None) -> Column:
    """All fields' conditions and value lists; ``skip`` leaves one field out, for its own facet."""
    tests = []
    for name, f in fields.items():
        if name == skip:
            continue
        test = condition(name, f.condition, f.value)
        tests += [] if test is None else [test]
        tests += [value_filter(name, f.values)] if f.values_on else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_range(c: Column, r: Range) -> Column:
    low, high = number(r.least), number(r.most)
    test = F.lit(True)
    test = test if low is None else test & (c >= F.lit(low).cast("decimal(38,6)"))
    return test if high is None else test & (c <= F.lit(high).cast("decimal(38,6)"))


def advanced_predicate(a: AdvancedFilter, derived: bool = False) -> Column:
    """The advanced filters, all of which must hold; places are alternatives of each other."""
    get = lambda name, make: F.col(name) if derived else make()
    tests = []
    if a.company.strip():
        tests.append(F.ilike(text("company"), F.lit(f"%{a.company.strip()}%")))
    named = clean(a.prefectures)
    regional = [p for r in clean(a.regions) for p in REGIONS.get(r, ())]
    places = [get("prefecture", derive.prefecture).isin(x) for x in (regional, named) if x]
    places += [get("city", derive.city).isin(clean(a.cities))] if clean(a.cities) else []
    if places:
        tests.append(reduce(lambda x, y: x | y, places))
    kinds = [text(c).isin(clean(v)) for c, v in (("big_industry", a.big_industries), ("small_industry", a.small_industries)) if clean(v)]
    if kinds:
        tests.append(reduce(lambda x, y: x | y, kinds))
    ym = get("established_ym", derive.established_ym)
    when = [F.substring(ym, 1, 4).isin(clean(a.years))] if clean(a.years) else []
    when += [ym.isin(clean(a.months))] if clean(a.months) else []
    if when:
        tests.append(reduce(lambda x, y: x | y, when))
    tests += [ym >= a.month_from.strip()] if a.month_from.strip() else []
    tests += [ym <= a.month_to.strip()] if a.month_to.strip() else []
    tests.append(in_range(get("capital_numeric", derive.capital_numeric), a.capital))
    tests.append(in_range(get("employee_numeric", derive.employee_numeric), a.employees))
    own, parents = clean(a.tags), clean(a.tag_parents)
    if own or parents:
        one = lambda t: (t.isin(own) if own else F.lit(False)) | (derive.tag_parent(t).isin(parents) if parents else F.lit(False))
        tests.append(F.exists(get("tags", derive.tags), one))
    return reduce(lambda x, y: x & y, tests)


def predicate(request: Request, scope: Request | None = None, skip: str | None = None, derived: bool = False) -> Column:
    """A request and a user's stored scope as one predicate; unknown counts as no match. No scope: everything is in it."""
    test = fields_predicate(request.fields, skip) & advanced_predicate(request.advanced, derived)
    if scope is not None:
        test = test & fields_predicate(scope.fields) & advanced_predicate(scope.advanced, derived)
    return F.coalesce(test, F.lit(False))


def filter_companies(df: DataFrame, request: Request, scope: Request | None = None, derived: bool = False) -> DataFrame:
    """The rows that a request and a scope let through."""
    return df.where(predicate(request, scope, derived=derived))


def filter_by_values(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose text is in the single column of ``values``: a long value list as a semi join."""
    v = values.select(F.trim(F.col(values.columns[0])).alias("_v")).where("_v <> ''").distinct()
    return df.join(v, text(column) == F.col("_v"), "left_semi")


def inspection_targets(df: DataFrame, request: Request) -> DataFrame:
    """Filtered rows that have a representative's name."""
    return filter_companies(df, request).where(not_blank("representative_name"))
