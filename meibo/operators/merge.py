"""Review of extracted values: bundles of candidates, differences to the stored row, choices, and the merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.text import compare_key, contact_key, nullable, strip_corporate, unique_texts
from meibo.operators.dedupe import js_trim
from meibo.schema import PREVIEW_KEY

#: Fields with several candidates, and fields with one value.
MANY = ("phone", "fax", "email", "zipcode", "address")
ONE = (
    "company", "website_url", "form_url", "established_date", "representative_name", "capital", "employee_count", "business_content",
    "permit_number",
)
#: Filled only where blank; shown even where equal.
FILL_ONLY, SHOWN_EQUAL = ("company", "website_url"), ("representative_name", "employee_count")


def bundle(extracted: DataFrame) -> DataFrame:
    """(preview_row_id, row_id, office_index, field, candidates) of extracted records.

    ``extracted`` has arrays for the fields of ``MANY`` and texts for those of ``ONE``; candidates are
    trimmed, blank ones dropped, each once and in order.
    """
    every = [
        F.struct(F.lit(f).alias("field"), unique_texts(F.col(f) if f in MANY else F.array(F.col(f))).alias("candidates"))
        for f in (*MANY, *ONE)
        if f in extracted.columns
    ]
    rows = extracted.select("preview_row_id", "row_id", "office_index", F.explode(F.array(*every)).alias("c"))
    return rows.select("preview_row_id", "row_id", "office_index", "c.field", "c.candidates").where(F.size("candidates") > 0)


def labelled_candidates(offices: DataFrame, field: str) -> DataFrame:
    """(row_id, labelled, value): numbers of all offices in office order, each number once, with the office's name before it.

    An office is named by its name, first address or company. ``+81`` and ``0`` begin the same number;
    a candidate without digits is itself.
    """
    label = F.coalesce(nullable("office_name"), nullable(F.get("address", F.lit(0))), nullable("company"))
    each = offices.select("row_id", "office_index", label.alias("label"), F.posexplode(unique_texts(F.col(field))).alias("k", "value"))
    key = contact_key("value")
    each = each.withColumn("key", F.when(key != "", key).otherwise(F.concat_ws("：", "label", "value")))
    first = each.groupBy("row_id", "key").agg(F.min_by(F.struct("office_index", "k", "label", "value"), F.struct("office_index", "k")).alias("f"))
    shown = F.when(F.col("f.label").isNull(), F.col("f.value")).otherwise(F.concat_ws("：", "f.label", "f.value"))
    return first.select("row_id", F.col("f.office_index").alias("office_index"), F.col("f.k").alias("k"), shown.alias("labelled"), F.col("f.value").alias("value"))


def office_text(c: str | Column) -> Column:
    """Folded for comparison: no spaces, dashes or brackets, lower case."""
    return F.regexp_replace(compare_key(c), r"[‐-‒–—―ー－\-（）()\[\]【】「」『』]", "")


def office_scores(offices: DataFrame, companies: DataFrame) -> DataFrame:
    """(row_id, office_index, score, place): how well each office fits its stored row; equal scores keep their order."""
    from pyspark.sql import Window

    c = companies.select(F.col("id").alias("row_id"), strip_corporate(office_text("company")).alias("sc"), office_text("address").alias("sa"))
    rows = offices.join(c, "row_id").withColumns(
        {
            "on": office_text("office_name"),
            "oc": strip_corporate(office_text("company")),
            "oa": F.filter(F.transform(unique_texts(F.col("address")), office_text), lambda x: x != ""),
        }
    )
    has = lambda a, b: F.contains(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    give = lambda test, n: F.when(test, n).otherwise(0)

    def address(x: Column) -> Column:
        same = has("sa", x) | has(x, "sa")
        both = F.least(F.length(x), F.length("sa"))
        equal = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.substring(x, F.lit(1), i) == F.substring(F.col("sa"), F.lit(1), i))
        prefix = F.size(equal)
        return F.when(F.col("sa") == "", 0).when(same, 2000).when(prefix >= 8, prefix * 10).otherwise(0)

    score = (
        give((F.col("on") != "") & has("sc", "on"), 1000)
        + give((F.col("on") != "") & has("sa", "on"), 400)
        + give((F.col("oc") != "") & (F.col("sc") != "") & (has("sc", "oc") | has("oc", "sc")), 120)
        + F.aggregate(F.transform("oa", address), F.lit(0), lambda a, b: a + b)
    )
    out = rows.select("row_id", "office_index", score.alias("score"))
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "office_index")
    return out.withColumn("place", F.row_number().over(order))


def diff(bundles: DataFrame, companies: DataFrame, selected: tuple[str, ...] = (*MANY, *ONE)) -> DataFrame:
    """(preview_row_id, row_id, office_index, field, before, after, candidates) of every change to review.

    A field of several candidates is a change if it has more than one, or another than the stored
    value; a field of one value if it differs, and the shown-equal fields always. The stored row is
    unpivoted once and joined by row and field.
    """
    names = [f for f in (*MANY, *ONE) if f in companies.columns]
    stored = companies.select(F.col("id").alias("row_id"), *[nullable(f).alias(f) for f in names])
    stored = stored.unpivot("row_id", names, "field", "before")
    rows = bundles.where(F.col("field").isin(*selected)).join(stored, ["row_id", "field"], "left")
    after = F.get("candidates", F.lit(0))
    many = F.col("field").isin(*MANY) & (F.size("candidates") > 1)
    changed = many | ~after.eqNullSafe(F.col("before")) | F.col("field").isin(*SHOWN_EQUAL)
    return rows.where(changed).select("preview_row_id", "row_id", "office_index", "field", "before", after.alias("after"), "candidates")


def multi_candidate_rows(changes: DataFrame) -> DataFrame:
    """Changes whose candidates are more than one when folded for comparison."""
    number = F.col("field").isin("phone", "fax")
    keys = F.transform("candidates", lambda c: F.when(number, contact_key(c)).otherwise(compare_key(c)))
    return changes.where(F.size(F.array_distinct(F.filter(keys, lambda k: k != ""))) > 1)


def selected_values(changes: DataFrame, choices: DataFrame) -> DataFrame:
    """(preview_row_id, row_id, office_index, field, value): what to apply.

    A chosen null or blank applies nothing; without a choice the first candidate applies.
    """
    c = choices.select("preview_row_id", "field", F.struct(nullable("value").alias("v")).alias("chosen"))
    out = changes.join(c, ["preview_row_id", "field"], "left")
    value = F.when(F.col("chosen").isNotNull(), F.col("chosen.v")).otherwise(F.col("after"))
    return out.select("preview_row_id", "row_id", "office_index", "field", value.alias("value")).where("value IS NOT NULL")


def _wide(values: DataFrame, names: list[str]) -> DataFrame:
    return values.groupBy("preview_row_id", "row_id", "office_index").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"new_{f}") for f in names]
    )


def merge_candidates(companies: DataFrame, values: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Companies with the chosen values of their first office.

    Name and site are filled only where blank, the name also where ``forced`` has the row; other
    fields take the chosen value. Further offices are appended as copies of the row with their values
    and no id; see ``assign_missing_ids``.
    """
    names = [f for f in (*MANY, *ONE) if f in companies.columns]
    wide = _wide(values, names)
    first = wide.where("office_index = 0").drop("preview_row_id", "office_index").withColumnRenamed("row_id", "id")
    rows = companies.join(first, "id", "left")
    force = F.lit(False)
    if forced is not None:
        rows = rows.join(forced.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
        force = F.coalesce("_f", F.lit(False))
    empty = lambda f: F.trim(F.coalesce(F.col(f), F.lit(""))) == ""

    def merged(f: str) -> Column:
        new = F.coalesce(f"new_{f}", f)
        if f not in FILL_ONLY:
            return new
        return F.when(empty(f) | (force if f == "company" else F.lit(False)), new).otherwise(F.col(f))

    updated = rows.withColumns({f: merged(f) for f in names}).select(*companies.columns)
    return updated.unionByName(insert_offices(companies, wide, names))


def insert_offices(companies: DataFrame, wide: DataFrame, names: list[str]) -> DataFrame:
    """A copy of the stored row for each further office, with the chosen values in place, and no id."""
    more = wide.where("office_index > 0").join(companies.withColumnRenamed("id", "row_id"), "row_id")
    made = more.withColumns({f: F.coalesce(f"new_{f}", f) for f in names} | {"id": F.lit(None).cast("long")})
    return made.select(*companies.columns)


def merge_counts(preview: DataFrame, values: DataFrame, companies: DataFrame) -> DataFrame:
    """Processed, updated and skipped preview rows of a merge: a row without a value or a stored row is skipped."""
    has = values.select("preview_row_id").distinct().withColumn("v", F.lit(1))
    there = companies.select(F.col("id").alias("row_id"), F.lit(1).alias("c"))
    rows = preview.join(has, "preview_row_id", "left").join(there, "row_id", "left")
    good = F.col("v").isNotNull() & F.col("c").isNotNull()
    return rows.agg(F.count("*").alias("processed"), F.count_if(good).alias("updated"), F.count_if(~good).alias("skipped"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = PREVIEW_KEY, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of new rows with equal keys the last by ``order``."""
    if order is not None:
        last = F.max_by(F.struct(*new.columns), F.col(order)).alias("r")
        new = new.groupBy(*keys).agg(last).select("r.*")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def delete_processed(preview: DataFrame, processed: DataFrame) -> DataFrame:
    """Preview rows that have not been merged."""
    return preview.join(processed.select("preview_row_id"), "preview_row_id", "left_anti")


def apply_inspection_changes(companies: DataFrame, changes: DataFrame, column: str = "representative_name") -> DataFrame:
    """Names updated (trimmed; a blank one is no update) or deleted by row id."""
    ch = changes.select(F.col("row_id").alias("id"), "action", F.nullif(js_trim(F.coalesce("after_value", F.lit(""))), F.lit("")).alias("_new"))
    out = companies.join(ch, "id", "left")
    value = F.when(F.col("action") == "delete", None).when(F.col("action") == "update", F.coalesce("_new", column)).otherwise(F.col(column))
    return out.withColumn(column, value).select(*companies.columns)


def changes_with_companies(changes: DataFrame, companies: DataFrame, column: str = "representative_name") -> DataFrame:
    """Each change beside its company's present value; a change whose company is gone has none and is not ``found``."""
    now = companies.select(F.col("id").alias("row_id"), F.col(column).alias("present_value"), F.lit(True).alias("found"))
    out = changes.join(now, "row_id", "left")
    return out.withColumns({"found": F.coalesce("found", F.lit(False)), "stale": ~F.col("present_value").eqNullSafe(F.col("before_value"))})
