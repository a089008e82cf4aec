"""Queries of the company list: derived columns, filters, facets, pages, duplicates, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import derive
from meibo.operators import dedupe, filters, listing
from meibo.operators.filters import AdvancedFilter, FieldFilter, Range, Request
from meibo.plans import oracle as o
from meibo.schema import COLUMN_OF, FIELDS, NAMES, PREFECTURES, companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the companies as a query, with SQL over the view ``companies``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(companies(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_companies(sql)
        return f

    return add


query("project_list_row", f"SELECT {', '.join(f'{f} AS \"{COLUMN_OF[f]}\"' for f in NAMES)} FROM companies")(
    lambda c: c.select(*[F.col(f).alias(COLUMN_OF[f]) for f in NAMES])
)
query("rename_table_to_csv", f"SELECT {', '.join(f'{f} AS \"{h}\"' for f, _, h in FIELDS)} FROM companies")(
    lambda c: c.select(*[F.col(f).alias(h) for f, _, h in FIELDS])
)
for _name, _make, _sql in (
    ("prefecture", derive.prefecture, o.PREF),
    ("city", derive.city, o.CITY),
    ("established_ym", derive.established_ym, o.YM),
    ("industry_parent", derive.industry_parent, o.INDUSTRY),
):
    query(_name, f"SELECT id, {_sql} AS {_name} FROM companies")(lambda c, m=_make, n=_name: c.select("id", m().alias(n)))
query("region_of", f"SELECT id, {o.REGION} AS region FROM (SELECT id, {o.PREF} AS prefecture FROM companies)")(
    lambda c: c.select("id", derive.region(derive.prefecture()).alias("region"))
)
for _name, _make, _sql in (("capital_numeric", derive.capital_numeric, o.CAPITAL), ("employee_numeric", derive.employee_numeric, o.EMPLOYEES)):
    query(_name, f"SELECT id, cast({_sql} AS double) AS {_name} FROM companies")(
        lambda c, m=_make, n=_name: c.select("id", m().cast("double").alias(n))
    )
query("split_tags", f"SELECT id, array_to_string({o.TAGS}, '/') AS tags FROM companies")(
    lambda c: c.select("id", F.array_join(derive.tags(), "/").alias("tags"))
)
query("tag_lateral_explode", f"SELECT id, unnest({o.TAGS}) AS tag FROM companies")(listing.explode_tags)
query("tag_parent", f"SELECT DISTINCT tag, {o.TAG_PARENT} AS parent FROM (SELECT unnest({o.TAGS}) AS tag FROM companies)")(
    lambda c: listing.explode_tags(c).select("tag").distinct().withColumn("parent", derive.tag_parent(F.col("tag")))
)
query(
    "enrich_companies",
    f"""SELECT id, prefecture, {o.REGION} AS region, city, ym, capital, employees, parent, tags FROM (
    SELECT id, {o.PREF} AS prefecture, {o.CITY} AS city, {o.YM} AS ym, cast({o.CAPITAL} AS double) AS capital,
      cast({o.EMPLOYEES} AS double) AS employees, {o.INDUSTRY} AS parent, array_to_string({o.TAGS}, '/') AS tags FROM companies)""",
)(
    lambda c: derive.enrich_companies(c).select(
        "id", "prefecture", "region", "city", F.col("established_ym").alias("ym"), F.col("capital_numeric").cast("double").alias("capital"),
        F.col("employee_numeric").cast("double").alias("employees"), F.col("industry_parent").alias("parent"), F.array_join("tags", "/").alias("tags"),
    )
)

# conditions: the rows that each lets through
_CONDITIONS = {
    "cond_contains": ("company", FieldFilter("contains", "空"), "coalesce(company, '') ILIKE '%空%'"),
    "cond_not_contains": ("company", FieldFilter("not_contains", "株式会社青"), "coalesce(company, '') NOT ILIKE '%株式会社青%'"),
    "cond_equals": ("closing_month", FieldFilter("equals", "3月"), "coalesce(closing_month, '') = '3月'"),
    "cond_not_equals": ("closing_month", FieldFilter("not_equals", "3月"), "coalesce(closing_month, '') <> '3月'"),
    "cond_starts_with": ("email", FieldFilter("starts_with", "C1"), "coalesce(email, '') ILIKE 'C1%'"),
    "cond_ends_with": ("email", FieldFilter("ends_with", "@EXAMPLE.jp"), "coalesce(email, '') ILIKE '%@EXAMPLE.jp'"),
    "cond_wildcard": ("memo", FieldFilter("contains", "0%メ"), "coalesce(memo, '') ILIKE '%0%メ%'"),
    "cond_is_empty": ("company", FieldFilter("is_empty", "x"), o.BLANK.format("company")),
    "cond_is_not_empty": ("company", FieldFilter("is_not_empty"), f"NOT ({o.BLANK.format('company')})"),
    "value_filter": ("small_industry", FieldFilter(values_on=True, values=("食品", " 病院 ", "")), f"(small_industry IN ('食品', '病院') OR {o.BLANK.format('small_industry')})"),
    "value_filter_empty": ("small_industry", FieldFilter(values_on=True), "false"),
}
for _name, (_field, _filter, _where) in _CONDITIONS.items():
    query(_name, f"SELECT id, {_field} FROM companies WHERE {_where}")(
        lambda c, k=_field, f=_filter: filters.filter_companies(c, Request({k: f})).select("id", k)
    )
query(
    "blank_rules",
    f"SELECT id, {o.BLANK.format('company')} AS blank, trim(coalesce(company, ''), ' ') = '' AS blank_strict FROM companies",
)(lambda c: c.select("id", filters.blank("company").alias("blank"), filters.blank("company", strict_space=True).alias("blank_strict")))

_FIELDS = {
    "company": FieldFilter("contains", "株式会社"),
    "closing_month": FieldFilter(values_on=True, values=("1月", "2月", "3月", "4月")),
    "email": FieldFilter("is_not_empty"),
}
_FIELDS_SQL = f"company ILIKE '%株式会社%' AND closing_month IN ('1月', '2月', '3月', '4月') AND NOT ({o.BLANK.format('email')})"
query("filter_model_and", f"SELECT id FROM companies WHERE {_FIELDS_SQL}")(lambda c: filters.filter_companies(c, Request(_FIELDS)).select("id"))
query(
    "filter_model_skip",
    f"SELECT id FROM companies WHERE company ILIKE '%株式会社%' AND NOT ({o.BLANK.format('email')})",
)(lambda c: c.where(filters.predicate(Request(_FIELDS), skip="closing_month")).select("id"))
_D = f"(SELECT *, {o.PREF} AS prefecture, {o.CITY} AS city, {o.YM} AS ym, {o.CAPITAL} AS cap, {o.EMPLOYEES} AS emp, {o.TAGS} AS tags FROM companies)"
_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_KANTO = _QUOTED(("茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県"))
_ADVANCED = {
    "adv_company_keyword": (AdvancedFilter(company=" 大和 "), "company ILIKE '%大和%'"),
    "adv_location": (
        AdvancedFilter(regions=("関東",), prefectures=("大阪府",), cities=("四日市",)),
        f"(prefecture IN ({_KANTO}) OR prefecture IN ('大阪府') OR city IN ('四日市'))",
    ),
    "adv_industry": (AdvancedFilter(big_industries=("製造業",), small_industries=("病院",)), "(big_industry = '製造業' OR small_industry = '病院')"),
    "adv_established": (
        AdvancedFilter(years=("1990",), months=("200204",), month_from="199003", month_to="200312"),
        "(substr(ym, 1, 4) = '1990' OR ym = '200204') AND ym >= '199003' AND ym <= '200312'",
    ),
    "adv_numeric_range": (AdvancedFilter(capital=Range("1,000", "bad"), employees=Range(10, "500")), "cap >= 1000 AND emp >= 10 AND emp <= 500"),
    "adv_tags": (
        AdvancedFilter(tags=("物流",), tag_parents=("採用媒体",)),
        f"len(list_filter(tags, lambda tag: tag = '物流' OR {o.TAG_PARENT} = '採用媒体')) > 0",
    ),
}
for _name, (_filter, _where) in _ADVANCED.items():
    query(_name, f"SELECT id FROM {_D} WHERE {_where}")(lambda c, f=_filter: filters.filter_companies(c, Request(advanced=f)).select("id"))
query("tag_exists", f"SELECT id FROM {_D} WHERE len(list_filter(tags, lambda tag: tag IN ('IT', '大学'))) > 0")(
    lambda c: filters.filter_companies(c, Request(advanced=AdvancedFilter(tags=("IT", "大学")))).select("id")
)
_SCOPE = Request(advanced=AdvancedFilter(regions=("関東",)))
_SCOPED = f"prefecture IN ({_KANTO}) AND company ILIKE '%株式会社%'"
query("list_scope_filter", f"SELECT id FROM {_D} WHERE {_SCOPED}")(
    lambda c: filters.filter_companies(c, Request({"company": FieldFilter("contains", "株式会社")}), _SCOPE).select("id")
)
query("total_count", f"SELECT count(*) AS total FROM companies WHERE {_FIELDS_SQL}")(lambda c: listing.total_count(c, Request(_FIELDS)))
query("inspection_targets", f"SELECT id, representative_name FROM companies WHERE company ILIKE '%光%' AND NOT ({o.BLANK.format('representative_name')})")(
    lambda c: filters.inspection_targets(c, Request({"company": FieldFilter("contains", "光")})).select("id", "representative_name")
)
query(
    "value_filter_long_list",
    "SELECT id, email FROM companies WHERE trim(coalesce(email, ''), ' ') IN (SELECT 'c' || cast(id AS varchar) || '@example.jp' FROM companies WHERE id % 7 = 0)",
)(
    lambda c: filters.filter_by_values(
        c, "email", c.where("id % 7 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@example.jp")).alias("v"))
    ).select("id", "email")
)

# order and pages
_ORDER = "coalesce({0}, '') {1}, coalesce(company, ''), coalesce(address, ''), id"
query(
    "list_order",
    f"SELECT id, company, address FROM companies ORDER BY {_ORDER.format('established_date', 'DESC')} LIMIT 50",
)(lambda c: c.orderBy(*listing.list_order("established_date", True)).limit(50).select("id", "company", "address"))
query("page_of_rows", f"SELECT id, {', '.join(NAMES)} FROM companies ORDER BY {_ORDER.format('closing_month', 'ASC')} LIMIT 40 OFFSET 80")(
    lambda c: listing.page_of_rows(c, page=3, size=40, sort="closing_month")
)

# facets
_CONTAINS = Request({"company": FieldFilter("contains", "株式会社"), "closing_month": FieldFilter("equals", "3月")})
query(
    "facet_values",
    "SELECT coalesce(closing_month, '') AS value, count(*) AS n FROM companies WHERE coalesce(company, '') ILIKE '%株式会社%' GROUP BY 1 HAVING coalesce(closing_month, '') ILIKE '%1%'",
)(lambda c: listing.facet_values(c, "closing_month", _CONTAINS, "1"))
query("facet_page", "SELECT value, n FROM (SELECT coalesce(address, '') AS value, count(*) AS n FROM companies GROUP BY 1) ORDER BY value LIMIT 20 OFFSET 10")(
    lambda c: listing.facet_page(listing.facet_values(c, "address", Request()), 10, 20)
)
query(
    "facet_summary",
    """WITH f AS (SELECT coalesce(small_industry, '') AS value, count(*) AS n FROM companies GROUP BY 1)
    SELECT count(*) FILTER (value ILIKE '%品%' OR value ILIKE '%品%') AS n_values,
      coalesce(sum(n) FILTER (value ILIKE '%品%'), 0)::BIGINT AS n_matched, coalesce(sum(n) FILTER (trim(value, ' ') <> ''), 0)::BIGINT AS n_filled,
      coalesce(sum(n) FILTER (value IN ('食品', '病院')), 0)::BIGINT AS n_checked, count(*) FILTER (value ILIKE '%品%') > 200 AS has_more FROM f""",
)(lambda c: listing.facet_summary(c, "small_industry", Request(), "品", ["食品", "病院", " "]))
_PLACE = "list_position([" + _QUOTED(PREFECTURES) + "], prefecture)::INT"
query(
    "facet_prefecture_city",
    f"""WITH s AS (SELECT prefecture, city, count(*) AS n FROM {_D} WHERE prefecture IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT prefecture, NULL AS city, sum(n)::BIGINT AS n FROM s GROUP BY 1 UNION ALL SELECT prefecture, city, n FROM s WHERE city IS NOT NULL)
    SELECT {o.REGION} AS region, {_PLACE} AS place, prefecture, city, n FROM u""",
)(listing.facet_prefecture_city)
query(
    "facet_industry",
    f"""WITH s AS (SELECT trim(coalesce(big_industry, ''), ' ') AS big, trim(coalesce(small_industry, ''), ' ') AS small, count(*) AS n FROM companies GROUP BY 1, 2),
    u AS (SELECT big, NULL AS small, sum(n)::BIGINT AS n FROM s WHERE big <> '' GROUP BY 1 UNION ALL SELECT big, small, n FROM s WHERE big <> '' AND small <> '')
    SELECT big, small, n, {o.rules('big', derive.INDUSTRY_RULES, derive.OTHER)} AS parent FROM u""",
)(listing.facet_industry)
query(
    "facet_established",
    f"SELECT substr(ym, 1, 4) AS year, array_to_string(list_sort(list(DISTINCT substr(ym, 5, 2))), ',') AS months FROM {_D} WHERE ym IS NOT NULL GROUP BY 1",
)(listing.facet_established)
query(
    "facet_tags",
    f"""WITH s AS (SELECT tag, count(*) AS n, {o.TAG_PARENT} AS parent FROM (SELECT unnest({o.TAGS}) AS tag FROM companies) GROUP BY tag)
    SELECT tag, n, parent, (sum(n) OVER (PARTITION BY parent))::BIGINT AS parent_n FROM s""",
)(listing.facet_tags)

# duplicates, numbers, changes
_RN = "row_number() OVER (PARTITION BY trim(coalesce(company, ''), ' ') ORDER BY {0})"
query("dedupe_keep_first", f"SELECT id, company FROM companies QUALIFY trim(coalesce(company, ''), ' ') = '' OR {_RN.format('id')} = 1")(
    lambda c: dedupe.keep_first(c, "company", ["id"]).select("id", "company")
)
query("dedupe_delete_join", f"SELECT id, company FROM companies QUALIFY NOT (trim(coalesce(company, ''), ' ') <> '' AND {_RN.format('id')} > 1)")(
    lambda c: dedupe.dedupe_companies(c, "company").select("id", "company")
)
query(
    "dedupe_filtered_scope",
    f"""WITH d AS (SELECT id FROM companies WHERE closing_month IN ('1月', '2月') QUALIFY trim(coalesce(company, ''), ' ') <> '' AND {_RN.format('id')} > 1)
    SELECT id FROM companies WHERE id NOT IN (SELECT id FROM d)""",
)(lambda c: dedupe.dedupe_companies(c, "company", Request({"closing_month": FieldFilter(values_on=True, values=("1月", "2月"))})).select("id"))
query(
    "export_dedupe_keep_first",
    f"""WITH r AS (SELECT id, company, trim(regexp_replace(coalesce(company, ''), '　', '', 'g'), ' ') AS k, row_number() OVER (PARTITION BY trim(regexp_replace(coalesce(company, ''), '　', '', 'g'), ' ')
      ORDER BY {_ORDER.format('established_date', 'ASC')}) AS n FROM companies)
    SELECT id, company FROM r WHERE k = '' OR n = 1""",
)(
    lambda c: dedupe.keep_first(
        c.select("id", "company", *[derive.text(x).alias(f"o{k}") for k, x in enumerate(("established_date", "company", "address"))]),
        "company", ["o0", "o1", "o2", "id"], unicode_trim=True,
    ).select("id", "company")
)
query(
    "target_index",
    f"SELECT id, row_number() OVER (ORDER BY {_ORDER.format('established_date', 'ASC')}) - 1 AS target_index FROM companies",
)(lambda c: dedupe.number_rows(c, listing.list_order("established_date"), "target_index").select("id", "target_index"))
query(
    "assign_missing_ids",
    """WITH m AS (SELECT max(id) AS top FROM companies WHERE id % 3 <> 0)
    SELECT count(*) AS n, count(DISTINCT id) AS n_ids, max(id) AS top FROM (SELECT id FROM companies WHERE id % 3 <> 0
      UNION ALL SELECT row_number() OVER (ORDER BY c.id) + m.top FROM companies c, m WHERE c.id % 3 = 0)""",
)(
    lambda c: dedupe.assign_missing_ids(c.select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), "company")).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.max("id").alias("top")
    )
)
query("delete_rows", f"SELECT id FROM companies WHERE NOT coalesce({_FIELDS_SQL}, false)")(lambda c: dedupe.delete_rows(c, Request(_FIELDS)).select("id"))
query(
    "null_fields",
    "SELECT id, CASE WHEN NOT (coalesce(company, '') ILIKE '%大和%') THEN memo END AS memo, CASE WHEN NOT (coalesce(company, '') ILIKE '%大和%') THEN email END AS email FROM companies",
)(lambda c: dedupe.null_fields(c, ["memo", "email"], Request({"company": FieldFilter("contains", "大和")})).select("id", "memo", "email"))

# the same within a user's stored scope
_IN = f"(SELECT * FROM {_D} WHERE prefecture IN ({_KANTO}))"
query("facet_values_scoped", f"SELECT coalesce(closing_month, '') AS value, count(*) AS n FROM {_IN} WHERE coalesce(company, '') ILIKE '%株式会社%' GROUP BY 1")(
    lambda c: listing.facet_values(c, "closing_month", _CONTAINS, scope=_SCOPE)
)
query(
    "facet_summary_scoped",
    f"""WITH f AS (SELECT coalesce(small_industry, '') AS value, count(*) AS n FROM {_IN} GROUP BY 1)
    SELECT count(*) AS n_values, sum(n)::BIGINT AS n_matched, coalesce(sum(n) FILTER (trim(value, ' ') <> ''), 0)::BIGINT AS n_filled,
      coalesce(sum(n) FILTER (trim(value, ' ') <> ''), 0)::BIGINT AS n_checked, count(*) > 200 AS has_more FROM f""",
)(lambda c: listing.facet_summary(c, "small_industry", Request(), scope=_SCOPE))
query(
    "facet_prefecture_city_scoped",
    f"""WITH s AS (SELECT prefecture, city, count(*) AS n FROM {_IN} GROUP BY 1, 2),
    u AS (SELECT prefecture, NULL AS city, sum(n)::BIGINT AS n FROM s GROUP BY 1 UNION ALL SELECT prefecture, city, n FROM s WHERE city IS NOT NULL)
    SELECT {o.REGION} AS region, {_PLACE} AS place, prefecture, city, n FROM u""",
)(lambda c: listing.facet_prefecture_city(c, scope=_SCOPE))
query(
    "facet_industry_scoped",
    f"""WITH s AS (SELECT trim(coalesce(big_industry, ''), ' ') AS big, trim(coalesce(small_industry, ''), ' ') AS small, count(*) AS n FROM {_IN} GROUP BY 1, 2),
    u AS (SELECT big, NULL AS small, sum(n)::BIGINT AS n FROM s WHERE big <> '' GROUP BY 1 UNION ALL SELECT big, small, n FROM s WHERE big <> '' AND small <> '')
    SELECT big, small, n, {o.rules('big', derive.INDUSTRY_RULES, derive.OTHER)} AS parent FROM u""",
)(lambda c: listing.facet_industry(c, scope=_SCOPE))
query(
    "facet_established_scoped",
    f"SELECT substr(ym, 1, 4) AS year, array_to_string(list_sort(list(DISTINCT substr(ym, 5, 2))), ',') AS months FROM {_IN} WHERE ym IS NOT NULL GROUP BY 1",
)(lambda c: listing.facet_established(c, scope=_SCOPE))
query(
    "facet_tags_scoped",
    f"""WITH s AS (SELECT tag, count(*) AS n, {o.TAG_PARENT} AS parent FROM (SELECT unnest(tags) AS tag FROM {_IN}) GROUP BY tag)
    SELECT tag, n, parent, (sum(n) OVER (PARTITION BY parent))::BIGINT AS parent_n FROM s""",
)(lambda c: listing.facet_tags(c, scope=_SCOPE))
query(
    "dedupe_user_scope",
    f"""WITH d AS (SELECT id FROM {_IN} QUALIFY trim(coalesce(company, ''), ' ') <> '' AND {_RN.format('id')} > 1)
    SELECT id FROM companies WHERE id NOT IN (SELECT id FROM d)""",
)(lambda c: dedupe.dedupe_companies(c, "company", scope=_SCOPE).select("id"))
query(
    "null_fields_scoped",
    f"SELECT id, CASE WHEN NOT (coalesce(company, '') ILIKE '%大和%' AND coalesce(prefecture IN ({_KANTO}), false)) THEN email END AS email FROM {_D}",
)(lambda c: dedupe.null_fields(c, ["email"], Request({"company": FieldFilter("contains", "大和")}), _SCOPE).select("id", "email"))
query("list_order_all", f"SELECT id, company, row_number() OVER (ORDER BY {_ORDER.format('established_date', 'DESC')}) AS place FROM companies")(
    lambda c: dedupe.number_rows(c, listing.list_order("established_date", True), "place", 1).select("id", "company", "place")
)


def _third_page(spark, sf_dir):
    """The third page of 50 rows by what comes after the last row of the second."""
    df = companies(spark, sf_dir)
    last = None
    for _ in range(2):
        last = listing.page_after(df, last, 50, "tag", descending=True).tail(1)[0].asDict()
    return listing.page_after(df, last, 50, "tag", descending=True).select("id", "tag", "company")


QUERIES["page_after"] = _third_page
ORACLES["page_after"] = with_companies("SELECT id, tag, company FROM companies ORDER BY coalesce(tag, '') DESC, coalesce(company, ''), coalesce(address, ''), id LIMIT 50 OFFSET 100")
