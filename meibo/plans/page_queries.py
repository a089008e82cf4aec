"""Queries of pages: the driver's pages, and pages built from the company view, whose values must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.operators import lines
from meibo.operators import pages as p
from meibo.operators import paths as paths_of
from meibo.plans.text_queries import CAPITAL, EMPLOYEE_COUNT, ESTABLISHED, FAX, PHONE, ZIP, core_sql, likely_sql
from meibo.schema import companies, dealt_companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def page_query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/pages.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_SPACE = lambda c: f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace({c}, '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '[\\r\\n\\t]', ' ', 'g'), '[\\s　]{{2,}}', ' ', 'g'))"
_SPACED = lambda c: _SPACE(c).replace("{{", "{").replace("}}", "}")
_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<br\\s*/?>|</(p|div|section|article|li|ul|ol|tr|td|th|dd|dt|h1|h2|h3|h4|h5|h6)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"
page_query("page_title", f"SELECT page_id, {_SPACED("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")(
    lambda d: d.select("page_id", p.page_title("html").alias("title"))
)
page_query("page_h1", f"SELECT page_id, {_SPACED("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1 FROM pages")(
    lambda d: d.select("page_id", p.page_h1("html").alias("h1"))
)
page_query("strip_html", f"SELECT page_id, {_SPACED(_BARE)} AS text FROM pages")(lambda d: d.select("page_id", p.strip_html("html").alias("text")))
page_query(
    "strip_html_lines",
    f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BARE}, chr(10)), lambda l: {_SPACED('l')}), lambda l: l <> ''), chr(10)) AS lines FROM pages",
)(lambda d: d.select("page_id", p.strip_html_lines("html").alias("lines")))
page_query(
    "page_flags",
    "SELECT page_id, regexp_matches(html, '(?is)<form\\b.*?</form>') AS has_form, html LIKE '%<footer%' AS has_footer, nullif(regexp_extract(html, '(?is)<meta[^>]+name=\"description\"[^>]+content=\"(.*?)\"', 1), '') AS description FROM pages",
)(lambda d: p.with_footer(d).select("page_id", p.has_form("html").alias("has_form"), (F.col("footer") != "").alias("has_footer"), p.meta_description("html").alias("description")))
page_query(
    "extract_links",
    """WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]+)"', 1), 1) AS k FROM pages)
    SELECT page_id, split_part(site || href, '#', 1) AS link, first(label ORDER BY k) AS label FROM l GROUP BY 1, 2""",
)(lambda d: p.extract_links(d, "page_id").select("page_id", "link", F.col("label")))
_SCORED = lambda words: " + ".join(f"CASE WHEN regexp_matches(t, '(?i){w}') THEN {n} ELSE 0 END" for w, n in words)
_LINKS = """SELECT page_id, split_part(site || href, '#', 1) AS link, first(label ORDER BY k) AS label, min(k) AS k FROM (
      SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]+)"', 1), 1) AS k FROM pages) GROUP BY 1, 2"""


def _ranked(nested: bool) -> str:
    """The SQL of ``rank_pages`` over the pages' links, all of which are of their own sites."""

    def score(focus: str) -> str:
        low, first, later = p.LINK_LIMITS[focus]
        pdf = "regexp_matches(link, '(?i)\\.pdf(?:$|\\?)')"
        if focus == "employee_count":
            staff, jobs = (f"regexp_matches(t, '(?i){w}')" for w in (p.HEADCOUNT, p.RECRUIT))
            more = f"CASE WHEN {jobs} AND NOT {staff} THEN -250 ELSE 0 END + CASE WHEN {pdf} THEN CASE WHEN {staff} THEN 280 ELSE -240 END ELSE 0 END"
        else:
            more = f"CASE WHEN {pdf} THEN {20 if focus == 'representative' else -40} ELSE 0 END"
        return f"SELECT page_id, k, link, '{focus}' AS focus, {_SCORED(p.LINK_RULES[focus])} + {more} AS score, {low} AS low, {later if nested else first} AS most FROM l"

    every = " UNION ALL ".join(score(f) for f in p.LINK_LIMITS)
    return f"""WITH l AS (SELECT *, label || ' ' || url_decode(link) AS t FROM ({_LINKS}) WHERE NOT regexp_matches(link, '(?i){p.DENIED}'))
    SELECT page_id, focus, link, score, row_number() OVER (PARTITION BY page_id, focus ORDER BY score DESC, k) AS place FROM ({every}) WHERE score > low QUALIFY place <= most"""


page_query("rank_candidate_pages", _ranked(False))(lambda d: p.rank_pages(p.extract_links(d, "page_id"), "page_id"))
page_query("rank_nested_pages", _ranked(True))(lambda d: p.rank_pages(p.extract_links(d, "page_id"), "page_id", nested=True))


def _with_guessed() -> str:
    """The SQL of ``candidate_pages``: every path scored on its own, links and paths in either order."""

    def score(focus: str, rows: str) -> str:
        low, first, _ = p.LINK_LIMITS[focus]
        more = ""
        if focus == "employee_count":
            staff, jobs = (f"regexp_matches(t, '(?i){w}')" for w in (p.HEADCOUNT, p.RECRUIT))
            more = f" + CASE WHEN {jobs} AND NOT {staff} THEN -250 ELSE 0 END"
        return f"SELECT page_id, '{focus}' AS focus, link, k, guessed, {_SCORED(p.LINK_RULES[focus])}{more} AS score, {low} AS low, {first} AS most FROM ({rows})"

    paths = {f: ", ".join(f"({n}, '{path}')" for n, path in enumerate((*paths_of.COMMON_PATHS, *paths_of.FOCUS_PATHS[f]))) for f in p.LINK_LIMITS}
    real = " UNION ALL ".join(score(f, "SELECT *, label || ' ' || url_decode(link) AS t, false AS guessed FROM l") for f in p.LINK_LIMITS)
    made = " UNION ALL ".join(
        score(f, f"SELECT page_id, site || path AS link, k, path || ' ' || site || path AS t, true AS guessed FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM pages), (VALUES {v}) g(k, path)")
        for f, v in paths.items()
    )
    return f"""WITH l AS (SELECT * FROM ({_LINKS}) WHERE NOT regexp_matches(link, '(?i){p.DENIED}')), e AS (SELECT * FROM ({real}) WHERE score > low UNION ALL {made}),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id, focus ORDER BY guessed = (focus <> 'company_core'), score DESC, k) AS n FROM e),
    once AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY page_id, focus, link ORDER BY n) = 1)
    SELECT page_id, focus, link, score, row_number() OVER (PARTITION BY page_id, focus ORDER BY n) AS place, guessed FROM once QUALIFY place <= most"""


page_query("candidate_pages_guessed", _with_guessed())(lambda d: paths_of.candidate_pages(d, p.extract_links(d, "page_id"), "page_id"))
_TITLE, _H1 = (_SPACED(f"regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)") for t in ("title", "h1"))
_LINES = f"array_to_string(list_filter(list_transform(string_split({_BARE}, chr(10)), lambda l: {_SPACED('l')}), lambda l: l <> ''), chr(10))"
for _focus in ("company_core", "contact", "business_content", "permit"):
    page_query(f"link_score_{_focus}", f"SELECT page_id, {_SCORED(p.LINK_RULES[_focus])} AS score FROM (SELECT page_id, regexp_replace(url, '%[0-9A-F]{{2}}', '', 'g') AS t FROM pages)")(
        lambda d, f=_focus: d.withColumns({"link": F.col("url"), "label": F.lit(""), "same_origin": F.lit(True)}).select("page_id", p.link_score(f).alias("score"))
    )
page_query("page_boost", f"SELECT page_id, {_SCORED(((p.COMPANY, 40), (p.BUSINESS, 30), (p.CONTACT, 20), (p.STAFF, 25), (p.NEWS, -50), (p.RECRUIT, -40)))} AS boost FROM (SELECT page_id, url AS t FROM pages)")(
    lambda d: d.select("page_id", p.page_boost("url").alias("boost"))
)
# pages as they are, cut down to a few words, and refused
_CUT = "CASE page_id % 4 WHEN 0 THEN '<p>' || url || '</p>' WHEN 1 THEN '<p>Access denied</p><p>' || url || ' ' || url || ' ' || url || '</p>' WHEN 2 THEN html || '<p>please wait</p>' ELSE html END"
_THIN = f"(length({{0}}) < 80 OR (length({{0}}) < 500 AND regexp_matches({{0}}, '(?i){p.BLOCKED}')))"
page_query("thin_page_flag", f"SELECT page_id, {_THIN.format(_SPACED(_BARE))} AS thin FROM (SELECT page_id, {_CUT} AS html FROM pages)")(
    lambda d: d.select("page_id", F.expr(_CUT).alias("html")).select("page_id", p.thin_page("html").alias("thin"))
)
page_query(
    "build_page_record",
    f"""SELECT page_id, {_TITLE} AS title, {_H1} AS h1, {_SPACED(_BARE)} AS text, {_LINES} AS lines, nullif(regexp_extract(html, '(?is)<meta[^>]+name="description"[^>]+content="(.*?)"', 1), '') AS description,
    regexp_matches(html, '(?is)<form\\b.*?</form>') AS has_form, {_THIN.format(_SPACED(_BARE))} AS thin,
    {_SPACED("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<footer.*?</footer>'), '(?is)<script.*?</script>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')").replace("replace(replace(replace(", "replace(replace(replace(replace(replace(", 1).replace(", '&amp;', '&')", ", '&copy;', '©'), '&middot;', '·'), '&amp;', '&')", 1)} AS footer FROM pages""",
)(lambda d: p.build_page_record(d).select("page_id", "title", "h1", "text", "lines", "description", "has_form", "thin", "footer"))
page_query(
    "page_boosts",
    f"""SELECT page_id, {_SCORED(((lines.REP_STRONG_PAGE, 400), (lines.REP_ABOUT_PAGE, 260), (lines.REP_GREETING_PAGE, 240), (lines.REP_WEAK_PAGE, 120)))} AS representative,
    CASE WHEN NOT regexp_matches(t, '(?i){p.PHONE_NO_PAGE}') OR regexp_matches(t, '(?i){p.PHONE_PAGE}') THEN {_SCORED(((p.COMPANY, 140), (p.CONTACT, 80), (p.PHONE_PAGE, 180), (p.PHONE_NO_PAGE, -260)))} END AS phone,
    {_SCORED(((p.ADDRESS_PAGE, 340), (p.ADDRESS_NO_PAGE, -360)))} + {_SCORED(((p.ADDRESS_PAGE, 220), (p.LABELS["address"], 180), ("〒[ 　]*[0-9]{3}-?[0-9]{4}", 160))).replace("(t,", "(head,")} AS address
    FROM (SELECT page_id, url_decode(url) || ' ' || {_TITLE} || ' ' || {_H1} AS t, substr({_LINES}, 1, 4000) AS head FROM pages)""",
)(
    lambda d: d.select("page_id", F.concat_ws(" ", F.try_url_decode("url"), p.page_title("html"), p.page_h1("html")).alias("t"), p.strip_html_lines("html").alias("ls")).select(
        "page_id", lines.representative_boost(F.col("t")).alias("representative"), p.phone_page_boost(F.col("t")).alias("phone"), p.address_page_boost(F.col("t"), F.col("ls")).alias("address")
    )
)

# pages of the company view: a table, a list or lines by company, and a contact page
_ROWS = (("会社名", "company"), ("所在地", "address"), ("郵便番号", "zipcode"), ("電話番号", "phone"), ("FAX", "fax"), ("設立", "established_date"), ("資本金", "capital"), ("従業員数", "employee_count"))
_CELL = lambda a, b, c: " || ".join(f"'{a}{label}{b}' || coalesce({f}, '') || '{c}'" for label, f in _ROWS)
COMPANY_PAGES = f"""
SELECT id AS company_id, 0 AS page_seq, CAST(NULL AS string) AS focus, 'https://c' || cast(id AS string) || '.example.jp/' AS final_url,
 '<html><head><title>' || coalesce(company, 'home') || ' | ホーム</title></head><body><h1>' || coalesce(company, '') || '</h1>' ||
 CASE id % 3 WHEN 0 THEN '<table>' || {_CELL('<tr><th>', '</th><td>', '</td></tr>')} || '</table>' WHEN 1 THEN '<dl>' || {_CELL('<dt>', '</dt><dd>', '</dd>')} || '</dl>'
 ELSE {_CELL('<p>', '：', '</p>')} END || '<a href="/contact">お問い合わせ</a></body></html>' AS html FROM {{companies}}
UNION ALL SELECT id, 1, 'contact', 'https://c' || cast(id AS string) || '.example.jp/contact', '<html><body><form><p>送信</p></form><a href="mailto:c' || cast(id AS string) || '@example.jp">mail</a></body></html>' FROM {{companies}}
"""


def company_pages(spark, sf_dir):
    return spark.sql(COMPANY_PAGES, companies=dealt_companies(spark, sf_dir))


QUERIES["extract_pairs"] = lambda spark, sf_dir: p.extract_pairs(company_pages(spark, sf_dir), ["company_id", "page_seq"]).select("company_id", "page_seq", "label", "value")
_VALUE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s　]+', ' ', 'g'), ' ')"
ORACLES["extract_pairs"] = with_companies(
    " UNION ALL ".join(f"SELECT id AS company_id, 0 AS page_seq, '{label}' AS label, {_VALUE(f)} AS value FROM companies WHERE {_VALUE(f)} <> ''" for label, f in _ROWS)
)
_ROW_LINES = " UNION ALL ".join(f"SELECT id, {k} AS k, CASE id % 3 WHEN 2 THEN '{label}：' ELSE '' END || coalesce({f}, '') AS line FROM companies" for k, (label, f) in enumerate(_ROWS))
_CALLED = "regexp_replace(regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '[－ー―]', '-', 'g'), '[-\\s　]+', '-', 'g')"
for _kind, _words in p.NUMBER_LINES.items():
    QUERIES[f"contact_number_candidates_{_kind}"] = lambda spark, sf_dir, k=_kind: p.contact_numbers(company_pages(spark, sf_dir), k)
    _own = f"regexp_matches(line, '(?i){_words}')" + (f" AND NOT regexp_matches(line, '(?i){p.NUMBER_LINES['fax']}')" if _kind == "phone" else "")
    ORACLES[f"contact_number_candidates_{_kind}"] = with_companies(
        f"""SELECT id AS company_id, number, row_number() OVER (PARTITION BY id ORDER BY k, n) AS seq FROM (
        SELECT id, regexp_replace(number, '[^0-9]', '', 'g') AS digits, first(number ORDER BY k, n) AS number, min(k) AS k, arg_min(n, (k, n)) AS n FROM (
        SELECT id, k, n, {_CALLED} AS number FROM (SELECT id, k, unnest(regexp_extract_all(line, '{p.NUMBER}')) AS raw, generate_subscripts(regexp_extract_all(line, '{p.NUMBER}'), 1) AS n
        FROM ({_ROW_LINES}) WHERE {_own})) GROUP BY 1, 2)"""
    )
_REP = f"CASE WHEN NOT regexp_matches(replace({PHONE}, '-', ''), '^(070|080|090|050|020|0120|0570|0800)') THEN {PHONE} END"
# the page's first number of a postal code's shape, where the labelled one has none
_ALL = f"translate(concat_ws(' ', {', '.join(f for _, f in _ROWS)}), '０１２３４５６７８９', '0123456789')"
_ANY_ZIP = f"nullif(regexp_extract({_ALL}, '([0-9]{{3}})-?([0-9]{{4}})', 1), '') || '-' || regexp_extract({_ALL}, '([0-9]{{3}})-?([0-9]{{4}})', 2)"
QUERIES["extract_company_fields"] = lambda spark, sf_dir: p.extract_fields(company_pages(spark, sf_dir))
ORACLES["extract_company_fields"] = with_companies(
    f"""WITH core AS (SELECT id, CASE WHEN {likely_sql('t')} THEN t END AS core FROM ({core_sql("SELECT id, address FROM companies", "address")}))
    SELECT id AS company_id, nullif(trim(coalesce(company, ''), ' 　'), '') AS company, 'https://c' || id || '.example.jp/' AS website_url, 'https://c' || id || '.example.jp/contact' AS form_url,
    {_REP} AS phone, {FAX} AS fax, 'c' || id || '@example.jp' AS email, coalesce({ZIP}, {_ANY_ZIP}) AS zipcode, core AS address, {ESTABLISHED} AS established_date, {CAPITAL} AS capital,
    {EMPLOYEE_COUNT(f"'従業員数 ' || {_VALUE('employee_count')}")} AS employee_count, NULL::VARCHAR AS representative_name, NULL::VARCHAR AS business_content, NULL::VARCHAR AS permit_number
    FROM companies JOIN core USING (id)"""
)
QUERIES["best_value"] = lambda spark, sf_dir: p.best_of_pages(company_pages(spark, sf_dir))
ORACLES["best_value"] = f"UNPIVOT ({ORACLES['extract_company_fields']}) ON COLUMNS(* EXCLUDE (company_id)) INTO NAME field VALUE value"
# a page's candidates are its own alone and stand from page_seq * PAGE on, so that those from PAGE on are the candidates of the pages from 1 on
QUERIES["page_field_gate"] = lambda spark, sf_dir: p.candidates(company_pages(spark, sf_dir).where(F.col("page_seq") >= 1)).where(F.col("seq") >= p.PAGE).groupBy("field").agg(F.count("*").alias("n"))
ORACLES["page_field_gate"] = with_companies("SELECT unnest(['email', 'form_url']) AS field, (SELECT count(*) FROM companies) AS n")
QUERIES["dedupe_pages_by_final_url"] = lambda spark, sf_dir: p.first_pages(
    company_pages(spark, sf_dir).unionByName(company_pages(spark, sf_dir).withColumn("page_seq", F.col("page_seq") + 5))
).select("company_id", "page_seq", "final_url")
ORACLES["dedupe_pages_by_final_url"] = with_companies(
    "SELECT id AS company_id, k AS page_seq, 'https://c' || id || '.example.jp/' || CASE k WHEN 1 THEN 'contact' ELSE '' END AS final_url FROM companies, (VALUES (0), (1)) t(k)"
)
QUERIES["decode_page_bytes"] = lambda spark, sf_dir: p.decode_body(
    companies(spark, sf_dir).select("id", F.encode(F.concat(F.lit("<p>会社の住所 "), F.col("address")), "UTF-8").alias("body"), F.lit("text/html").alias("content_type"))
).select("id", "html")
ORACLES["decode_page_bytes"] = with_companies("SELECT id, '<p>会社の住所 ' || address AS html FROM companies")


def _office_pages(spark, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html").unionByName(company_pages(spark, sf_dir).select(F.col("final_url").alias("url"), "html"))
    target = F.concat_ws(" ", F.try_url_decode("url"), p.page_title("html"), p.page_h1("html"))
    return every.select("url", p.office_page(target, p.strip_html_lines("html")).alias("office_page"))


QUERIES["office_page_select"] = _office_pages
ORACLES["office_page_select"] = with_companies(
    f"""SELECT url, regexp_matches(url_decode(url) || ' ' || {_TITLE} || ' ' || {_H1}, '(?i){p.CONTACT}|{p.COMPANY}')
    OR regexp_matches(substr({_LINES}, 1, 4000), '(?i){p.OFFICE_LINES}') AS office_page FROM pages
    UNION ALL SELECT 'https://c' || id || '.example.jp/' || page, true FROM companies, (VALUES (''), ('contact')) t(page)"""
)
