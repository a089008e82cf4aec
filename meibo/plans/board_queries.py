"""Queries of job-board pages built from the company view, whose values must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.operators import jobboard as j
from meibo.schema import dealt_companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BOARD = """
SELECT id, 'https://board.example.jp/' || cast(id AS string) || '/outline.html' AS url,
 '<div class="heading1"><h1>' || coalesce(company, '') || '</h1></div><div class="category"><ul><li><span>' || big_industry || '</span></li><li><span>' || small_industry || '</span></li></ul></div><table>' ||
 '<tr><th>本社 所在地</th><td>' || address || '</td></tr><tr><th>本社所在地</th><td>別</td></tr><tr><th>創業：</th><td>' || coalesce(established_date, '') || '</td></tr><tr><th>資本金</th><td>' || capital || '</td></tr>' ||
 '<tr><th>社員数</th><td>' || employee_count || '</td></tr><tr><th>ホームページ</th><td><a href="https://x.com/a">x</a> <a href="https://c' || cast(id AS string) || '.example.jp/">site</a></td></tr>' ||
 '<tr id="school"><th>学校</th><td>大学' || cast(id % 9 AS string) || ' もっと見る</td></tr></table>' AS html FROM {companies}
"""
CONTACTS = """
SELECT id, k AS page, '<table><tr><th>x</th><td>y</td></tr></table><table><tr><th>問合せ先</th><td>' || CASE WHEN k = 0 AND id % 2 = 0 THEN '' ELSE '人事 ' || cast(k AS string) || ' m' || cast(id AS string) || '@example.jp' END || '</td></tr>' ||
 CASE WHEN id % 3 = 0 AND k = 1 THEN '<tr><th>E-MAIL</th><td>mail' || cast(id AS string) || '@example.jp</td></tr>' ELSE '' END || '</table>' AS html FROM (SELECT id, 0 AS k FROM {companies} UNION ALL SELECT id, 1 AS k FROM {companies})
"""


def query(name: str, made: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.sql(made, companies=dealt_companies(spark, sf_dir)))
        ORACLES[name] = with_companies(sql)
        return f

    return add


_T = lambda c: f"trim(coalesce({c}, ''), ' 　')"
query(
    "outline_record",
    BOARD,
    f"""SELECT id, {_T('company')} AS name, {_T('address')} AS address, {_T('established_date')} AS founded, {_T('capital')} AS capital, {_T('employee_count')} AS employees,
    'https://c' || id || '.example.jp/' AS site, array_to_string(list_filter([{_T('big_industry')}, {_T('small_industry')}], lambda v: v <> ''), ' / ') AS kinds, '大学' || (id % 9) AS school FROM companies""",
)(
    lambda d: j.outline_record(d).select(
        F.regexp_extract("元URL", "([0-9]+)", 1).cast("long").alias("id"), F.col("会社名").alias("name"), F.col("本社所在地").alias("address"), F.col("設立").alias("founded"),
        F.col("資本金").alias("capital"), F.col("従業員").alias("employees"), F.col("URL").alias("site"), F.col("業種").alias("kinds"), F.col("`採用実績（学校）`").alias("school"),
    )
)
query(
    "outline_rows",
    BOARD,
    f"SELECT id, '資本金' AS key, {_T('capital')} AS value FROM companies",
)(lambda d: d.select("id", F.explode_outer(j.table_rows("html")).alias("r")).where("r.key = '資本金'").select("id", "r.key", "r.value"))
query(
    "merge_contact_maps",
    CONTACTS,
    "SELECT id, '問合せ先' AS label, '人事 ' || CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END || ' m' || id || '@example.jp' AS value FROM companies UNION ALL SELECT id, 'E-MAIL', 'mail' || id || '@example.jp' FROM companies WHERE id % 3 = 0",
)(lambda d: j.merge_contacts(j.contact_rows(d, ["id", "page"]), "id", "page"))
query(
    "contact_fields",
    CONTACTS,
    "SELECT id, '人事 ' || CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END || ' m' || id || '@example.jp' AS contact, '' AS access, CASE WHEN id % 3 = 0 THEN 'mail' || id || '@example.jp' ELSE 'm' || id || '@example.jp' END AS mail FROM companies",
)(lambda d: j.contact_fields(j.merge_contacts(j.contact_rows(d, ["id", "page"]), "id", "page"), "id"))
query("is_probable_company_url", "SELECT id, website_url AS u FROM {companies}", "SELECT id, coalesce(website_url LIKE 'https://%', false) AS own FROM companies")(
    lambda d: d.select("id", j.company_url(F.col("u")).alias("own"))
)
query(
    "result_count_pages",
    "SELECT id, '<p>企業検索結果 <b>' || format_number(id * 13, 0) || '</b> 社</p>' AS html FROM {companies}",
    "SELECT id, (id * 13)::INT AS total, ceil(id * 13 / 100)::INT AS pages FROM companies",
)(lambda d: d.select("id", j.result_count("html").alias("r")).select("id", "r.total", "r.pages"))
query("company_url_first_page", "SELECT 'u' || cast(id % 50 AS string) AS url, cast(id % 7 AS int) AS page FROM {companies}", "SELECT 'u' || (id % 50) AS url, min(id % 7)::INT AS page FROM companies GROUP BY 1")(
    lambda d: j.first_page_of(d)
)
query(
    "merge_offices",
    """SELECT id % 100 AS company_id, id AS seq, CASE id % 3 WHEN 0 THEN '本社' WHEN 1 THEN NULL ELSE '支店' END AS office_name, CAST(NULL AS string) AS company, array(address) AS address, array(phone, ' ') AS phone FROM {companies} WHERE id % 11 <> 0""",
    """WITH r AS (SELECT id % 100 AS company_id, id AS seq, CASE id % 3 WHEN 0 THEN '本社' WHEN 1 THEN NULL ELSE '支店' END AS office_name, address, nullif(trim(coalesce(phone, '')), '') AS phone FROM companies WHERE id % 11 <> 0)
    SELECT company_id, min(seq) AS seq, any_value(office_name) AS office_name, count(DISTINCT address) AS n_addresses, count(DISTINCT phone) AS n_phones FROM r GROUP BY company_id, coalesce(office_name, address)""",
)(lambda d: j.merge_offices(d).select("company_id", "seq", "office_name", F.size("address").cast("long").alias("n_addresses"), F.size("phone").cast("long").alias("n_phones")))
query(
    "focus_cutoff",
    "SELECT id % 100 AS company_id, CASE WHEN id % 2 = 0 THEN 'contact' ELSE 'permit' END AS focus, cast(id / 100 AS int) AS page_seq, CASE id % 300 WHEN 0 THEN 'fax' ELSE 'phone' END AS field FROM {companies}",
    """WITH v AS (SELECT id % 100 AS company_id, CASE WHEN id % 2 = 0 THEN 'contact' ELSE 'permit' END AS focus, (id // 100)::INT AS page_seq, CASE id % 300 WHEN 0 THEN 'fax' ELSE 'phone' END AS field FROM companies),
    f AS (SELECT company_id, focus, field, min(page_seq) AS p FROM v WHERE focus = 'contact' GROUP BY ALL), a AS (SELECT company_id, focus, max(p) AS last FROM f GROUP BY ALL HAVING count(*) = 2)
    SELECT DISTINCT v.company_id, v.focus, v.page_seq FROM v LEFT JOIN a USING (company_id, focus) WHERE a.last IS NULL OR v.page_seq <= a.last""",
)(lambda d: j.focus_cutoff(d, {"contact": ("phone", "fax")}))
# where the known table is there, other tables with contact labels are not read
EXACT = """SELECT id, 0 AS page, '<table><tr><th>問合せ先</th><td>別</td></tr></table>' || CASE WHEN id % 2 = 0 THEN '<table id="t" class="dataTable last dataTable02 ver02"><tr><th>問合せ先</th><td>人事' || cast(id AS string) || '</td></tr><tr><th>交通機関</th><td>駅</td></tr></table>' ELSE '' END AS html FROM {companies}"""
query(
    "contact_table_exact",
    EXACT,
    "SELECT id, '問合せ先' AS label, CASE WHEN id % 2 = 0 THEN '人事' || id ELSE '別' END AS value FROM companies UNION ALL SELECT id, '交通機関', '駅' FROM companies WHERE id % 2 = 0",
)(lambda d: j.contact_rows(d, ["id"]))
# schools and head counts of past hirings: cells with links, breaks and rows of their own
HIRED = """SELECT id, 'https://board.example.jp/' || cast(id AS string) || '/outline.html' AS url, '<h1>x</h1><table><tr id="school"><th>学校</th><td> <b>大学' || cast(id % 9 AS string) || '</b> もっと見る </td></tr>' ||
 CASE WHEN id % 4 = 0 THEN '' ELSE '<tr id="ninzuu"><th>人数</th><td>2023年<br>' || cast(id % 30 AS string) || '名<br/> <br>2024年 ' || employee_count || '</td></tr>' END || '</table>' AS html FROM {companies}"""
query(
    "recruit_results",
    HIRED,
    """SELECT id, '大学' || (id % 9) AS school, CASE WHEN id % 4 = 0 THEN '' ELSE '2023年' || chr(10) || (id % 30) || '名' || chr(10) || trim('2024年 ' || employee_count) END AS hired FROM companies""",
)(
    lambda d: j.outline_record(d).select(
        F.regexp_extract("元URL", "([0-9]+)", 1).cast("long").alias("id"), F.col("`採用実績（学校）`").alias("school"), F.col("`採用実績（人数）`").alias("hired")
    )
)
ODD_TEXT = "SELECT id, '  ' || coalesce(company, '') || chr(9) || ' 　' || chr(160) || 'a' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || coalesce(memo, '') || chr(7) || ' : x ' || chr(10) AS t FROM {companies}"
_ONE = "regexp_replace(regexp_replace(replace(replace(t, chr(160), ' '), chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_ENDS = f"regexp_replace({_ONE}, '^[\\s　]+|[\\s　]+$', '', 'g')"
query(
    "clean_text",
    ODD_TEXT,
    f"SELECT id, {_ENDS} AS clean, replace(t, chr(7), '') AS legal, regexp_replace({_ENDS}, '[\\s　]+', '', 'g') AS label FROM ({ODD_TEXT.replace('{companies}', 'companies')})",
)(lambda d: d.select("id", j.clean_text("t").alias("clean"), j.without_controls("t").alias("legal"), j.plain_label("t").alias("label")))
