"""Queries of offices and labelled lines over pages built from the company view."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.operators import offices, pages
from meibo.schema import companies, dealt_companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINES = """
SELECT id AS company_id, 0 AS page_seq, company, '会社概要\\n資本金：' || capital || '\\n設立\\n' || coalesce(established_date, '') || '\\n大阪支店\\n〒530-0001 大阪府大阪市北区梅田1-' || cast(id AS string) ||
 '\\nTEL 06-1111-' || lpad(cast(id % 10000 AS string), 4, '0') || '\\nFAX 06-2222-' || lpad(cast(id % 10000 AS string), 4, '0') || '\\n沿革\\n東京支店\\n担当者' AS lines FROM {companies}
"""
_NUMBER = "lpad(cast(id % 10000 AS varchar), 4, '0')"
QUERIES["extract_offices"] = lambda spark, sf_dir: offices.extract_offices(spark.sql(LINES, companies=dealt_companies(spark, sf_dir))).select(
    "company_id", "office_name", "company", *[F.array_join(a, "/").alias(a) for a in ("phone", "fax", "zipcode", "address")]
)
ORACLES["extract_offices"] = with_companies(
    f"""SELECT id AS company_id, '大阪支店' AS office_name, CASE WHEN company IS NULL THEN '大阪支店' ELSE company || ' 大阪支店' END AS company,
    '06-1111-' || {_NUMBER} AS phone, '06-2222-' || {_NUMBER} AS fax, '530-0001' AS zipcode, '大阪府大阪市北区梅田1-' || id AS address FROM companies"""
)
QUERIES["labeled_line_value"] = lambda spark, sf_dir: offices.labelled_values(
    spark.sql(LINES, companies=dealt_companies(spark, sf_dir)), {"capital": "資本金", "established_date": "設立|創業"}
)
ORACLES["labeled_line_value"] = with_companies(
    """SELECT id AS company_id, 'capital' AS field, trim(capital, ' ') AS value FROM companies WHERE trim(capital, ' ') <> ''
    UNION ALL SELECT id, 'established_date', established_date FROM companies WHERE established_date IS NOT NULL"""
)

# the same lines as pages, of which those that tell of offices are read: of every fifth company only a page of greetings
PAGES = f"""SELECT company_id, page_seq, 'https://c' || cast(company_id AS string) || '.test/' AS final_url, CASE WHEN company_id % 5 = 0 THEN '<p>ようこそ</p>' ELSE '<p>' || replace(lines, chr(10), '</p><p>') || '</p>' END AS html FROM ({LINES})"""
QUERIES["page_offices"] = lambda spark, sf_dir: pages.page_offices(
    spark.sql(PAGES, companies=dealt_companies(spark, sf_dir)), companies(spark, sf_dir).select(F.col("id").alias("company_id"), "company")
).select("company_id", "office_name", "company", *[F.array_join(a, "/").alias(a) for a in ("phone", "fax", "zipcode", "address")])
ORACLES["page_offices"] = with_companies(
    f"""SELECT id AS company_id, '大阪支店' AS office_name, CASE WHEN company IS NULL THEN '大阪支店' ELSE company || ' 大阪支店' END AS company,
    '06-1111-' || {_NUMBER} AS phone, '06-2222-' || {_NUMBER} AS fax, '530-0001' AS zipcode, '大阪府大阪市北区梅田1-' || id AS address FROM companies WHERE id % 5 <> 0"""
)
