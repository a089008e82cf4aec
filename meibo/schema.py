"""Names and types of the company table, and the test view of companies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Field, stored column and CSV header of the company table, in order.
FIELDS = (
    ("company", "企業名", "企業名"),
    ("zipcode", "郵便番号", "郵便番号"),
    ("address", "住所", "住所"),
    ("big_industry", "大業種名", "大業種"),
    ("small_industry", "小業種名", "小業種"),
    ("company_kana", "企業名（かな）", "企業名（かな）"),
    ("summary", "企業概要", "企業概要"),
    ("website_url", "企業サイトURL", "企業URL"),
    ("form_url", "問い合わせフォームURL", "お問い合わせフォームURL"),
    ("phone", "電話番号", "電話番号"),
    ("fax", "FAX番号", "FAX番号"),
    ("email", "メールアドレス", "メールアドレス"),
    ("established_date", "設立年月", "設立年月"),
    ("representative_name", "代表者名", "代表者名"),
    ("representative_title", "代表者役職", "代表者役職"),
    ("capital", "資本金", "資本金"),
    ("employee_count", "従業員数", "従業員数"),
    ("employee_count_year", "従業員数年度", "従業員数年度"),
    ("previous_sales", "前年売上高", "前年売上高"),
    ("latest_sales", "直近売上高", "直近売上高"),
    ("closing_month", "決算月", "決算月"),
    ("office_count", "事業所数", "事業所数"),
    ("tag", "新規登録タグ", "タグ"),
    ("business_type", "業種", "業種"),
    ("business_content", "事業内容", "事業内容"),
    ("industry_category", "業界", "業界"),
    ("permit_number", "許可番号", "許可番号"),
    ("memo", "メモ", "メモ"),
)
NAMES = tuple(f for f, _, _ in FIELDS)
COLUMN_OF = {f: c for f, c, _ in FIELDS}
CSV_HEADERS = tuple(h for _, _, h in FIELDS)
FIELD_OF_HEADER = {h: f for f, _, h in FIELDS}

COMPANIES = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, T.StringType()) for f in NAMES]])
CONTACTS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("phone", T.StringType())])
PREVIEW_KEY = ("job_id", "preview_row_id")

# Prefectures of each region, in order.
REGIONS = {
    "北海道": ("北海道",),
    "東北": ("青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県"),
    "関東": ("茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県"),
    "中部": ("新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県"),
    "近畿": ("滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県"),
    "中国": ("鳥取県", "島根県", "岡山県", "広島県", "山口県"),
    "四国": ("徳島県", "香川県", "愛媛県", "高知県"),
    "九州": ("福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県"),
    "沖縄": ("沖縄県",),
}
PREFECTURES = tuple(p for ps in REGIONS.values() for p in ps)


def _pick(values: str, n: str) -> str:
    """SQL for the n-th (from 0) of values that ``|`` separates; both engines know split_part."""
    return f"split_part('{values}', '|', cast({n} % {values.count('|') + 1} AS int) + 1)"


_K = "c_custkey"
#: One SELECT that Spark and DuckDB both run: companies made from customers, with the spellings that occur.
COMPANIES_SQL = f"""
SELECT {_K} AS id,
  CASE WHEN {_K} % 41 = 0 THEN NULL WHEN {_K} % 43 = 0 THEN '　'
       ELSE '株式会社' || {_pick("青空|北斗|若葉|大和|みどり|光", _K)} || cast(cast(floor({_K} / 2) AS bigint) AS string) END AS company,
  CASE {_K} % 3 WHEN 0 THEN lpad(cast({_K} % 1000 AS string), 3, '0') || '-' || lpad(cast({_K} % 10000 AS string), 4, '0')
       WHEN 1 THEN lpad(cast({_K} % 10000000 AS string), 7, '1') ELSE '〒１２３－４５６７' END AS zipcode,
  CASE WHEN {_K} % 11 = 0 THEN '' ELSE {_pick("|".join(PREFECTURES), _K)} END
    || {_pick("四日市市|横浜市港北区|府中市栄町|中央区|郡山町|大阪市北区|平和村|1町", _K)} || '1-2-' || cast({_K} AS string) AS address,
  {_pick("製造業|建設業| 情報通信業|卸売・小売|医療、福祉||その他サービス|運送|不動産|学校教育", _K)} AS big_industry,
  {_pick("食品|土木|ソフトウェア|販売|病院||理容", _K)} AS small_industry,
  'かいしゃ' || cast({_K} AS string) AS company_kana,
  CASE WHEN {_K} % 5 = 0 THEN NULL ELSE '概要' || cast({_K} % 17 AS string) END AS summary,
  CASE WHEN {_K} % 9 = 0 THEN NULL WHEN {_K} % 9 = 1 THEN 'www.c' || cast({_K} AS string) || '.co.jp'
       ELSE 'https://c' || cast({_K} AS string) || '.example.jp/#top' END AS website_url,
  CASE WHEN {_K} % 4 = 0 THEN 'https://c' || cast({_K} AS string) || '.example.jp/contact' ELSE '' END AS form_url,
  CASE {_K} % 8 WHEN 0 THEN '03-1234-' || lpad(cast({_K} % 10000 AS string), 4, '0')
       WHEN 1 THEN '06' || lpad(cast({_K} % 100000000 AS string), 8, '2') WHEN 2 THEN '0120-111-' || lpad(cast({_K} % 1000 AS string), 3, '0')
       WHEN 3 THEN '090' || lpad(cast({_K} % 100000000 AS string), 8, '3') WHEN 4 THEN 'TEL：０４５-１２３-' || lpad(cast({_K} % 10000 AS string), 4, '0')
       WHEN 5 THEN '0570' || lpad(cast({_K} % 1000000 AS string), 6, '4') WHEN 6 THEN '不明' ELSE NULL END AS phone,
  CASE {_K} % 4 WHEN 0 THEN 'FAX: 03-9876-' || lpad(cast({_K} % 10000 AS string), 4, '0') WHEN 1 THEN '0459876' || lpad(cast({_K} % 1000 AS string), 3, '0')
       WHEN 2 THEN '電話兼用' ELSE NULL END AS fax,
  CASE WHEN {_K} % 6 = 0 THEN NULL WHEN {_K} % 6 = 1 THEN 'メール: info' || cast({_K} AS string) || '@example.co.jp まで'
       ELSE 'c' || cast({_K} AS string) || '@example.jp' END AS email,
  CASE {_K} % 6 WHEN 0 THEN '1990年4月1日' WHEN 1 THEN '1990年' || cast({_K} % 12 + 1 AS string) || '月' WHEN 2 THEN '200' || cast({_K} % 10 AS string) || '/04'
       WHEN 3 THEN '199004' WHEN 4 THEN '昭和50年' ELSE NULL END AS established_date,
  {_pick("山田 太郎|代表取締役 佐藤 花子|ご挨拶|名古屋市|鈴木 一郎 様|ジョン・スミス|株式会社山田||田中　次郎", _K)} AS representative_name,
  {_pick("代表取締役|社長||理事長", _K)} AS representative_title,
  CASE {_K} % 5 WHEN 0 THEN cast({_K} * 1000 AS string) WHEN 1 THEN '1,000万円' WHEN 2 THEN '1億2000万円' WHEN 3 THEN '1e6' ELSE ' ' END AS capital,
  CASE {_K} % 7 WHEN 0 THEN '連結 ' || cast({_K} % 500 AS string) || '名' WHEN 1 THEN '単体30人（連結 90人）' WHEN 2 THEN '正社員10名 パート5名'
       WHEN 3 THEN cast({_K} % 300 AS string) WHEN 4 THEN '1,234名' WHEN 5 THEN '約50人' ELSE '' END AS employee_count,
  CASE WHEN {_K} % 2 = 0 THEN '2024年' ELSE NULL END AS employee_count_year,
  cast(cast(floor(c_acctbal) AS bigint) AS string) AS previous_sales,
  cast(cast(floor(c_acctbal * 2) AS bigint) AS string) AS latest_sales,
  cast({_K} % 12 + 1 AS string) || '月' AS closing_month,
  cast({_K} % 4 AS string) AS office_count,
  {_pick("マイナビ;新卒|大学 ; 物流|東京都;|||介護;IT;マイナビ|求人ボックス|その他タグ", _K)} AS tag,
  c_mktsegment AS business_type,
  {_pick("食品の製造及び販売|土木工事の施工||介護サービスの運営", _K)} AS business_content,
  {_pick("メーカー|商社|IT|", _K)} AS industry_category,
  CASE {_K} % 5 WHEN 0 THEN '派13-123456' WHEN 1 THEN '13-ユ-654321' WHEN 2 THEN '派13-123456 13-ユ-654321' ELSE NULL END AS permit_number,
  CASE WHEN {_K} % 10 = 0 THEN '100%_メモ' ELSE NULL END AS memo
FROM {{customer}}
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test view of companies."""
    return spark.sql(COMPANIES_SQL, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def dealt_companies(spark: SparkSession, sf_dir: str, rows: int = 20_000) -> DataFrame:
    """The test view of companies for work that is long for each: dealt to all cores, in more parts where a part would hold over ``rows``.

    The driver's table is one small file, which would be one task; customers are dealt before companies are made of them.
    """
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = max(spark.sparkContext.defaultParallelism, -(-customer.count() // rows))
    return spark.sql(COMPANIES_SQL, customer=customer.repartition(n, _K))


def with_companies(sql: str) -> str:
    """DuckDB SQL that may name the view ``companies``."""
    return f"WITH companies AS ({COMPANIES_SQL.format(customer='customer')})" + (", " + sql.strip()[5:] if sql.strip()[:5].upper() == "WITH " else " " + sql)
