"""Queries of the normal forms over the company view."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.functions import text as x
from meibo.plans import oracle as o
from meibo.schema import PREFECTURES, companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_DIGITS = lambda c: f"translate({c}, '０１２３４５６７８９', '0123456789')"
_PLAIN = lambda c: _DIGITS(f"trim(regexp_replace(coalesce({c}, ''), '[\\s　]{{2,}}', ' ', 'g'))")


def format_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    cut = lambda a, b: f"substr({d}, 1, {a}) || '-' || substr({d}, {a + 1}, {b}) || '-' || substr({d}, {a + b + 1})"
    return f"""CASE WHEN NOT regexp_matches({d}, '^0[0-9]{{9,10}}$') THEN NULL WHEN regexp_matches({d}, '^(070|080|090|050|020)[0-9]{{8}}$') THEN {cut(3, 4)}
 WHEN regexp_matches({d}, '^0120[0-9]{{6}}$') THEN {cut(4, 3)} WHEN regexp_matches({d}, '^0570[0-9]{{6}}$') THEN {cut(4, 2)}
 WHEN regexp_matches({d}, '^(03|06)[0-9]{{8}}$') THEN {cut(2, 4)} WHEN length({d}) = 10 THEN {cut(4, 2)} ELSE {cut(3, 4)} END"""


_PHONE_T = _PLAIN("phone")
_LABELLED = o.first(_PHONE_T, "(?i)(?:TEL|電話番号|電話|本社電話番号|代表電話|連絡先)\\s*[:：.]?\\s*(0[0-9\\s-]{8,13}[0-9])")
_FREE = o.first(_PHONE_T, "(?:^|[^0-9])(0[0-9]{1,4}[-\\s]?[0-9]{1,4}[-\\s]?[0-9]{3,4})(?:$|[^0-9])")
_FREE_OK = f"CASE WHEN length(regexp_replace({_FREE}, '[^0-9]', '', 'g')) BETWEEN 10 AND 11 THEN {_FREE} END"
PHONE = f"CASE WHEN {_LABELLED} IS NOT NULL THEN {format_sql(_LABELLED)} WHEN {_FREE_OK} IS NOT NULL THEN {format_sql(_FREE)} END"
_FAX_T = _PLAIN("fax")
_FAX_L = o.first(_FAX_T, "(?i)(?:FAX|ＦＡＸ|ファックス)\\s*[:：.]?\\s*(0[0-9\\s-]{8,13}[0-9])")
FAX = f"CASE WHEN {_FAX_L} IS NOT NULL THEN {format_sql(_FAX_L)} WHEN regexp_matches({_FAX_T}, '^[0-9\\s-]+$') THEN {format_sql(_FAX_T)} END"
_ZIP = _PLAIN("zipcode")
ZIP = f"CASE WHEN regexp_matches({_ZIP}, '[0-9]{{3}}-?[0-9]{{4}}') THEN regexp_extract({_ZIP}, '([0-9]{{3}})-?([0-9]{{4}})', 1) || '-' || regexp_extract({_ZIP}, '([0-9]{{3}})-?([0-9]{{4}})', 2) END"
EMAIL = o.first("coalesce(email, '')", "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}", 0)
_EST = "trim(coalesce(established_date, ''))"
_EST_P = "([12][0-9]{3})[^0-9]{0,3}([0-9]{1,2})?"
ESTABLISHED = f"{o.first(_EST, _EST_P)} || '年' || coalesce(cast(try_cast({o.first(_EST, _EST_P, 2)} AS int) AS varchar) || '月', '')"
# a head count among the words that may stand around it, and its rule, step by step
_COUNTED = """CASE id % 6 WHEN 0 THEN employee_count WHEN 1 THEN '従業員数：' || employee_count WHEN 2 THEN '職員数 ' || employee_count || '（2020年）' WHEN 3 THEN '総従業員数' || employee_count || ' 連結 2,500名'
 WHEN 4 THEN 'スタッフ数 ' || employee_count || ' 単体' WHEN 5 THEN '採用人数 ' || employee_count || '、非常勤 7人、役員 3 名' END"""


def EMPLOYEE_COUNT(c: str) -> str:  # noqa: N802
    t, num, unit = "t", "([0-9][0-9,]*)", r"[\s　]*(?:名|人)"
    n = lambda e: f"try_cast(replace({e}, ',', '') AS hugeint)"
    shown = lambda e: f"CASE WHEN {e} > 0 THEN format('{{:,}}', cast({e} AS bigint)) || '名' END"
    one = lambda pattern: n(o.first(t, f"(?i){pattern}"))
    beside = lambda words: "coalesce(" + ", ".join(f"{one(f'{w}[^0-9]{{0,12}}{num}{unit}')}, {one(f'{num}{unit}[^0-9]{{0,12}}{w}')}" for w in words) + ")"
    kinds = f"regexp_extract_all(t, '(?:正社員|正職員|社員|職員|パート|アルバイト|契約社員|契約職員|派遣社員|派遣スタッフ|嘱託|嘱託社員|臨時社員|臨時職員|常勤|非常勤|フルタイム|短時間|再雇用|有期雇用|無期雇用|役員)[^0-9]{{0,12}}{num}{unit}', 1)"
    total = f"list_sum(list_transform({kinds}, lambda k: {n('k')}))"
    main, group, alone = one(rf"従業員数[\s　]*[|｜¦┃‖／/：:]?[\s　]*{num}{unit}"), beside(("連結", "consolidated")), beside(("単体", "単独", "個別", "individual", "non-consolidated", "nonconsolidated"))
    bare = one(rf"^(?:{x.EMPLOYEE_LABELS})[\s　]*[:：]?[\s　]*{num}$")
    near = one(f"(?:従業員数|従業員|社員数|職員数|スタッフ数|人員数|総人員|就業人数|就業者数)[^0-9]{{0,20}}{num}{unit}")
    return f"""(SELECT CASE WHEN main > 0 THEN {shown('main')} WHEN grp IS NOT NULL THEN {shown('grp')} WHEN kinds >= 2 AND total > 0 THEN {shown('total')}
      WHEN alone IS NOT NULL THEN {shown('alone')} WHEN bare IS NOT NULL THEN {shown('bare')} WHEN regexp_matches(t, '(?i){x.EMPLOYEE_CONTEXT}') THEN {shown('near')} END
      FROM (SELECT t, {main} AS main, {group} AS grp, len({kinds}) AS kinds, {total} AS total, {alone} AS alone, {bare} AS bare, {near} AS near
      FROM (SELECT replace({_PLAIN(f'({c})')}, '，', ',') AS t)))"""


CAPITAL = f"coalesce({o.first('capital', '[0-9,\\.]+(?:億円|億|千万円|百万円|万円|円)', 0)}, nullif(trim(coalesce(capital, '')), ''))"
_D1 = "regexp_matches(permit_number, '派\\s*[0-9]{2}\\s*[-－ー―]\\s*[0-9]{6}')"
_D2 = "regexp_matches(permit_number, '[0-9]{2}\\s*[-－ー―]\\s*ユ\\s*[-－ー―]\\s*[0-9]{6}')"
URL = "CASE WHEN trim(coalesce(website_url, '')) = '' THEN NULL WHEN regexp_matches(website_url, '(?i)^https?://') THEN website_url ELSE 'https://' || website_url END"

# a line of a page: label, code, address and what follows it, some without
_LINE = lambda: F.concat(
    F.when(F.col("id") % 3 == 0, F.lit("本社所在地：〒123-4567 ")).when(F.col("id") % 3 == 1, F.lit("住所　")).otherwise(F.lit("")), x.col("address"),
    F.when(F.col("id") % 5 == 0, F.lit(" TEL 03-1234-5678")).when(F.col("id") % 5 == 1, F.lit("  ビル2階 営業部")).when(F.col("id") % 5 == 2, F.lit(" 採用 情報")).otherwise(F.lit("")),
)
_LINE_SQL = """CASE id % 3 WHEN 0 THEN '本社所在地：〒123-4567 ' WHEN 1 THEN '住所　' ELSE '' END || coalesce(address, '')
 || CASE id % 5 WHEN 0 THEN ' TEL 03-1234-5678' WHEN 1 THEN '  ビル2階 営業部' WHEN 2 THEN ' 採用 情報' ELSE '' END"""
_W = "[\\s　]"
_LOCATION = f"(?:(?:{'|'.join(PREFECTURES)}){_W}*)?{x.MUNICIPALITY}"


def likely_sql(t: str) -> str:
    return f"""coalesce(length({t}) BETWEEN 8 AND 120 AND NOT regexp_matches({t}, '(?i){x.ADDRESS_NOISE}|{x.ADDRESS_CONTACTS}|@|[。！？!?]')
 AND regexp_matches({t}, '{_LOCATION}') AND regexp_matches(regexp_extract({t}, '{_LOCATION}(.*)$', 1), '(?i){x.ADDRESS_DETAIL}'), false)"""


def _tail_sql(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace({t}, '(?i){_W}*(?:{x.ADDRESS_TAILS}){_W}*$', ''), '{_W}{{2,}}', ' ', 'g'), ' 　')"


_LABELS = x.ADDRESS_LABELS.replace("\\", "\\")
#: Steps of the address's normal form, each a subquery, over (id, t).
_STEPS = (
    f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(?:{_LABELS}){_W}*[:：]?{_W}*', ''), '(?:〒{_W}*)?[0-9]{{3}}-?[0-9]{{4}}{_W}*', '', 'g'), '{_W}{{2,}}', ' ', 'g'), ' 　') AS t",
    f"SELECT id, nullif(regexp_extract(t, '({_LOCATION}.*)$', 1), '') AS t",
    f"SELECT id, {_tail_sql(f"regexp_replace(t, '(?i){_W}*(?:{x.ADDRESS_ENDS}).*$', '')")} AS t",
)


def core_sql(rows: str, column: str) -> str:
    """(id, t): the core of the address in ``column`` of ``rows``, a SELECT that also has ``id``."""
    core = f"SELECT id, {_PLAIN(f'({column})')} AS t FROM ({rows})"
    for step in _STEPS:
        core = f"{step} FROM ({core})"
    return core


_CORE = core_sql("SELECT * FROM companies", _LINE_SQL)
_MEMO = "CASE id % 6 WHEN 0 THEN '社員数 ' WHEN 1 THEN '募集人数 ' WHEN 2 THEN '電話' WHEN 3 THEN '代表電話' WHEN 4 THEN 'FAX' ELSE '' END || coalesce(memo, '')"
_MEMO_COLUMN = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("社員数 ", "募集人数 ", "電話", "代表電話", "FAX", ""))), (F.col("id") % 6 + 1).cast("int")), x.col("memo"))
_TIME = "CASE id % 4 WHEN 0 THEN '2024/03/0' || (id % 9 + 1) WHEN 1 THEN ' 2023-12-31 23:59:0' || (id % 10) WHEN 2 THEN 'まだ' ELSE '' END"
_TIME_COLUMN = lambda: F.when(F.col("id") % 4 == 0, F.concat(F.lit("2024/03/0"), (F.col("id") % 9 + 1).cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit(" 2023-12-31 23:59:0"), (F.col("id") % 10).cast("string"))).when(F.col("id") % 4 == 2, F.lit("まだ")).otherwise(F.lit(""))

_QUERIES = {
    "is_likely_address": (lambda: x.likely_address(_LINE()), likely_sql(_PLAIN(f"({_LINE_SQL})"))),
    "employee_context": (lambda: x.employee_context(_MEMO_COLUMN()), f"id % 6 = 0 OR regexp_matches({_MEMO}, '{x.EMPLOYEE_CONTEXT}')"),
    "employee_noise": (lambda: x.employee_noise(_MEMO_COLUMN()), f"trim({_MEMO}) = '' OR (id % 6 <> 0 AND regexp_matches({_MEMO}, '(?i){x.EMPLOYEE_NOISE}'))"),
    "phone_label_context": (lambda: x.phone_label_context(_MEMO_COLUMN()), "id % 6 IN (2, 3) AND coalesce(memo, '') = ''"),
    "normalize_iso_datetime": (lambda: x.iso_datetime(_TIME_COLUMN()), f"CASE id % 4 WHEN 0 THEN replace({_TIME}, '/', '-') || 'T00:00:00.000Z' WHEN 1 THEN replace(trim({_TIME}), ' ', 'T') || '.000Z' END"),
    "normalize_digits": (lambda: x.digits(x.col("zipcode")), _DIGITS("coalesce(zipcode, '')")),
    "normalize_space": (lambda: x.space("representative_name"), "trim(regexp_replace(coalesce(representative_name, ''), '[\\s　]{2,}', ' ', 'g'))"),
    "normalize_nullable_text": (lambda: x.nullable("company"), "nullif(trim(coalesce(company, ''), ' 　'), '')"),
    "format_japanese_phone": (lambda: x.format_phone("phone"), format_sql("coalesce(phone, '')")),
    "normalize_phone": (lambda: x.phone("phone"), PHONE),
    "is_representative_phone": (lambda: x.landline("phone"), "regexp_matches(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), '^0[0-9]{9,10}$') AND NOT regexp_matches(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), '^(070|080|090|050|020|0120|0570|0800)')"),
    "normalize_representative_phone": (lambda: x.representative_phone("phone"), f"CASE WHEN NOT regexp_matches(replace({PHONE}, '-', ''), '^(070|080|090|050|020|0120|0570|0800)') THEN {PHONE} END"),
    "weak_phone_context": (lambda: x.weak_phone_context("memo"), "trim(coalesce(memo, '')) = '' OR regexp_matches(memo, '採用|店舗')"),
    "normalize_fax": (lambda: x.fax("fax"), FAX),
    "normalize_zipcode": (lambda: x.zipcode("zipcode"), ZIP),
    "normalize_email": (lambda: x.email("email"), EMAIL),
    "normalize_established": (lambda: x.established("established_date"), ESTABLISHED),
    "normalize_capital": (lambda: x.capital("capital"), CAPITAL),
    "normalize_employee_count": (lambda: x.employee_count(F.expr(_COUNTED)), EMPLOYEE_COUNT(_COUNTED)),
    "normalize_business_content": (lambda: x.business_content("business_content"), "CASE WHEN length(business_content) >= 8 AND regexp_matches(business_content, '販売|施工|運営|製造|介護') THEN business_content END"),
    "permit_category": (lambda: x.permit_category("permit_number"), f"CASE WHEN {_D1} AND {_D2} THEN '労働者派遣・有料職業紹介' WHEN {_D1} THEN '労働者派遣' WHEN {_D2} THEN '有料職業紹介' END"),
    "clean_company_name": (lambda: x.company_name(F.concat(F.lit("ホーム | "), x.col("company"), F.lit("｜会社概要"))), "nullif(trim(coalesce(company, ''), ' 　'), '')"),
    "company_name_from_text": (lambda: x.company_name_in(F.concat(F.lit("運営: "), x.col("company"), F.lit(" です"))), "CASE WHEN company LIKE '株式会社%' THEN company END"),
    "is_likely_company_name": (lambda: x.likely_company_name("company"), "coalesce(company, '') <> ''"),
    "normalize_seed_url": (lambda: x.seed_url("website_url"), URL),
    "url_without_hash": (lambda: x.without_hash("website_url"), "regexp_replace(coalesce(website_url, ''), '#.*$', '')"),
    "url_scheme_variants": (lambda: F.array_join(x.url_variants("website_url"), " "), f"'https://' || regexp_replace({URL}, '^https?://', '') || ' http://' || regexp_replace({URL}, '^https?://', '')"),
    "contact_number_key": (lambda: x.contact_key(F.concat(F.lit("+81 "), F.substring(x.col("phone"), 2, 20))), f"CASE WHEN length(regexp_replace({_DIGITS("'81' || substr(coalesce(phone, ''), 2, 20)")}, '[^0-9]', '', 'g')) >= 11 THEN '0' || substr(regexp_replace({_DIGITS("'81' || substr(coalesce(phone, ''), 2, 20)")}, '[^0-9]', '', 'g'), 3) ELSE regexp_replace({_DIGITS("'81' || substr(coalesce(phone, ''), 2, 20)")}, '[^0-9]', '', 'g') END"),
    "contact_number_candidate": (lambda: x.contact_candidate("fax"), o.first(_DIGITS("coalesce(fax, '')"), "0[0-9]{1,4}-?[0-9]{1,4}-?[0-9]{3,4}", 0)),
    "split_contact_candidates": (lambda: F.array_join(x.contact_candidates(F.concat(F.coalesce("phone", F.lit("03-0000-0000")), F.lit(" ; "), F.coalesce("fax", F.lit("0451112222")), F.lit("；"), F.coalesce("phone", F.lit("03-0000-0000")))), "/"), "coalesce(phone, '03-0000-0000') || '/' || coalesce(fax, '0451112222')"),
    "strip_corporate_words": (lambda: x.strip_corporate("company"), "trim(replace(coalesce(company, ''), '株式会社', ''), ' 　')"),
    "compare_key": (lambda: x.compare_key("zipcode"), "replace(translate(coalesce(zipcode, ''), '０１２３４５６７８９－', '0123456789-'), ' ', '')"),
    "email_from_text": (lambda: x.email(F.concat(F.lit("お問合せ "), x.col("email"), F.lit(" 担当"))), EMAIL),
}
for _name, (_column, _sql) in _QUERIES.items():
    QUERIES[_name] = lambda spark, sf_dir, c=_column: companies(spark, sf_dir).select("id", c().alias("value"))
    ORACLES[_name] = with_companies(f"SELECT id, {_sql} AS value FROM companies")

for _name, _column in (("pick_address_core", x.address_core), ("normalize_address", x.address)):
    QUERIES[_name] = lambda spark, sf_dir, f=_column: companies(spark, sf_dir).select("id", f(_LINE()).alias("value"))
    ORACLES[_name] = with_companies(f"SELECT id, CASE WHEN {likely_sql('t')} THEN t END AS value FROM ({_CORE})")

QUERIES["standardize_companies"] = lambda spark, sf_dir: x.standardize(companies(spark, sf_dir), ("phone", "zipcode", "email")).select(
    "id", "phone", "zipcode", "email", F.array_join("changed", ",").alias("changed")
)
ORACLES["standardize_companies"] = with_companies(
    f"""SELECT id, coalesce(p, phone) AS phone, coalesce(z, zipcode) AS zipcode, coalesce(e, email) AS email,
    array_to_string(list_filter([CASE WHEN p <> phone THEN 'phone' END, CASE WHEN z <> zipcode THEN 'zipcode' END, CASE WHEN e <> email THEN 'email' END], lambda v: v IS NOT NULL), ',') AS changed
    FROM (SELECT *, {PHONE} AS p, {ZIP} AS z, {EMAIL} AS e FROM companies)"""
)
