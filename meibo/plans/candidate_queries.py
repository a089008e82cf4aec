"""Queries of what a page's lines say of a company, over pages whose lines hold decoys, and their SQL.

The SQL goes line by line over the same texts, with the patterns written out where the library builds them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.functions import text as x
from meibo.operators import lines, pages
from meibo.plans import text_queries as t
from meibo.schema import dealt_companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_N, _E, _A, _Z = (f"coalesce({c}, '')" for c in ("representative_name", "employee_count", "address", "zipcode"))
_NL = " || chr(10) || "
#: The lines of a company's page: names, head counts and addresses among headings, recruiting, other firms and empty values.
LINES = f"""CASE id % 8
 WHEN 0 THEN '会社概要'{_NL}'代表者名：' || {_N}{_NL}'従業員数'{_NL}{_E}{_NL}'（2020年4月現在）'{_NL}'所在地'{_NL}{_Z}{_NL}{_A}
 WHEN 1 THEN '代表取締役社長'{_NL}'ごあいさつ'{_NL}{_N}{_NL}'社員数：' || {_E}{_NL}'採用人数 5名'{_NL}'本社 ' || {_A}
 WHEN 2 THEN {_N} || ' 代表取締役'{_NL}'スタッフ数|' || {_E}{_NL}'〒530-0001 大阪府大阪市北区梅田1-2-3'{_NL}'支店'{_NL}{_A}
 WHEN 3 THEN '理事長／' || {_N}{_NL}'従業員 ' || {_E} || ' パート7名'{_NL}'アクセス ' || {_A} || ' TEL 03-1111-2222'
 WHEN 4 THEN '株式会社あ 代表取締役 ' || {_N}{_NL}'代表'{_NL}'社長挨拶'{_NL}'連結'{_NL}'2,000名'{_NL}'総従業員数：' || {_E}{_NL}{_A} || ' 営業所'
 WHEN 5 THEN '所長'{_NL}'平素よりお世話になっております'{_NL}{_N}{_NL}'職員数'{_NL}{_E}{_NL}'所在地 ' || {_A} || ' 株式会社青空'
 WHEN 6 THEN '会長 ' || {_N} || '（たろう）'{_NL}'役員一覧'{_NL}'従業員数'{_NL}'設立 1990年'{_NL}{_E}{_NL}'工場'{_NL}{_A}{_NL}'東京都府中市'
 ELSE {_N}{_NL}'求人 ' || {_A}{_NL}{_E} END"""
#: Odd companies' pages are of a path that speaks of the company.
PAGES = f"""SELECT id AS company_id, 0 AS page_seq, CAST(NULL AS string) AS focus, 'https://c' || cast(id AS string) || CASE id % 2 WHEN 1 THEN '.test/company/' ELSE '.test/' END AS final_url,
 '<body><p>' || replace({LINES}, chr(10), '</p><p>') || '</p></body>' AS html FROM {{companies}}"""


def decoy_pages(spark, sf_dir):
    return spark.sql(PAGES, companies=dealt_companies(spark, sf_dir))


def _found(spark, sf_dir, field: str):
    return pages.candidates(decoy_pages(spark, sf_dir)).where(F.col("field") == field).select("company_id", "value", "score")


#: id, form (0 lines, 1 the whole text as one line), place from 1, line, all lines of the form.
_SPACED = f"trim(regexp_replace({{}}, '[\\s　]{{{{2,}}}}', ' ', 'g'), ' 　')"
_ROWS = f"""own AS (SELECT id, list_filter(list_transform(string_split({LINES}, chr(10)), lambda s: {_SPACED.format('s')}), lambda s: s <> '') AS ls FROM companies),
forms AS (SELECT id, 0 AS form, ls FROM own UNION ALL SELECT id, 1, [{_SPACED.format("array_to_string(ls, ' ')")}] FROM own WHERE len(ls) > 1),
l AS (SELECT id, form, k, ls[k] AS line, ls FROM (SELECT id, form, ls, unnest(range(1, len(ls) + 1)) AS k FROM forms))"""

# --- representatives
_W = "[\\s　]*"
_LABELS = "代表者|代表者名|代表者氏名|代表氏名|代表取締役|代表取締役社長|代表取締役会長|取締役社長|代表社員|代表理事|理事長|社長|会長|代表|所長|センター長|学院長|校長|学長|施設長|室長"
_EXACT = "代表者氏名|代表氏名|代表者名?|代表者|代表取締役(?:社長|会長)?|取締役社長|代表社員|代表理事|理事長|社長|会長|所長|センター長|学院長|校長|学長|施設長|室長"
_CRAFTS = "一級塗装技能士|二級塗装技能士|一級建築士|二級建築士|建築士|大工"
_POSTS = f"代表取締役(?:社長|会長)?|取締役社長|取締役|代表社員|代表理事|理事長|社長|会長|代表者?|代表|執行役員(?:専務|常務)?|常務取締役?|専務取締役?|常務|専務|相談役|名誉相談役|所長|センター長|学院長|校長|学長|施設長|室長|{_CRAFTS}"
_LETTER = "[\\p{Han}\\p{Katakana}\\p{Hiragana}々ヶヵーA-Za-z]"


def _group(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', 1), '')"


def _cleaned(c: str) -> str:
    for pattern, to, flag in (
        ("[（(][^）)]*[）)]", " ", ", 'g'"), ("[【】\\[\\]「」『』<>〈〉《》〔〕]", " ", ", 'g'"), (f"^(?:{_EXACT}|役員){_W}[:：]?{_W}", "", ""), (f"^(?:{_POSTS}){_W}", "", ""),
        (f"{_W}(?:{_POSTS}){_W}$", "", ""), (f"{_W}[／/].*$", "", ""), ("[\\s　]+", " ", ", 'g'"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}'{flag})"
    return f"nullif(trim({c}, ' 　'), '')"


_HIT = "代表者|代表氏名|代表取締役|代表社員|代表理事|理事長|^(?:取締役社長|社長|会長|代表|所長|センター長|学院長|校長|学長|施設長|室長)$"
_REST = f"regexp_replace(line, '^(?:{_LABELS}){_W}[:：]?{_W}', '')"
_INLINE = _group("line", f"(?:代表者名|代表者氏名|代表氏名|代表取締役社長|代表取締役会長|代表取締役|取締役社長|代表社員|代表理事|代表者){_W}[|｜¦┃‖／/：:]?{_W}(.+)$")
_SAID = f"""coalesce(CASE WHEN regexp_matches(line, '{_HIT}') THEN CASE WHEN {_REST} NOT IN ('', line) THEN {_REST} ELSE ls[k + 1] END END,
 {_group('line', f'^(?:{_LABELS}){_W}[:：]?{_W}(.+)$')}, nullif({_INLINE}, line))"""
_BARRED = _group("line", f"^(?:{_LABELS}){_W}[|｜¦┃‖／/：:]{_W}(.+)$")
_ALONE = f"regexp_matches(line, '^(?:{_EXACT})$')"
_TITLE = f"regexp_matches(line, '^(?:代表取締役(?:社長|会長)?|取締役社長|代表社員|代表理事|理事長|社長|会長|{_CRAFTS})(?:[\\s　]+(?:{_CRAFTS}))*$')"
_EACH = [
    (_group("line", f"^(?:{_EXACT}){_W}[:：]?{_W}(.+)$"), 1100), (_group("line", f"^(?:代表取締役社長|代表取締役会長|代表取締役|取締役社長|代表社員|代表理事|理事長|会長|社長){_W}[:：/／]?{_W}(.+)$"), 980),
    (_group("line", "^(.+?)[\\s　]+(?:代表取締役(?:社長|会長)?|取締役社長|取締役|代表社員|代表理事|理事長|社長|会長|代表)$"), 960),
    *[(f"CASE WHEN {_ALONE} THEN ls[k + {n}] END", 1120 - 40 * n) for n in range(1, 6)], *[(f"CASE WHEN {_TITLE} THEN ls[k + {n}] END", 1100 - 40 * n) for n in range(1, 6)],
]
_LIKELY = f"""length(v) BETWEEN 2 AND 24 AND NOT regexp_matches(v, '^(?:が|は|を|に|で|と|の|へ|も|から|より|まで)|です|ます|ました|おります|いたします|ください|について|ため|功績|感謝状|受賞|表彰|加入者|機構|業界|セーフティネット|支援|サービス|事業|会社|情報|一覧|詳細|こちら|有限会社|合資会社|合名会社|御中|[0-9０-９]')
 AND v NOT IN ('挨拶', 'ご挨拶', '代表挨拶', '社長挨拶', '理事長挨拶', 'トップメッセージ', 'メッセージ', '氏名', '代表者', '代表者名', '代表者氏名', '代表', '社長', '会長', '理事長', '役員', '役員一覧', '会社概要', '会社情報', '企業情報', '基本情報')
 AND NOT (length(v) > 12 AND regexp_matches(v, '^{_LETTER}+$')) AND regexp_matches(v, '^{_LETTER}+(?:[\\s　・･]+{_LETTER}+){{0,3}}$')"""
_BOOST = "CASE WHEN company_id % 2 = 1 THEN 440 ELSE 0 END"
QUERIES["cand_representative"] = lambda spark, sf_dir: _found(spark, sf_dir, "representative_name")
ORACLES["cand_representative"] = with_companies(
    f"""WITH {_ROWS}, pair AS (SELECT id, k, trim(regexp_extract(line, '^[^:：]{{1,60}}'), ' 　') AS label, regexp_extract(line, '^[^:：]{{1,60}}[:：](.*)$', 1) AS said FROM l WHERE form = 0),
    raw AS (
      SELECT id, arg_min({_cleaned('said')}, k) FILTER (regexp_matches(label, '{_HIT}') AND {_cleaned('said')} IS NOT NULL) AS raw, 1250 AS score FROM pair GROUP BY id
      UNION ALL SELECT id, arg_min({_SAID}, k) FILTER ({_SAID} IS NOT NULL) AS raw, 1230 - 40 * form AS score FROM l GROUP BY id, form
      UNION ALL SELECT id, arg_min({_BARRED}, k) FILTER ({_BARRED} IS NOT NULL), 1220 - 40 * form FROM l GROUP BY id, form
      UNION ALL {" UNION ALL ".join(f"SELECT id, {e}, {s} - 60 * form FROM l" for e, s in _EACH)}),
    named AS (SELECT id AS company_id, {_cleaned('raw')} AS value, score FROM raw), tested AS (SELECT *, {_cleaned('value')} AS v FROM named)
    SELECT company_id, value, max(score) + {_BOOST} AS score FROM tested WHERE {_LIKELY} GROUP BY company_id, value"""
)

# --- addresses
_LABELLED = "regexp_matches(line, '所在地|住所|本社|本店|支店|営業所|工場|事業所|アクセス|郵便番号|〒')"
_JOINED = " UNION ALL ".join(
    [f"SELECT {{'id': id, 'place': [form, k, {n}]}} AS id, array_to_string(ls[k:k + {n}], ' ') AS line FROM l" + (f" WHERE {_LABELLED} AND len(ls) >= k + {n}" if n else "") for n in range(4)]
)
_IN_AREA = "CASE WHEN company_id % 2 = 1 THEN 340 + 40 ELSE 0 END"
_HEAD = "(SELECT substr(array_to_string(ls, chr(10)), 1, 4000) FROM own WHERE own.id = company_id)"
QUERIES["cand_address"] = lambda spark, sf_dir: _found(spark, sf_dir, "address")
ORACLES["cand_address"] = with_companies(
    f"""WITH {_ROWS}, raw AS ({_JOINED}), read AS (SELECT id, CASE WHEN {t.likely_sql('t')} THEN t END AS v FROM ({t.core_sql("SELECT id, line FROM raw", "line")})),
    once AS (SELECT id.id AS company_id, v AS value, min(id.place) AS place FROM read WHERE v IS NOT NULL GROUP BY ALL)
    SELECT company_id, value, 320 - 5 * (row_number() OVER (PARTITION BY company_id ORDER BY place) - 1) + {_IN_AREA}
      + CASE WHEN regexp_matches({_HEAD}, '(?i){pages.ADDRESS_PAGE}') THEN 220 ELSE 0 END + CASE WHEN regexp_matches({_HEAD}, '{pages.LABELS["address"]}') THEN 180 ELSE 0 END
      + CASE WHEN regexp_matches({_HEAD}, '〒{_W}[0-9]{{3}}-?[0-9]{{4}}') THEN 160 ELSE 0 END AS score FROM once"""
)


# --- head counts by lines and blocks of lines
def _staff_lines(spark, sf_dir):
    """(company_id, value, score): the best score of each head count that a page's lines or blocks of lines may give."""
    own = decoy_pages(spark, sf_dir).select("company_id", F.split(pages.strip_html_lines("html"), "\n").alias("ls"))
    rows = own.select("company_id", F.posexplode(F.transform("ls", lambda s, k: F.struct(s.alias("line"), F.slice("ls", k + 2, 5).alias("after")))).alias("k", "r")).select("company_id", "k", "r.*")
    read = lines.finds(lines.staff_blocks(F.col("line"), F.col("after"), F.col("k")))
    found = rows.select("company_id", F.inline_outer(read)).where("raw IS NOT NULL").groupBy("company_id", "raw").agg(F.max("score").alias("score"))
    # the outer form, since Spark would read every value again for a filter
    found = found.select("company_id", "score", F.inline_outer(F.array(F.struct(lines.staff_value(F.col("raw")).alias("value")))))
    return found.groupBy("company_id", "value").agg(F.max("score").alias("score")).where("value IS NOT NULL")


_STAFF_LEAD = f"^(?:{x.EMPLOYEE_LABELS}){_W}"
_LABEL_ALONE = f"regexp_matches(line, '^(?:{x.EMPLOYEE_LABELS})$')"
_AT = lambda *n: "line || " + " || ".join(f"' ' || coalesce(ls[k + {m}], '')" for m in n)
_STAFF = [
    (f"line || ' ' || {_group('line', f'{_STAFF_LEAD}[:：]?{_W}(.+)$')}", 1200), (f"line || ' ' || {_group('line', f'{_STAFF_LEAD}[|｜¦┃‖／/：:]{_W}(.+)$')}", 1190),
    *[(f"CASE WHEN {_LABEL_ALONE} THEN {_AT(*n)} END", s) for n, s in (((1,), 1180), ((1, 2), 1140), ((1, 2, 3), 1100), ((2,), 1060), ((3,), 1020), ((4,), 980), ((5,), 940))],
    *[(f"array_to_string(ls[k:k + {n}], ' ')", 1040 - 20 * n) for n in range(5)],
]
QUERIES["cand_employee_lines"] = _staff_lines
_NOISE = f"NOT regexp_matches(raw, '(?i){x.EMPLOYEE_CONTEXT}') AND regexp_matches(raw, '(?i){x.EMPLOYEE_NOISE}')"
ORACLES["cand_employee_lines"] = with_companies(
    f"""WITH {_ROWS}, raw AS ({" UNION ALL ".join(f"SELECT id, {n} AS n, {s} AS score, {e} AS raw FROM l WHERE form = 0" for n, (e, s) in enumerate(_STAFF))}),
    usable AS (SELECT * FROM raw WHERE raw IS NOT NULL AND NOT ({_NOISE}) AND (n < 9 OR (regexp_matches(raw, '(?i){x.EMPLOYEE_CONTEXT}') AND regexp_matches(raw, '[0-9０-９]'))))
    SELECT id AS company_id, {t.EMPLOYEE_COUNT('raw')} AS value, max(score) AS score FROM usable GROUP BY 1, 2 HAVING value IS NOT NULL"""
)

# --- values that a bar parts from their label
QUERIES["table_like_value"] = lambda spark, sf_dir: (
    decoy_pages(spark, sf_dir)
    .select("company_id", F.posexplode(F.split(pages.strip_html_lines("html"), "\n")).alias("k", "line"))
    .select("company_id", "k", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), lines.barred_value(F.col("line"), labels).alias("value")) for f, labels in (("employee_count", x.EMPLOYEE_LABELS), ("representative_name", lines.REP_LABELS))])))
    .where("value <> ''")
    .groupBy("company_id", "field")
    .agg(F.min_by("value", "k").alias("value"))
)
ORACLES["table_like_value"] = with_companies(
    f"""WITH {_ROWS} SELECT id AS company_id, field, arg_min(value, k) AS value FROM (
      SELECT id, k, 'employee_count' AS field, {_group('line', f'{_STAFF_LEAD}[|｜¦┃‖／/：:]{_W}(.+)$')} AS value FROM l WHERE form = 0
      UNION ALL SELECT id, k, 'representative_name', {_BARRED} FROM l WHERE form = 0) WHERE value IS NOT NULL GROUP BY id, field"""
)
