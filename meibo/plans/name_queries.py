"""Queries of the inspection of representatives' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.functions import names
from meibo.operators import merge
from meibo.schema import companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_HAS = "regexp_replace(coalesce(representative_name, ''), '[\\s　]+', '', 'g') <> ''"
# what the rules make of the names that the test view has
_INSPECTED = f"""(SELECT id AS row_id, company, representative_name AS before_value,
  CASE WHEN representative_name IN ('ご挨拶', '株式会社山田') THEN 'delete' WHEN regexp_matches(representative_name, '　| 様$') THEN 'update' ELSE 'none' END AS action,
  CASE WHEN regexp_matches(representative_name, '　| 様$') THEN replace(regexp_replace(representative_name, ' 様$', ''), '　', ' ') END AS after_value FROM companies WHERE {_HAS})"""
_COLUMNS = ("row_id", "company", "before_value", "action", "after_value")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(names.inspect_names(companies(spark, sf_dir)))
        ORACLES[name] = with_companies(sql)
        return f

    return add


query("inspect_representative", f"SELECT {', '.join(_COLUMNS)} FROM {_INSPECTED}")(lambda i: i.select(*_COLUMNS))
query("inspection_changes", f"SELECT {', '.join(_COLUMNS)} FROM {_INSPECTED} WHERE action = 'update'")(lambda i: names.changes(i, remove=False).select(*_COLUMNS))
query("inspection_excluded", f"SELECT row_id, before_value, 'none' AS action, '候補外' AS reason FROM {_INSPECTED} WHERE action = 'none'")(
    lambda i: names.excluded(i, names.changes(i)).select("row_id", "before_value", "action", "reason")
)
query(
    "inspection_summary",
    f"SELECT count(*) AS total, count(*) FILTER (action = 'update') AS updates, count(*) FILTER (action = 'delete') AS deletes, 0::BIGINT AS reviews, count(*) FILTER (action = 'none') AS skipped FROM {_INSPECTED}",
)(lambda i: names.summary(i, names.changes(i)))


def _changes_joined(spark, sf_dir):
    """Changes of names met with companies of which some are gone and some have a new name since."""
    now = companies(spark, sf_dir)
    changed = names.changes(names.inspect_names(now))
    later = now.where("id % 7 <> 0").withColumn("representative_name", F.when(F.col("id") % 5 == 0, F.lit("新 太郎")).otherwise(F.col("representative_name")))
    out = merge.changes_with_companies(changed, later)
    return out.select("row_id", "action", "before_value", "present_value", "found", "stale")


QUERIES["changes_join_companies"] = _changes_joined
ORACLES["changes_join_companies"] = with_companies(
    f"""SELECT row_id, action, before_value, CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 5 = 0 THEN '新 太郎' ELSE before_value END AS present_value,
    row_id % 7 <> 0 AS found, row_id % 7 = 0 OR row_id % 5 = 0 AS stale FROM {_INSPECTED} WHERE action <> 'none'"""
)


# names among posts, labels and forms of address, each part by its own number; the first five cores are names
_PART = lambda n, values: f"split_part('{'|'.join(values)}', '|', cast(floor(id / {n}) % {len(values)} AS int) + 1)"
_LEADS = ("", "氏名 ", "代表取締役 ", "職名 理事 氏名 ", "交代 ", "代表取締役社長", "取締役会長 代表取締役", "【 】")
_CORES = ("山田 太郎", "佐藤花子", "ジョン スミス", "高橋", "四条畷市", "ご挨拶", "会社概要", "挨拶 経営理念", "未定", "メッセージ・企業理念", "ブログ", "株式会社山田")
_TAILS = ("", " 様", "のプロフィール", " 印", " 先生", "部長", "さん", " 東京大学卒", "（たろう）", "社長 様")
MADE_NAMES = f"SELECT id, {_PART(1, _LEADS)} AS lead, {_PART(8, _CORES)} AS core, {_PART(96, _TAILS)} AS tail, {_PART(1, _LEADS)} || {_PART(8, _CORES)} || {_PART(96, _TAILS)} AS value FROM {{companies}}"


def _read(reading: str):
    return lambda spark, sf_dir: names.read_names(spark.sql(MADE_NAMES, companies=companies(spark, sf_dir)), "value", (reading,)).select("id", "value", reading)


_MADE = MADE_NAMES.format(companies="companies")
_TITLES, _AFTER = "|".join(names.TITLES), "|".join((*names.TITLES, *names.AFTER))


def _stripped(c: str) -> str:
    """Titles off both ends, as often as the made names have them after one another."""
    for _ in range(4):
        c = f"trim(regexp_replace(regexp_replace({c}, '^(?:{_TITLES})+', ''), '(?:{_AFTER})+$', ''))"
    return c


_BARE = "regexp_replace(regexp_replace(value, '[（(][^）)]*[）)]', ' ', 'g'), '[【】]', ' ', 'g')"
_LETTERS = "trim(regexp_replace(regexp_replace(" + _BARE + ", '[^\\p{Han}\\p{Hiragana}\\p{Katakana}A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_MARKED = "trim(regexp_replace(regexp_replace(" + _BARE + ", '[・]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOT = "('ご挨拶', '未定', 'ブログ', '挨拶 経営理念', 'メッセージ・企業理念', 'メッセージ 企業理念')"
QUERIES["rep_strip_affixes"], QUERIES["rep_non_name_exact"], QUERIES["rep_noise_cleanup"] = _read("stripped"), _read("exact"), _read("cleaned")
_FOLDED = "replace(replace(value, '（', '('), '）', ')')"  # the made names have no other wide characters
ORACLES["rep_strip_affixes"] = with_companies(f"SELECT id, value, {_stripped(f'trim({_FOLDED})')} AS stripped FROM ({_MADE})")
ORACLES["rep_non_name_exact"] = with_companies(
    f"SELECT id, value, {' OR '.join(f'{form} IN {_NOT}' for form in ('trim(value)', _LETTERS, _stripped(_LETTERS), _MARKED, _stripped(_MARKED)))} AS exact FROM ({_MADE})"
)
_CUT = "value"
for _pattern in (
    "^職名\\s+.+?\\s+氏名\\s*", "^職名\\s+.+?氏名\\s*", "^氏名\\s*", "^交代\\s+", "\\s*(?:殿|印)$", "\\s+様の活動を$", "\\s+様$", "\\s+氏$", "\\s+先生$", "\\s+[^\\s]*大学[^\\s]*卒$",
    "(?:トップメッセージ|のメッセージ|からの\\s*メッセージ|メッセージ|ごあいさつ|ご挨拶|代表交代のご挨拶|代表挨拶|就任|へ交代|さんの想い|さんが|が出席|のプロフィール|プロフィール|コメント)$",
):
    _CUT = f"trim(regexp_replace({_CUT}, '{_pattern}', ''))"
# what is left is a name if its core is one and nothing else but posts, which count for no part of a name, stands with it
_LEFT = "regexp_matches(cut, '^(?:代表取締役 |代表取締役社長|取締役会長 代表取締役)?(?:山田 太郎|佐藤花子|ジョン スミス|高橋|四条畷市|未定)(?:部長|さん|社長)?$')"
ORACLES["rep_noise_cleanup"] = with_companies(
    f"""SELECT id, value, CASE WHEN cut NOT IN ('', trim(value)) AND (starts_with(lead, '氏名') OR starts_with(lead, '職名') OR starts_with(lead, '交代') OR NOT regexp_matches(value, '部長|社長|代表取締役'))
    AND {_LEFT} THEN cut END AS cleaned FROM (SELECT *, {_CUT} AS cut FROM ({_MADE}))"""
)
