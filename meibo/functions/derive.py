"""Values read out of the company table's free text: places, months, amounts, head counts and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meibo.schema import PREFECTURES, REGIONS

_PREFECTURE = "|".join(PREFECTURES)
# Parent industries with the words that lead to them, first match wins.
INDUSTRY_RULES = (
    ("製造業", "製造業|製造|工業"),
    ("建設業", "建設"),
    ("農業、林業", "農業|林業"),
    ("漁業", "漁業"),
    ("鉱業、採石業、砂利採取業", "鉱業|採石|砂利"),
    ("電気・ガス・熱供給・水道業", "電気|ガス|熱供給|水道"),
    ("情報通信業", "情報|通信|IT|ソフトウェア"),
    ("運輸業、郵便業", "運輸|郵便|物流|倉庫|運送"),
    ("卸売業、小売業", "卸売|小売|販売"),
    ("金融業、保険業", "金融|保険"),
    ("不動産業、物品賃貸業", "不動産|賃貸"),
    ("学術研究、専門・技術サービス業", "学術|研究|専門|技術|士業"),
    ("宿泊業、飲食サービス業", "宿泊|飲食"),
    ("生活関連サービス業、娯楽業", "生活関連|娯楽|理容|美容|クリーニング"),
    ("教育、学習支援業", "教育|学習支援|学校"),
    ("医療、福祉", "医療|福祉|介護"),
    ("複合サービス事業", "複合サービス"),
    ("公務", "公務"),
    ("サービス業（他に分類されないもの）", "サービス"),
)
# Parents of tags with the words that lead to them, first match wins.
TAG_RULES = (
    ("採用媒体", "マイナビ|リクナビ|doda|DODA|Indeed|indeed|エン転職|en転職|type|Wantedly|求人ボックス|スタンバイ|バイトル|ジョブドラフト|キャリタス|あさがく|ワンキャリア|ONE CAREER|新卒|転職"),
    ("教育・行政", "ハローワーク|高校|大学|専門学校|学校|自治体|市役所|県庁"),
    ("業種・職種", "製造|建設|物流|運送|介護|福祉|IT|営業|事務|サービス"),
    ("地域", "北海道|東北|関東|中部|近畿|中国|四国|九州|沖縄|都|道|府|県"),
)
OTHER = "その他"
# Words before or after a head count.
CONSOLIDATED = "連結|consolidated|CONSOLIDATED"
STANDALONE = "単体|単独|個別|individual|INDIVIDUAL|non-consolidated|NON-CONSOLIDATED|nonconsolidated|NONCONSOLIDATED"
EMPLOYMENT = "正社員|正職員|社員|職員|パート|アルバイト|契約社員|契約職員|派遣社員|派遣スタッフ|嘱託|嘱託社員|臨時社員|臨時職員|常勤|非常勤|フルタイム|短時間|再雇用|有期雇用|無期雇用|役員"
PERSONS = r"([0-9]+)[ \t\r\n\f\x0B]*(?:名|人)"
NUMBER = r"^[+-]?(?:[0-9]+(?:[.][0-9]+)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$"
AMOUNT = "decimal(38,6)"


def text(c: str | Column) -> Column:
    """A column as text, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern finds, null if nothing."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def ordered_rules(value: Column, rules, default: str) -> Column:
    """The name of the first rule whose words the value holds."""
    start = F.when(value.rlike(rules[0][1]), rules[0][0])
    return reduce(lambda w, r: w.when(value.rlike(r[1]), r[0]), rules[1:], start).otherwise(default)


def prefecture(address: str = "address") -> Column:
    """The first prefecture named anywhere in an address."""
    return found(F.trim(text(address)), f"({_PREFECTURE})")


def city(address: str = "address") -> Column:
    """The shortest municipality after a prefecture; it has no digit, space or hyphen."""
    return found(F.trim(text(address)), f"(?:{_PREFECTURE})([^0-9０-９ 　－-]+?(?:市|区|町|村))")


def region(pref: Column) -> Column:
    """The region of a prefecture."""
    pairs = [F.lit(x) for r, ps in REGIONS.items() for p in ps for x in (p, r)]
    return F.element_at(F.create_map(*pairs), pref)


def established_ym(c: str = "established_date") -> Column:
    """Year and month: the first six of six or more digits, else a year and the digits after it."""
    t = text(c)
    digits = F.regexp_replace(t, "[^0-9]", "")
    year, month = found(t, "([12][0-9]{3})"), found(t, "[12][0-9]{3}[^0-9]*([0-9]{1,2})")
    return (
        F.when(F.trim(t) == "", None)
        .when(F.length(digits) >= 6, F.substring(digits, 1, 6))
        .when(year.isNotNull() & month.isNotNull(), F.concat(year, F.lpad(month, 2, "0")))
    )


def capital_numeric(c: str = "capital") -> Column:
    """A plain number as it stands, else all digits joined; units are not looked at, overflow is null."""
    t = F.trim(text(c))
    digits = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(t.rlike(NUMBER), t.try_cast(AMOUNT)).when(digits != "", digits.try_cast(AMOUNT))


def employee_numeric(c: str = "employee_count") -> Column:
    """The head count: consolidated, else the sum of two or more kinds of employment, standalone, the largest, digits alone."""
    t = F.regexp_replace(text(c), "[,，]", "")
    number = lambda x: x.try_cast(AMOUNT)
    before = lambda words: number(found(t, f"(?:{words})[^0-9]{{0,12}}{PERSONS}"))
    after = lambda words: number(found(t, f"{PERSONS}[^0-9]{{0,12}}(?:{words})"))
    every = lambda pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), number)
    kinds = every(f"(?:{EMPLOYMENT})[^0-9]{{0,12}}{PERSONS}")
    total = F.aggregate(kinds, F.lit(0).cast(AMOUNT), lambda a, x: (a + x).cast(AMOUNT))
    return F.coalesce(
        before(CONSOLIDATED),
        after(CONSOLIDATED),
        F.when(F.size(kinds) >= 2, total),
        before(STANDALONE),
        after(STANDALONE),
        F.array_max(every(PERSONS)),
        F.when(t.rlike("^[0-9]+$"), number(t)),
    )


def industry_parent(c: str = "big_industry") -> Column:
    """The parent of an industry name."""
    return ordered_rules(F.trim(text(c)), INDUSTRY_RULES, OTHER)


def tag_parent(tag: Column) -> Column:
    """The parent of one tag."""
    return ordered_rules(F.trim(tag), TAG_RULES, OTHER)


def tags(c: str = "tag") -> Column:
    """The tags of a company: text between semicolons, trimmed, blank ones dropped."""
    parts = F.transform(F.split(text(c), r"\s*;\s*"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def enrich_companies(df):
    """Companies with every derived column, so that filters and facets read columns instead of patterns."""
    out = df.withColumns(
        {
            "prefecture": prefecture(),
            "city": city(),
            "established_ym": established_ym(),
            "capital_numeric": capital_numeric(),
            "employee_numeric": employee_numeric(),
            "industry_parent": industry_parent(),
            "tags": tags(),
        }
    )
    return out.withColumn("region", region(F.col("prefecture")))
