"""Normal forms of phone numbers, addresses of all kinds, names and amounts, as column functions.

Each takes a column name or Column and gives null where there is no normal form. A null value has
none either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meibo.functions.derive import found, text
from meibo.schema import PREFECTURES

WHITE = r"[\s 　﻿]"
#: The characters of ``WHITE``.
_ENDS = " \t\n\x0b\f\r\u00a0\u3000\ufeff"
LEGAL = "株式会社|有限会社|合同会社|合資会社|合名会社"
# Fixed values, here and below: references of page text, titles that name no company, labels and words of phone numbers, faxes, head counts,
# addresses and businesses, and the words that end them.
REFERENCES = ((r"(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"))
PAGE_TITLES = "top|home|ホーム|トップページ|latest news|最新情報|news|recruit|contact"
PAGE_TITLES_MORE = PAGE_TITLES + "|会社情報|会社概要|企業情報|企業概要|アクセス|about|company|information"
PHONE_LABELS = "TEL|電話番号|電話|本社電話番号|代表電話|連絡先"
FAX_LABELS = "FAX|ＦＡＸ|ファックス"
WEAK_PHONE = (
    "採用|求人|募集|応募|エントリー|人事|採用担当|リクルート|recruit|career|job|jobs|entry|予約|予約専用|来店予約|問い合わせ専用|お客様相談|"
    "カスタマー|サポート|ヘルプ|コールセンター|フリーダイヤル|ナビダイヤル|携帯|スマートフォン|直通|担当直通|緊急|夜間|休日|個人|店舗|ショップ|店頭|"
    "資料請求|セミナー|イベント"
)
REPRESENTATIVE_LABELS = "本社電話番号|代表電話|代表番号|電話番号|電話|TEL"
EMPLOYEE_CONTEXT = (
    "従業員|社員|職員|スタッフ|人員|メンバー|就業人数|就業者数|連結|単体|単独|個別|グループ社員|正社員|正職員|パート|アルバイト|契約社員|契約職員|"
    "派遣社員|派遣スタッフ|嘱託|常勤|非常勤"
)
EMPLOYEE_NOISE = (
    "採用人数|募集人数|募集人員|採用予定人数|新卒採用|中途採用|採用実績|定員|参加人数|来場者数|利用者数|入居者数|患者数|園児数|"
    "生徒数|学生数|会員数|登録者数|フォロワー数|閲覧数|PV|座席数|病床数|車両数|保有台数|台数|戸数|件数|"
    "施工件数|実績数|店舗数|拠点数|事業所数|営業所数|学校数|顧客数|取引先数|掲載社数|導入社数|売上|売上高|年商|"
    "資本金|設立|創業|沿革|年|月|日"
)
#: The label of a head count, words that stand near one, and labels that begin a line of one.
EMPLOYEE_MAIN = "従業員数"
EMPLOYEE_NEAR = "従業員数|従業員|社員数|職員数|スタッフ数|人員数|総人員|就業人数|就業者数"
EMPLOYEE_LABELS = (
    "従業員数|従業員|総従業員数|全従業員数|連結従業員数|単体従業員数|単独従業員数|個別従業員数|グループ従業員数|グループ社員数|グループ社員合計|社員数|社員合計|"
    "職員数|職員合計|スタッフ数|スタッフ人数|在籍スタッフ数|人員構成|人員数|総人員|メンバー数|就業人数|就業者数|従業員合計|常勤職員数|非常勤職員数|常勤社員数|"
    "非常勤社員数|従業員規模"
)
CONSOLIDATED, STANDALONE = ("連結", "consolidated"), ("単体", "単独", "個別", "individual", "non-consolidated", "nonconsolidated")
EMPLOYMENT = (
    "正社員|正職員|社員|職員|パート|アルバイト|契約社員|契約職員|派遣社員|派遣スタッフ|嘱託|嘱託社員|臨時社員|臨時職員|常勤|非常勤|フルタイム|短時間|再雇用|"
    "有期雇用|無期雇用|役員"
)
_PERSONS = rf"([0-9][0-9,]*){WHITE}*(?:名|人)"
#: What may stand between a label and its value on a line.
BARS = "|｜¦┃‖／/：:"
ADDRESS_LABELS = (
    "所在地|住所|本社所在地|本店所在地|支店所在地|営業所所在地|工場所在地|事業所所在地|本社住所|本店住所|本社|本店|支店|営業所|工場|事業所|"
    r"(?:[^\s　]+(?:工場|支店|営業所|事業所))"
)
ADDRESS_TAILS = "営業部|総務部|生産部|管理部|品質管理部|技術部|開発部|工務部|経理部|人事部|企画部|購買部|物流部|業務部|連絡先|本社|本店|支店|営業所|工場|事業所"
ADDRESS_ENDS = (
    "連絡先|アクセス方法|アクセス|TEL|電話|FAX|営業時間|定休日|MAP|Google|メール|E-mail|E-mai|Mail|お問合せ|お問い合わせ|Copyright|著作権|"
    "All Rights Reserved|業種|創業|設立|資本金|従業員数|取引先|Top Message|代表ご挨拶|Our Philosophy|Our Policy|History|沿革|Access|Contact|会社情報|"
    "事業紹介|設備紹介|お知らせ|営業部|総務部|生産部|管理部|品質管理部|技術部|開発部|工務部|経理部|人事部|企画部|購買部|物流部|業務部|代表者|代表取締役|"
    "事業内容|本社電話番号|電話番号"
)
ADDRESS_NOISE = (
    "採用|求人|募集|応募|エントリー|リクルート|求人広告|事業に採択|アンバサダー|マーケティング|市場|対抗|サービス|ニュース|お知らせ|ブログ|コラム|実績|事例|"
    "プレスリリース|パートナー|株式会社|有限会社|合同会社|Copyright|All Rights Reserved"
)
ADDRESS_CONTACTS = "TEL|電話|FAX|メール|E-mail|Mail"
ADDRESS_DETAIL = r"[0-9０-９]|丁目|番地?|号|[-－ー―]|大字|字|条|線|通|ビル|ビルディング|センター|階"
_K = "[一-龠々ぁ-んァ-ヶー]+"
MUNICIPALITY = f"(?:{_K}市[一-龠々ぁ-んァ-ヶー]*区?|{_K}郡{_K}町|{_K}郡{_K}村|{_K}区|{_K}町|{_K}村)"
BUSINESS_LABELS = "事業内容|業務内容|営業内容|サービス内容|事業概要|業容|取扱業務|取扱内容|取扱商品|主な事業|業務案内|サービス"
BUSINESS_ENDS = "所在地|連絡先|TEL|FAX|営業時間|定休日|お問い合わせ|お問合せ|会社概要"
BUSINESS_NOT = "お問い合わせ|お問合せ|スタッフ紹介|仕事紹介|サービス紹介|NEWS|BLOG|COLUMN|会社概要|所在地|連絡先"
BUSINESS_HINTS = "事業|業務|販売|企画|請負|開発|分譲|売買|施工|設計|運営|介護|福祉|サービス|広告|製造|卸|小売|コンサル|代理店|保険|デイサービス"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tree(words: list[str]) -> str:
    """A pattern of words that begins each common start once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    out = []
    for head, rest in by.items():
        if "" in rest:
            out.append(re.escape(head))  # a longer word begins with this one
        else:
            out.append(re.escape(head) + (_tree(rest) if len(rest) == 1 else f"(?:{_tree(rest)})"))
    return "|".join(out)


def _alternatives(pattern: str) -> tuple[list[str], list[str]]:
    """The words of an alternation, and those of its alternatives that are more than a word; all of it if a group holds a bar."""
    some = list(dict.fromkeys(pattern.split("|")))
    if re.search(r"[(\[][^)\]]*\|", pattern):
        return [], [pattern]
    plain = [w for w in some if re.escape(w).replace("\\-", "-") == w]
    return plain, [w for w in some if w not in plain]


def _joined(plain: list[str], more: list[str]) -> str:
    """Words of ASCII and others apart, each tried only where a letter may begin one."""
    narrow, wide = [w for w in plain if w[0] < "\x80"], [w for w in plain if w[0] >= "\x80"]
    out = [rf"(?=[{re.escape(''.join(dict.fromkeys(w[0] for w in narrow)))}])(?:{_tree(narrow)})"] if narrow else []
    return "|".join([*out, *([rf"(?=[^\x00-\x7F])(?:{_tree(wide)})"] if wide else []), *more])


def starts(pattern: str) -> str:
    """An alternation as a pattern that tells of the same places, with or without ``(?i)``, whether one of the words stands there."""
    return _joined(*_alternatives(pattern))


def holds(pattern: str) -> str:
    """An alternation as a pattern that the same texts hold, with or without ``(?i)``: without words that hold another of them."""
    plain, more = _alternatives(pattern)
    return _joined([w for w in plain if not any(v != w and v in w for v in plain)], more)


def col(c: str | Column) -> Column:
    return text(c)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """``found`` that names ``c`` once, however deep it is."""
    return once(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", v))


def trim_all(c: str | Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(col(c), F.lit(_ENDS))


def nullable(c: str | Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(trim_all(c), F.lit(""))


def digits(c: Column) -> Column:
    """Full-width digits as ASCII ones; texts without them are left alone, since ``translate`` makes a string of each character."""
    return once(c, lambda t: F.when(t.rlike("[０-９]"), F.translate(t, "０１２３４５６７８９", "0123456789")).otherwise(t))


def space(c: str | Column) -> Column:
    """Character references decoded, runs of white space one space, ends trimmed."""
    decoded = lambda t: F.when(F.contains(t, F.lit("&")), reduce(lambda t, r: F.regexp_replace(t, *r), REFERENCES, t)).otherwise(t)
    out = once(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")), decoded)
    return trim_all(F.regexp_replace(F.regexp_replace(out, r"[\r\n\t]", " "), f"{WHITE}{{2,}}", " "))


def plain(c: str | Column) -> Column:
    return digits(space(c))


def format_phone(c: str | Column) -> Column:
    """Ten or eleven digits that begin with 0, hyphens put by the kind of number."""

    def shaped(d: Column) -> Column:
        n = F.length(d)
        cut = lambda a, b: F.concat_ws("-", F.substring(d, 1, a), F.substring(d, a + 1, b), F.substring(d, a + b + 1, 11))
        return (
            F.when(~d.rlike(r"^0\d{9,10}$"), None)
            .when(d.rlike(r"^(070|080|090|050|020)\d{8}$"), cut(3, 4))
            .when(d.rlike(r"^0120\d{6}$"), cut(4, 3))
            .when(d.rlike(r"^0570\d{6}$"), cut(4, 2))
            .when(d.rlike(r"^(03|06)\d{8}$"), cut(2, 4))
            .when(n == 10, cut(4, 2))
            .otherwise(cut(3, 4))
        )

    return once(F.regexp_replace(col(c), r"[^0-9]", ""), shaped)


def _unbracketed(c: str | Column) -> Column:
    return F.regexp_replace(plain(c), "[()（）]", "-")


def phone(c: str | Column) -> Column:
    """The labelled number, else the first one that stands by itself and has ten or eleven digits."""
    length = lambda x: F.length(F.regexp_replace(x, r"\D", ""))

    def number(t: Column) -> Column:
        labelled = F.regexp_extract_all(t, F.lit(rf"(?i)(?:{PHONE_LABELS}){WHITE}*[:：.]?{WHITE}*(0[\d\s-]{{8,13}}\d)"), F.lit(1))
        shapes = F.regexp_extract_all(t, F.lit(r"(?<!\d)(0\d{1,4}[-\s]?\d{1,4}[-\s]?\d{3,4})(?=$|\D)"), F.lit(1))
        return F.coalesce(F.get(labelled, F.lit(0)), F.get(F.filter(shapes, lambda x: length(x).between(10, 11)), F.lit(0)))

    return format_phone(once(_unbracketed(c), number))


def landline(c: str | Column) -> Column:
    """True for ten or eleven digits of no mobile, IP or free number."""
    d = F.regexp_replace(col(c), r"[^0-9]", "")
    return d.rlike(r"^0\d{9,10}$") & ~d.rlike("^(070|080|090|050|020|0120|0570|0800)")


def fax_only(c: str | Column) -> Column:
    return once(plain(c), lambda t: t.rlike(f"(?i){FAX_LABELS}") & ~t.rlike(f"(?i){REPRESENTATIVE_LABELS}"))


def representative_phone(c: str | Column) -> Column:
    """A phone number that is a landline and does not stand in a line about fax alone."""
    return F.when(~fax_only(c), once(phone(c), lambda p: F.when(landline(p), p)))


def weak_phone_context(c: str | Column) -> Column:
    """A line about recruiting, support, shops and the like; an empty line is weak too."""
    return once(plain(c), lambda t: (t == "") | t.rlike(f"(?i){holds(WEAK_PHONE)}"))


def phone_label_context(c: str | Column) -> Column:
    """A line that is a label of a main phone number, and neither weak nor about fax alone."""
    t = plain(c)
    return t.rlike(f"(?i)^(?:{REPRESENTATIVE_LABELS})$") & ~fax_only(c) & ~weak_phone_context(c)


def employee_context(c: str | Column) -> Column:
    """A line that speaks of a head count."""
    return plain(c).rlike(f"(?i){holds(EMPLOYEE_CONTEXT)}")


def employee_noise(c: str | Column) -> Column:
    """A line about other numbers and not about a head count; an empty line is noise too."""
    return once(plain(c), lambda t: (t == "") | (~t.rlike(f"(?i){holds(EMPLOYEE_CONTEXT)}") & t.rlike(f"(?i){holds(EMPLOYEE_NOISE)}")))


_LOCATION = rf"(?:(?:{'|'.join(PREFECTURES)}){WHITE}*)?{MUNICIPALITY}"


def likely_address(c: str | Column) -> Column:
    """8 to 120 characters with a municipality and a detail after it, and no words of other matter."""

    def test(t: Column) -> Column:
        odd = t.rlike(f"(?i){holds(f'{ADDRESS_NOISE}|{ADDRESS_CONTACTS}|@')}|[。！？!?]")
        detail = F.regexp_extract(t, f"(?s){_LOCATION}(.*)$", 1)
        return F.char_length(t).between(8, 120) & ~odd & detail.rlike(f"(?i){ADDRESS_DETAIL}")

    return once(plain(c), test)


def _without_tail(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, rf"{WHITE}*(?:{ADDRESS_TAILS}){WHITE}*$", ""), rf"{WHITE}{{2,}}", " "))


def address_core(c: str | Column) -> Column:
    """From prefecture or municipality up to the first word of other matter; null if that is no address."""
    t = F.regexp_replace(plain(c), rf"(?i)^(?:{ADDRESS_LABELS}){WHITE}*[:：]?{WHITE}*", "")
    t = trim_all(F.regexp_replace(F.regexp_replace(t, rf"(?:〒{WHITE}*)?\d{{3}}-?\d{{4}}{WHITE}*", ""), rf"{WHITE}{{2,}}", " "))
    place = _found(t, f"(?s)({_LOCATION}.*)$")
    out = _without_tail(F.regexp_replace(place, rf"(?i){WHITE}*(?:{starts(ADDRESS_ENDS)}).*$", ""))
    return once(out, lambda x: F.when(likely_address(x), x))


def address(c: str | Column) -> Column:
    """The core of an address without a label or contact data at its end."""
    cut = lambda core: _without_tail(F.regexp_replace(core, rf"(?i){WHITE}*(?:連絡先|アクセス方法|アクセス|(?:{ADDRESS_CONTACTS}|営業時間|定休日|MAP|Google|E-mai|お問合せ|お問い合わせ).*)$", ""))
    return once(address_core(c), lambda core: once(cut(core), lambda x: F.when((x == core) | likely_address(x), x)))


def iso_datetime(c: str | Column) -> Column:
    """A date or time as ISO text in UTC with milliseconds; null if it is none."""
    t = F.regexp_replace(nullable(c), "/", "-")
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fax(c: str | Column) -> Column:
    """The labelled fax number, else a text of nothing but a number."""
    label = rf"(?i)(?:{FAX_LABELS}){WHITE}*[:：.]?{WHITE}*(0[\d\s-]{{8,13}}\d)"
    number = lambda t: F.coalesce(_found(t, label), F.when(t.rlike(r"^[0-9\s-]+$"), t))
    return once(once(_unbracketed(c), number), lambda n: F.when(n.isNotNull(), format_phone(n)))


def zipcode(c: str | Column) -> Column:
    first = lambda t: F.when(t.rlike("[0-9０-９]{3}-?[0-9０-９]{4}"), _found(plain(t), r"\d{3}-?\d{4}", 0))
    return F.regexp_replace(once(col(c), first), r"^(\d{3})-?", "$1-")


def email(c: str | Column) -> Column:
    return once(col(c), lambda t: F.when(F.contains(t, F.lit("@")), _found(space(t), r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0)))


def established(c: str | Column) -> Column:
    """Year and, if digits follow near it, month."""
    pattern = "([12][0-9]{3})[^0-9]{0,3}([0-9]{1,2})?"
    month = lambda t: F.coalesce(F.concat(_found(t, pattern, 2).cast("int").cast("string"), F.lit("月")), F.lit(""))
    return once(space(c), lambda t: F.concat(_found(t, pattern), F.lit("年"), month(t)))


def capital(c: str | Column) -> Column:
    """The first amount with its unit, else the text."""
    return once(space(c), lambda t: F.coalesce(_found(t, r"[0-9,\.]+(?:億円|億|千万円|百万円|万円|円)", 0), F.when(t != "", t)))


def _count(c: Column) -> Column:
    """Digits with commas as a number; null if there are none."""
    return F.regexp_replace(c, ",", "").try_cast("decimal(38,0)")


def _counted(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.format_number(n, 0), F.lit("名")))


def employee_count(c: str | Column) -> Column:
    """The head count that a text gives, as ``1,234名``: the first of these rules that finds a number decides.

    A number of persons right after the main label; the consolidated count; the sum over kinds of
    employment, if two or more are counted; the count of the company alone; a bare number after a label
    that begins the text; in a text that speaks of employees, a number near one of their words. A
    consolidated or single count of 0 gives null.
    """

    def rules(t: Column) -> Column:
        named = lambda w: t.rlike(f"(?i){w}") if w.isascii() else F.contains(t, F.lit(w))
        beside = lambda w: F.when(named(w), F.coalesce(_count(_found(t, rf"(?i){w}[^0-9]{{0,12}}{_PERSONS}")), _count(_found(t, rf"(?i){_PERSONS}[^0-9]{{0,12}}{w}"))))
        main = _count(_found(t, rf"{EMPLOYEE_MAIN}{WHITE}*[{BARS}]?{WHITE}*{_PERSONS}"))
        group = F.coalesce(*[beside(w) for w in CONSOLIDATED])
        kinds = F.regexp_extract_all(t, F.lit(rf"(?:{EMPLOYMENT})[^0-9]{{0,12}}{_PERSONS}"), F.lit(1))
        total = lambda k: F.aggregate(k, F.lit(0).cast("decimal(38,0)"), lambda n, k: (n + _count(k)).cast("decimal(38,0)"))
        alone = F.coalesce(*[beside(w) for w in STANDALONE])
        bare = _count(_found(t, rf"^(?:{EMPLOYEE_LABELS}){WHITE}*[:：]?{WHITE}*([0-9][0-9,]*)$"))
        near = F.when(employee_context(t), _count(_found(t, rf"(?:{EMPLOYEE_NEAR})[^0-9]{{0,20}}{_PERSONS}")))
        first = lambda n, test, other: once(n, lambda v: F.when(test(v), _counted(v)).otherwise(other))
        given, positive = (lambda v: v.isNotNull()), (lambda v: v > 0)
        summed = once(kinds, lambda k: F.when(F.size(k) >= 2, total(k)))
        out = once(near, _counted)
        for n, test in ((bare, given), (alone, given), (summed, positive), (group, given), (main, positive)):
            out = first(n, test, out)
        return out

    return F.when(col(c).rlike("[0-9０-９]"), once(F.regexp_replace(plain(c), "，", ","), rules))


def business_content(c: str | Column) -> Column:
    """The text without its label and what follows it, bullets as lines, 300 characters at most; null if it is no business."""

    def cut(t: Column) -> Column:
        t = F.regexp_replace(t, rf"(?i)^({BUSINESS_LABELS}){WHITE}*[:：]?{WHITE}*", "")
        t = F.regexp_replace(t, rf"(?i){WHITE}*(?:{BUSINESS_ENDS}).*$", "")
        t = F.regexp_replace(F.regexp_replace(t, rf"{WHITE}*・", "\n・"), rf"{WHITE}*[●■◆◉○]{WHITE}*", "\n・")
        return once(trim_all(F.regexp_replace(t, r"\n{2,}", "\n")), short)

    def short(t: Column) -> Column:
        good = (F.length(t) >= 8) & ~t.rlike(f"(?i){BUSINESS_NOT}") & t.rlike(f"{BUSINESS_HINTS}|[・●■◆]")
        return F.when(good, F.when(F.length(t) > 300, F.concat(F.substring(t, 1, 300), F.lit("…"))).otherwise(t))

    return once(space(c), lambda t: F.when(t != "", cut(t)))


def permit_category(c: str | Column) -> Column:
    """Which of the two licence numbers a text names."""
    def category(dispatch: Column, placement: Column) -> Column:
        return F.when(dispatch & placement, "労働者派遣・有料職業紹介").when(dispatch, "労働者派遣").when(placement, "有料職業紹介")

    dispatch = lambda t: t.rlike(r"(?i)派\s*[0-9]{2}\s*[-－ー―]\s*[0-9]{6}")
    placement = lambda t: F.contains(t, F.lit("ユ")) & t.rlike(r"(?i)[0-9]{2}\s*[-－ー―]\s*ユ\s*[-－ー―]\s*[0-9]{6}")
    return once(digits(col(c)), lambda t: once(dispatch(t), lambda d: once(placement(t), lambda p: category(d, p))))


def company_name(c: str | Column) -> Column:
    """Of a page title's parts, the first with a legal form, else the first that is no page's title."""

    def parts(t: Column) -> Column:
        every = F.transform(F.split(t, rf"{WHITE}*[|｜]{WHITE}*|{WHITE}+[ー―_・]{WHITE}+"), trim_all)
        return F.filter(every, lambda x: (x != "") & ~x.rlike(f"(?i)^({PAGE_TITLES_MORE})$"))

    legal = lambda some: F.filter(some, lambda x: x.rlike(rf"(?i){LEGAL}|Inc\.?|Co\.\s*,?\s*Ltd\.?"))
    first = lambda some: F.coalesce(F.get(legal(some), F.lit(0)), F.get(some, F.lit(0)))
    return once(space(c), lambda t: F.when(t != "", once(parts(t), first)))


def company_name_in(c: str | Column) -> Column:
    """The first name with a legal form in a text."""
    hits = lambda t: F.regexp_extract_all(space(t), F.lit(rf"((?:{LEGAL})\s*[^\s　]{{1,40}}|[^\s　]{{1,40}}(?:{LEGAL}))"), F.lit(1))
    # names are made of the hits up to the first that is one
    name = lambda t: F.aggregate(hits(t), F.lit(None).cast("string"), lambda n, hit: F.coalesce(n, company_name(hit)))
    return once(col(c), lambda t: F.when(F.contains(t, F.lit("会社")), name(t)))


def likely_company_name(c: str | Column) -> Column:
    return (col(c) != "") & ~col(c).rlike(f"(?i)^({PAGE_TITLES})$")


def seed_url(c: str | Column) -> Column:
    t = space(c)
    return F.when(t == "", None).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def url_variants(c: str | Column) -> Column:
    """The URL with https and with http."""
    bare = F.regexp_replace(seed_url(c), "(?i)^https?://", "")
    return F.when(bare.isNotNull(), F.array(F.concat(F.lit("https://"), bare), F.concat(F.lit("http://"), bare)))


def without_hash(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "#.*$", "")


def contact_key(c: str | Column) -> Column:
    """A number's digits, the country code 81 as 0; empty if there are none."""
    d = F.regexp_replace(digits(trim_all(c)), "[^0-9]", "")
    return F.when(d.startswith("81") & (F.length(d) >= 11), F.concat(F.lit("0"), F.substring(d, 3, 100))).otherwise(d)


def contact_candidate(c: str | Column) -> Column:
    """The first shape of a Japanese number, kinds of hyphens and spaces as one hyphen."""
    t = F.regexp_replace(F.regexp_replace(plain(c), "[－ー―]", "-"), f"{WHITE}+", "-")
    return F.regexp_replace(found(t, r"(?:\+?81-?)?0[0-9]{1,4}-?[0-9]{1,4}-?[0-9]{3,4}", 0), "-+", "-")


def unique_texts(values: Column) -> Column:
    """Trimmed values that are not blank, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, nullable), lambda x: x.isNotNull()))


def contact_candidates(c: str | Column) -> Column:
    """Parts between lines and semicolons if several, else all number shapes if several, else the text."""
    t = trim_all(c)
    parts = F.filter(F.transform(F.split(t, r"\r?\n|[;；]"), trim_all), lambda x: x != "")
    shape = r"((?:[^。\n\r;；、,]*?[：:]\s*)?(?:\+?81[-－ー―\s]?)?0[0-9０-９]{1,4}[-－ー―\s]?[0-9０-９]{1,4}[-－ー―\s]?[0-9０-９]{3,4})"
    shapes = F.regexp_extract_all(t, F.lit(shape), F.lit(1))
    return unique_texts(F.when(F.size(parts) > 1, parts).when(F.size(shapes) > 1, shapes).otherwise(F.array(t)))


def strip_corporate(c: str | Column) -> Column:
    return trim_all(F.regexp_replace(col(c), rf"{LEGAL}|㈱|（株）|\(株\)", ""))


def compare_key(c: str | Column) -> Column:
    """Without white space, in lower case, full-width letters and digits as ASCII ones."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F))
    return F.lower(F.regexp_replace(F.translate(col(c), wide, narrow), f"{WHITE}+", ""))


def local_ip(c: str | Column) -> Column:
    """An address trimmed; the machine's own by name, null if blank."""
    t = nullable(c)
    return F.when(t.isin("::1", "127.0.0.1", "::ffff:127.0.0.1"), "ローカル環境").otherwise(t)


def request_ip(forwarded: str, real: str | None = None, connecting: str | None = None) -> Column:
    """The first address that a request was forwarded for, else the other headers'."""
    heads = [local_ip(F.get(F.split(col(forwarded), ","), F.lit(0))), *[local_ip(c) for c in (real, connecting) if c]]
    return F.coalesce(*heads, F.lit("取得できません"))


def browser_label(agent: str | Column) -> Column:
    a = col(agent)
    return (
        F.when(a.rlike("(?i)Edg/"), "Edge")
        .when(a.rlike("(?i)Chrome/|CriOS/"), "Chrome")
        .when(a.rlike("(?i)Firefox/|FxiOS/"), "Firefox")
        .when(a.rlike("(?i)Safari/"), "Safari")
        .otherwise("不明")
    )


#: What ``standardize`` puts in a field's place.
STANDARD = {
    "phone": phone, "fax": fax, "zipcode": zipcode, "email": email, "website_url": lambda c: without_hash(seed_url(c)),
    "capital": capital, "employee_count": employee_count, "established_date": established,
}


def standardize(df, fields: tuple[str, ...] = tuple(STANDARD)):
    """Companies with standard forms where there is one, and ``changed``: the fields that differ from before."""
    new = {f: F.coalesce(F.when(F.col(f).isNull(), None).otherwise(nullable(STANDARD[f](f))), F.col(f)) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~v.eqNullSafe(F.col(f)), F.lit(f)) for f, v in new.items()]))
    return df.withColumn("changed", changed).withColumns({f: v for f, v in new.items()})
