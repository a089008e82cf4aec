"""Candidates from a page's lines: who represents a company, how many it employs, where it is, and labelled values.

A rule looks at one line and the lines after it, and names the value it may hold with a score. Rules are
column functions over rows of lines (``pages.parts`` makes them, white space already as ``text.space`` leaves it), so that a page's lines are rated where
they are and only what a rule finds is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meibo.functions import text as x

W = x.WHITE
# Fixed values, down to the rules: labels and titles that stand with a representative's name, and words that are none.
REP_LABELS = "代表者|代表者名|代表者氏名|代表氏名|代表取締役|代表取締役社長|代表取締役会長|取締役社長|代表社員|代表理事|理事長|社長|会長|代表|所長|センター長|学院長|校長|学長|施設長|室長"
REP_HIT = "代表者|代表氏名|代表取締役|代表社員|代表理事|理事長|^(?:取締役社長|社長|会長|代表|所長|センター長|学院長|校長|学長|施設長|室長)$"
REP_INLINE = "代表者名|代表者氏名|代表氏名|代表取締役社長|代表取締役会長|代表取締役|取締役社長|代表社員|代表理事|代表者"
REP_EXACT = "代表者氏名|代表氏名|代表者名?|代表者|代表取締役(?:社長|会長)?|取締役社長|代表社員|代表理事|理事長|社長|会長|所長|センター長|学院長|校長|学長|施設長|室長"
REP_TITLES = "代表取締役社長|代表取締役会長|代表取締役|取締役社長|代表社員|代表理事|理事長|会長|社長"
REP_BEHIND = "代表取締役(?:社長|会長)?|取締役社長|取締役|代表社員|代表理事|理事長|社長|会長|代表"
CRAFTS = "一級塗装技能士|二級塗装技能士|一級建築士|二級建築士|建築士|大工"
REP_ALONE = f"代表取締役(?:社長|会長)?|取締役社長|代表社員|代表理事|理事長|社長|会長|{CRAFTS}"
POSTS = (
    "代表取締役(?:社長|会長)?|取締役社長|取締役|代表社員|代表理事|理事長|社長|会長|代表者?|代表|執行役員(?:専務|常務)?|常務取締役?|専務取締役?|常務|専務|相談役|"
    f"名誉相談役|所長|センター長|学院長|校長|学長|施設長|室長|{CRAFTS}"
)
NO_REP = (
    "挨拶", "ご挨拶", "代表挨拶", "社長挨拶", "理事長挨拶", "トップメッセージ", "メッセージ", "氏名", "代表者", "代表者名", "代表者氏名", "代表", "社長", "会長", "理事長", "役員",
    "役員一覧", "会社概要", "会社情報", "企業情報", "基本情報",
)
REP_COMPANY = "株式会社|有限会社|合同会社|合資会社|合名会社|御中"
PARTICLES = "が|は|を|に|で|と|の|へ|も|から|より|まで"
SENTENCE = "です|ます|ました|おります|いたします|ください|について|ため|功績|感謝状|受賞|表彰|加入者|機構|業界|セーフティネット|支援|サービス|事業|会社|情報|一覧|詳細|こちら"
REP_STRONG_PAGE = "会社概要(?:・沿革)?|会社案内|会社情報|企業情報|法人概要|企業概要|会社データ|会社紹介|会社基本情報|基本情報|outline|profile|company|corporate|about|gaiyou|overview|information"
REP_ABOUT_PAGE = r"(?:当社|弊社|私たち|わたしたち|会社|企業|法人|事務所|株式会社[^\s　/]{0,30}|有限会社[^\s　/]{0,30}|合同会社[^\s　/]{0,30})について"
REP_GREETING_PAGE = "代表挨拶|社長挨拶|理事長挨拶|所長挨拶|ご挨拶|トップメッセージ|topmessage|greeting|message|president"
REP_WEAK_PAGE = "役員一覧|officer|executive|member|staff"
# labels of head counts, what ends a value or a section of one, and pages that give one
STAFF_HIT = "従業員|社員数|社員合計|職員数|職員合計|スタッフ数|スタッフ人数|人員構成|人員数|総人員|メンバー数|就業人数|就業者数"
REP_WORDS = f"代表|社長|会長|理事長|取締役|{CRAFTS}|所長|センター長|学院長|校長|学長|施設長|室長"
STAFF_MAIN = "従業員数|総従業員数|全従業員数|連結従業員数|単体従業員数|単独従業員数|個別従業員数"
STAFF_BOUNDS = (
    "会社名|商号|代表取締役|代表者|所在地|住所|電話番号|TEL|ＦＡＸ|FAX|従業員数|従業員|総従業員数|全従業員数|連結従業員数|単体従業員数|単独従業員数|個別従業員数|グループ従業員数|"
    "グループ社員数|グループ社員合計|社員数|社員合計|職員数|職員合計|スタッフ数|スタッフ人数|在籍スタッフ数|人数|総人数|在籍人数|人員構成|人員|人員数|総人員|メンバー数|就業人数|"
    "就業者数|従業員合計|常勤職員数|非常勤職員数|常勤社員数|非常勤社員数|従業員規模|事業内容|設立|創業|資本金|アクセス|お問い合わせ|営業時間|受付時間|最寄りの交通機関|MAP"
)
STAFF_ENDS = "会社名|商号|代表取締役|代表者|所在地|住所|電話番号|TEL|ＦＡＸ|FAX|従業員数|事業内容|設立|創業|資本金|アクセス|お問い合わせ|営業時間|受付時間|最寄りの交通機関|MAP"
STAFF_PAGE = "会社概要|企業情報|会社案内|会社情報|法人概要|企業概要|会社データ|会社基本情報|基本情報|company|corporate|about|outline|profile|overview|information"
# labels of addresses and postal codes
ADDRESS_HIT = "所在地|住所|本社|本店|支店|営業所|工場|事業所|アクセス|郵便番号|〒"
#: What every address holds.
AREA = "[市区町村]"
ADDRESS_LABEL, ZIP_LABEL = "所在地|住所|本社|本店|支店|営業所|工場|事業所|アクセス", "郵便番号|〒"

_LETTERS = r"[\p{IsHan}\p{IsKatakana}\p{IsHiragana}々ヶヵーA-Za-z]"
_GAP = r"[\s  　・･]"
_COUNT = rf"([0-9][0-9,]*){W}*(名|人)(?=[A-Za-z0-9_])"
#: Scores of the lines after a line that is a label or a title alone.
AFTER_LABEL, AFTER_TITLE = (1080, 1040, 1000, 960, 920), (1060, 1020, 980, 940, 900)


def folded(c: Column) -> Column:
    """Full-width ASCII and half-width katakana as their usual forms."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "　" + "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
    usual = "".join(chr(k) for k in range(0x21, 0x7F)) + " " + "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
    return F.translate(c, wide, usual)


def representative(c: Column) -> Column:
    """A name without brackets, a label or post before it, a post after it, or what follows a slash; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(x.trim_all(c), "[（(][^）)]*[）)]", " "), r"[【】\[\]「」『』<>〈〉《》〔〕]", " ")
    t = F.regexp_replace(t, rf"^(?:{REP_EXACT}|役員(?!一覧|紹介)){W}*[:：]?{W}*", "")
    t = F.regexp_replace(t, rf"^(?:{POSTS}){W}*", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"{W}*(?:{POSTS}){W}*$", ""), rf"{W}*[／/].*$", "")
    return x.once(x.trim_all(F.regexp_replace(t, f"{W}+", " ")), lambda name: F.when(name != "", name))


def likely_representative(name: Column) -> Column:
    """Whether a cleaned name may be a person's: one to four words of letters, no company, number, heading or sentence."""

    def test(t: Column) -> Column:
        long = ~t.rlike(_GAP) & (F.char_length(t) > 12) & t.rlike(f"^{_LETTERS}+$")
        sentence = t.rlike(f"^(?:{PARTICLES})|{SENTENCE}") | long | (F.char_length(t) > 24)
        odd = t.isin(*NO_REP) | t.rlike(f"{REP_COMPANY}|[0-9]") | (F.char_length(t) < 2) | sentence
        return ~odd & t.rlike(rf"^{_LETTERS}+(?:{_GAP}+{_LETTERS}+){{0,3}}$")

    return x.once(folded(representative(name)), lambda t: F.coalesce(test(t), F.lit(False)))


def representative_value(raw: Column) -> Column:
    return x.once(representative(raw), lambda name: F.when(likely_representative(name), name))


def staff_value(raw: Column) -> Column:
    return F.when(~x.employee_noise(raw), x.employee_count(raw))


def address_value(raw: Column) -> Column:
    return F.when(raw.rlike(AREA), x.address(raw))


VALUES = {"representative_name": representative_value, "employee_count": staff_value, "address": address_value}


def representative_boost(target: Column) -> Column:
    """What a page's address, title and heading add to the scores of its representatives."""
    parts = ((REP_STRONG_PAGE, 400), (REP_ABOUT_PAGE, 260), (REP_GREETING_PAGE, 240), (REP_WEAK_PAGE, 120))
    return sum((F.when(target.rlike(f"(?i){x.holds(w)}"), n).otherwise(0) for w, n in parts), F.lit(0))


def pick(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none; unlike ``nullif`` this names ``c`` once, however deep it is."""
    return x.once(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", v))


def rule(field: str, raw: Column, score: Column | int, place: Column, first: str | Column | None = None, when: Column | None = None) -> Column:
    """What a rule makes of a row, null if ``raw`` is null or empty; of the finds of a page that share ``first``, the one of the least place counts.

    ``raw`` is read once, and only ``when`` holds, as most rows are no rule's.
    """
    score, first = (c if isinstance(c, Column) else F.lit(c) for c in (score, first))
    made = lambda v: F.struct(F.lit(field).alias("field"), first.cast("string").alias("first"), v.alias("raw"), score.cast("int").alias("score"), place.cast("long").alias("place"))
    found = x.once(raw, lambda v: F.when(v != "", made(v)))
    return found if when is None else F.when(when, found)


def finds(rules: list[Column], seen: Column | None = None) -> Column:
    """Those of a row's rules that find anything; with ``seen``, of rows that hold any of the rules' words, and none of others."""
    found = F.filter(F.array(*rules), lambda r: r["score"].isNotNull())
    return found if seen is None else F.when(seen, found).otherwise(F.array().cast("array<struct<field:string,first:string,raw:string,score:int,place:bigint>>"))


def line_value(line: Column, below: Column, labels: str, hit: str, inline: str | None = None) -> Column:
    """What a line with a label says: the rest of the line, else the line below it; with ``inline`` labels, else what follows one anywhere."""
    lead = rf"^(?:{labels}){W}*[:：]?{W}*"
    rest = x.once(F.regexp_replace(line, lead, ""), lambda r: F.when((r != "") & (r != line), x.trim_all(r)))
    out = [F.when(line.rlike(hit), F.coalesce(rest, F.when(below != "", below))), x.trim_all(pick(line, f"{lead}(.+)$"))]
    if inline:
        out.append(x.once(x.trim_all(pick(line, rf"(?:{inline}){W}*[{x.BARS}]?{W}*(.+)$")), lambda v: F.when(v != line, v)))
    return F.coalesce(*[x.once(v, lambda s: F.when(s != "", s)) for v in out])


def barred_value(line: Column, labels: str) -> Column:
    """The value that a bar, slash or colon parts from a label that begins the line."""
    return x.trim_all(pick(line, rf"^(?:{labels}){W}*[{x.BARS}]{W}*(.+)$"))


def representative_rules(line: Column, after: Column, form: Column, k: Column, boost: Column) -> list[Column]:
    """Rules of a line of the page's lines (form 0), or of its whole text as one line (form 1), which counts less; for lines that hold ``REP_WORDS``."""
    field, less = "representative_name", F.when(form == 1, 60).otherwise(0)
    place = lambda n: (form * 4 + 2) * F.lit(1 << 27) + k * 16 + n
    text = lambda raw, n, score: rule(field, raw, F.lit(score) - less + boost, place(n))
    once = lambda raw, n, score: rule(field, raw, F.lit(score) - F.when(form == 1, 40).otherwise(0) + boost, (form * 2 + n + 1) * F.lit(1 << 20) + k, form * 2 + n)
    alone, title = line.rlike(f"^(?:{REP_EXACT})$"), line.rlike(rf"^(?:{REP_ALONE})(?:{W}+(?:{CRAFTS}))*$")
    at = lambda n: F.get(after, F.lit(n))
    return [
        once(line_value(line, at(0), REP_LABELS, REP_HIT, REP_INLINE), 0, 1230), once(barred_value(line, REP_LABELS), 1, 1220),
        text(pick(line, rf"^(?:{REP_EXACT}){W}*[:：]?{W}*(.+)$"), 0, 1100), *[text(F.when(alone, at(n)), 1 + n, s) for n, s in enumerate(AFTER_LABEL)],
        text(pick(line, rf"^(?:{REP_TITLES}){W}*[:：/／]?{W}*(.+)$"), 6, 980), text(pick(line, rf"^(.+?){W}+(?:{REP_BEHIND})$"), 7, 960),
        *[text(F.when(title, at(n)), 8 + n, s) for n, s in enumerate(AFTER_TITLE)],
    ]


def staff_rules(line: Column, after: Column, form: Column, k: Column, boost: Column) -> list[Column]:
    """Rules of a line of the page's lines (0), its whole text (1), its lines cut before labels (2) or its footer (3); for lines that hold ``STAFF_HIT``."""
    field = "employee_count"
    counted = lambda v: x.once(v, lambda s: F.when(s != "", F.concat(F.lit(f"{x.EMPLOYEE_MAIN} "), s)))
    unit = lambda d, p: x.once(pick(d, p), lambda n: F.when(n.isNotNull(), F.concat(n, pick(d, p, 2))))
    number = lambda c, lead: x.once(x.digits(c), lambda d: unit(d, f"{lead}{_COUNT}"))
    main = number(line, rf"^(?:{STAFF_MAIN}){W}*[{x.BARS}]?{W}*")
    below = F.when(line.rlike(rf"^(?:{STAFF_MAIN}){W}*[{x.BARS}]?{W}*$"), F.coalesce(*[number(F.get(after, F.lit(n)), "^") for n in range(3)]))
    place = lambda n: F.lit(n << 40) + form * F.lit(1 << 36) + k
    at = lambda f, raw, n, score, first: rule(field, counted(raw), (score if isinstance(score, Column) else F.lit(score)) + boost, place(n), first, form.isin(*f))
    barred = barred_value(line, x.EMPLOYEE_LABELS)
    return [
        at((0, 1, 2), F.coalesce(main, below), 1, F.when(form == 0, 1180).when(form == 1, 1160).otherwise(1120), F.concat(F.lit("main "), form.cast("string"))),
        at((0, 1, 2), line_value(line, F.get(after, F.lit(0)), x.EMPLOYEE_LABELS, STAFF_HIT), 5, 320, "labelled"), at((0, 1, 2), barred, 6, 330, "barred"), at((3,), barred, 9, 240, "footer"),
    ]


def staff_section(line: Column, after: Column) -> Column:
    """A labelled line and those after it, up to twelve, but not from the third on beyond a line that begins other matter."""
    ends = F.transform(after, lambda a, n: (n >= 2) & a.rlike(f"(?i){STAFF_ENDS}") & ~a.rlike(STAFF_HIT))
    stop = F.array_position(ends, True)
    return F.concat_ws(" ", line, F.slice(after, 1, F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int")))


def staff_text_rules(kind: Column, line: Column, after: Column, form: Column, k: Column, boost: Column) -> Column:
    """Finds of ``section`` rows (a labelled line of some lines) and of ``joined`` rows (lines as one text, whose first label counts)."""
    field, place = "employee_count", lambda n: F.lit(n << 40) + form * F.lit(1 << 36) + k
    cut = lambda most, ends: x.trim_all(pick(line, rf"(?s)(?=(?:{x.starts(x.EMPLOYEE_LABELS)}))((?:{x.EMPLOYEE_LABELS}){W}*[:：]?{W}*.{{0,{most}}}?)(?=(?i:{x.starts(ends)})|\z)"))
    made = lambda raw, n, score, first=None, when=None: rule(field, raw, F.lit(score) + boost, place(n), first, when)
    late, early = form.isin(2, 3, 4), form.isin(0, 1, 2)
    joined = x.once(cut(80, STAFF_BOUNDS), lambda snippet: finds([made(cut(220, STAFF_ENDS), 10, 360, when=late), made(snippet, 11, 360, when=late), made(snippet, 7, 380, "snippet", early)]))
    return F.when(line.rlike(STAFF_HIT), F.when(kind == "section", finds([made(staff_section(line, after), 8, 360)])).when(kind == "joined", joined))


def staff_blocks(line: Column, after: Column, k: Column) -> list[Column]:
    """Every reading of a line and up to five after it as a head count, best first: after a label, and blocks of one to five lines that speak of employees."""
    field, at = "employee_count", lambda n: F.coalesce(F.get(after, F.lit(n)), F.lit(""))
    alone = line.rlike(f"^(?:{x.EMPLOYEE_LABELS})$")
    lead = rf"^(?:{x.EMPLOYEE_LABELS}){W}*"
    read = [
        (1200, F.when(line.rlike(f"{lead}[:：]?{W}*.+$"), F.concat_ws(" ", line, pick(line, f"{lead}[:：]?{W}*(.+)$")))),
        (1190, F.when(line.rlike(f"{lead}[{x.BARS}]{W}*.+$"), F.concat_ws(" ", line, pick(line, f"{lead}[{x.BARS}]{W}*(.+)$")))),
        *[(s, F.when(alone, F.concat_ws(" ", line, *map(at, n)))) for s, n in ((1180, (0,)), (1140, (0, 1)), (1100, (0, 1, 2)), (1060, (1,)), (1020, (2,)), (980, (3,)), (940, (4,)))],
    ]
    for n, s in enumerate((1040, 1020, 1000, 980, 960)):
        block = F.concat_ws(" ", line, F.slice(after, 1, n))
        read.append((s, x.once(block, lambda b: F.when(b.rlike("[0-9０-９]") & x.employee_context(b), b))))
    return [rule(field, raw, s, k * 16 + n) for n, (s, raw) in enumerate(read)]


def address_rules(line: Column, after: Column, form: Column, k: Column, boost: Column) -> list[Column]:
    """A line, and after a label also the line with one, two and three more; pages' lines, whole text and footer in this order."""
    place = lambda n: F.lit(1 << 22) + F.when(form == 3, 2).otherwise(form) * F.lit(1 << 40) + k * 4 + n
    labelled = line.rlike(ADDRESS_HIT)
    placed = lambda raw: x.once(raw, lambda v: F.when(v.rlike(AREA), v))
    joined = [F.when((F.size(after) >= n) & labelled, F.concat_ws(" ", line, F.slice(after, 1, n))) for n in (1, 2, 3)]
    return [rule("address", placed(raw), F.lit(320) + boost, place(n)) for n, raw in enumerate((line, *joined))]


def phone_line(line: Column, after: Column, labels: str) -> Column:
    """The representative number that stands after a label in its line, or in the three lines after a line of a label alone; none after a fax label."""
    mark = r"\s*[|｜¦┃‖／/：:.]?\s*"
    same, alone, number = rf"(?i)(?:{labels}){mark}0[\d\s-]{{8,13}}\d", rf"(?i)^(?:{labels}){mark}$", r"0[\d\s()（）-]{8}"
    usable = lambda p: F.when(p.rlike(f"(?i){labels}|{number}"), ~x.fax_only(p) & ~x.weak_phone_context(p)).otherwise(False)
    read = lambda p, ok: F.struct(
        (ok & p.rlike(same)).alias("same"), (ok & p.rlike(alone)).alias("alone"),
        (p.rlike(f"(?i){x.FAX_LABELS}") & x.fax_only(p)).alias("fax"), F.when(ok & p.rlike(number), x.representative_phone(p)).alias("number"),
    )
    each = F.transform(F.array(line, *[F.get(after, F.lit(n)) for n in range(3)]), lambda c: x.once(x.digits(c), lambda p: x.once(usable(p), lambda ok: read(p, ok))))

    def number_of(rows: Column) -> Column:
        own, a, b, c = (F.get(rows, F.lit(n)) for n in range(4))
        below = F.coalesce(a["number"], F.when(~a["fax"], F.coalesce(b["number"], F.when(~b["fax"], c["number"]))))
        return F.coalesce(F.when(own["same"], own["number"]), F.when(own["alone"], below))

    return F.when(line.rlike(f"(?i){labels}"), x.once(each, number_of))
