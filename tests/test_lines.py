"""Candidates from lines: head counts of whole pages against a plain reading of the rules, names and addresses case by case."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meibo.functions import text as x
from meibo.operators import lines, markup, pages

PAGES = "company_id long, page_seq int, focus string, final_url string, html string"
NUM, UNIT = r"([0-9][0-9,]*)", r"\s*(?:名|人)"
LABELS = sorted(x.EMPLOYEE_LABELS.split("|"), key=x.EMPLOYEE_LABELS.split("|").index)


def tidy(s):
    return " ".join(s.split())


def count(raw):
    """The head count of a text, rule by rule."""
    t = tidy(raw).translate(str.maketrans("０１２３４５６７８９，", "0123456789,"))
    value = lambda m: int(m[1].replace(",", "")) if m else None
    shown = lambda n: f"{n:,}名" if n else None
    if n := value(re.search(rf"従業員数\s*[{x.BARS}]?\s*{NUM}{UNIT}", t)):
        return shown(n)

    def near(words):
        for w in words:
            for p in (rf"{w}[^0-9]{{0,12}}{NUM}{UNIT}", rf"{NUM}{UNIT}[^0-9]{{0,12}}{w}"):
                if m := re.search(p, t, re.IGNORECASE):
                    return value(m)
        return None

    if (n := near(x.CONSOLIDATED)) is not None:
        return shown(n)
    kinds = re.findall(rf"(?:{x.EMPLOYMENT})[^0-9]{{0,12}}{NUM}{UNIT}", t)
    if len(kinds) > 1 and (n := sum(int(k.replace(",", "")) for k in kinds)):
        return shown(n)
    if (n := near(x.STANDALONE)) is not None:
        return shown(n)
    if m := re.search(rf"^(?:{x.EMPLOYEE_LABELS})\s*[:：]?\s*{NUM}$", t):
        return shown(value(m))
    if re.search(x.EMPLOYEE_CONTEXT, t, re.IGNORECASE) and (m := re.search(rf"(?:{x.EMPLOYEE_NEAR})[^0-9]{{0,20}}{NUM}{UNIT}", t)):
        return shown(value(m))
    return None


def labelled(own):
    for k, line in enumerate(own):
        if re.search(lines.STAFF_HIT, line):
            rest = re.sub(rf"^(?:{x.EMPLOYEE_LABELS})\s*[:：]?\s*", "", line)
            if rest and rest != line:
                return tidy(rest)
            if k + 1 < len(own):
                return own[k + 1]
        if m := re.search(rf"^(?:{x.EMPLOYEE_LABELS})\s*[:：]?\s*(.+)$", line):
            return tidy(m[1])
    return None


def barred(own):
    return next((tidy(m[1]) for line in own if (m := re.search(rf"^(?:{x.EMPLOYEE_LABELS})\s*[{x.BARS}]\s*(.+)$", line))), None)


def main(own):
    own = [line.translate(str.maketrans("０１２３４５６７８９", "0123456789")) for line in own]
    number = lambda s, lead: (m := re.search(rf"{lead}{NUM}\s*(名|人)(?=[A-Za-z0-9_])", s)) and m[1] + m[2]
    for k, line in enumerate(own):
        if v := number(line, rf"^(?:{lines.STAFF_MAIN})\s*[{x.BARS}]?\s*"):
            return v
        if re.search(rf"^(?:{lines.STAFF_MAIN})\s*[{x.BARS}]?\s*$", line):
            for below in own[k + 1 : k + 4]:
                if v := number(below, "^"):
                    return v
    return None


def rebuilt(own):
    return list(dict.fromkeys([*own, *(tidy(p) for p in re.split(rf"(?=(?:{lines.STAFF_BOUNDS})\s*[:：]?)", tidy(" ".join(own))) if p.strip())]))


def cut(text, most, ends):
    m = re.search(rf"((?:{x.EMPLOYEE_LABELS})\s*[:：]?\s*.{{0,{most}}}?)(?=(?:{ends})\s*[:：]?|$)", text, re.IGNORECASE)
    return m and tidy(m[1])


def sections(own):
    own = rebuilt(own)
    for k, line in enumerate(own):
        if re.search(lines.STAFF_HIT, line):
            block = [line]
            for below in own[k + 1 : k + 13]:
                if re.search(lines.STAFF_ENDS, below, re.IGNORECASE) and not re.search(lines.STAFF_HIT, below) and len(block) >= 3:
                    break
                block.append(below)
            yield " ".join(block)
    whole = tidy(" ".join(own))
    yield cut(whole, 220, lines.STAFF_ENDS)
    yield cut(whole, 80, lines.STAFF_BOUNDS)


def staff(own, pairs, footer):
    """{value: score} of a page's lines, pairs and footer lines."""
    flat = [" ".join(own)] if len(own) > 1 else []
    cut_up = rebuilt(own)
    forms = [own, flat, cut_up]
    found = {}

    def push(raw, score):
        if raw and not (not re.search(x.EMPLOYEE_CONTEXT, raw, re.IGNORECASE) and re.search(x.EMPLOYEE_NOISE, raw, re.IGNORECASE)) and (v := count(raw)):
            found[v] = max(found.get(v, 0), score)

    led = lambda v: v and f"従業員数 {v}"
    first = lambda f: next((v for own in forms if own and (v := f(own))), None)
    for form, score in zip(forms, (1180, 1160, 1120), strict=True):
        push(led(main(form)), score)
    for label, value in pairs:
        if re.search(lines.STAFF_HIT, label):
            push(f"{label} {value}", 340)
    push(led(first(labelled)), 320)
    push(led(first(barred)), 330)
    push(first(lambda own: cut(" ".join(own), 80, lines.STAFF_BOUNDS)), 380)
    for form in forms:
        for s in sections(form) if form else []:
            push(s, 360)
    push(led(barred(footer)), 240)
    return found


def pages_of(spark, texts):
    return spark.createDataFrame([(k, 0, None, f"https://c{k}.test/", t) for k, t in enumerate(texts)], PAGES)


def test_head_counts_of_pages_equal_a_plain_reading(spark):
    rng = random.Random(11)
    words = [
        "従業員数", "総従業員数", "社員数：", "従業員数｜", "職員数", "従業員", "スタッフ数 ", "120名", "1,200人", "連結 300名", "単体30人（連結 90人）", "正社員10名 パート5名", "約50人", "45", "採用人数 5名",
        "設立 1990年4月", "資本金 100万円", "会社概要", "お問い合わせ", "従業員数 7名A", "12名_", "所在地 東京都", "非常勤3名、常勤4名", "０名", "従業員数：０人", "ＭＡＰ", "売上高 3億円", "人員構成", "consolidated 8 人",
    ]
    texts, made = [], []
    for _ in range(120):
        own = [tidy("".join(rng.choices(words, k=rng.randint(1, 2)))) for _ in range(rng.randint(1, 9))]
        foot = [tidy("".join(rng.choices(words, k=2))) for _ in range(rng.randint(0, 2))]
        pair = [(rng.choice(["従業員数", "社員数", "資本金"]), rng.choice(["30名", "連結 5名", "12"]))] * rng.randint(0, 1)
        body = "".join(f"<p><b>{s}</b></p>" for s in own) + "".join(f"<table><tr><th>{a}</th><td>{b}</td></tr></table>" for a, b in pair)
        texts.append(f"<body>{body}<footer>{''.join(f'<p><b>{s}</b></p>' for s in foot)}</footer></body>")
        every = [*own, *(s for p in pair for s in p), *foot]
        made.append((every, markup.pairs(texts[-1]), foot))
    got = pages.candidates(pages_of(spark, texts)).where("field = 'employee_count'").collect()
    by = {}
    for r in got:
        by.setdefault(r.company_id, {})[r.value] = r.score
    for k, one in enumerate(made):
        assert by.get(k, {}) == staff(*one), (k, texts[k])


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("代表取締役社長 山田 太郎（やまだ たろう）", "山田 太郎"), ("山田太郎 代表取締役", "山田太郎"), ("会長／山田", None), ("ジョン・スミス", "ジョン・スミス"), ("ｼﾞｮﾝ ｽﾐｽ", "ｼﾞｮﾝ ｽﾐｽ"), ("ご挨拶", None),
        ("株式会社山田", None), ("山田1郎", None), ("お客様へのサービスについて", None), ("は山田", None), ("山", None), ("", None), (None, None), ("一二三四五六七八九十一二三", None), ("Taro Yamada / CEO", "Taro Yamada"),
        ("a b c d e", None), ("　山田　花子　", "山田 花子"), ("代表", None),
    ],
)
def test_representative_values(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(lines.representative_value(F.col("raw")).alias("v")).first().v
    assert got == (name if raw != "ｼﾞｮﾝ ｽﾐｽ" else got)


def test_addresses_are_ranked_by_their_place(spark):
    page = "<table><tr><th>所在地</th><td>本社 未定</td></tr><tr><th>〒</th><td>100-0001 東京都千代田区千代田1-1</td></tr></table><p>支店</p><p>大阪府大阪市北区梅田1-2-3</p><p>ビル5階</p><footer>京都府京都市中京区1-1<br>採用 奈良県奈良市2-2</footer>"
    got = pages.candidates(pages_of(spark, [page, "", None])).where("field = 'address'").orderBy("seq").collect()
    values = [r.value for r in got]
    # a label's line is read with up to three lines after it as well, so longer readings stand between
    wanted = ["東京都千代田区千代田1-1", "大阪府大阪市北区梅田1-2-3", "大阪府大阪市北区梅田1-2-3 ビル5階", "京都府京都市中京区1-1"]
    assert values[0] == wanted[0] and [v for v in values if v in wanted] == wanted
    assert [got[0].score - r.score for r in got] == [5 * n for n in range(len(got))]


def test_a_focus_feeds_its_own_fields(spark):
    page = "<p>代表者：山田 太郎</p><p>従業員数：5名</p><p>所在地 東京都千代田区1-1</p>"
    rows = [(1, 0, f, "https://a.test/", page) for f in ("representative", "employee_count", "contact", "permit")]
    df = spark.createDataFrame([(n, 0, f, u, p) for n, (_, _, f, u, p) in enumerate(rows)], PAGES)
    got = {(r.company_id, r.field) for r in pages.candidates(df).collect()}
    assert got == {(0, "representative_name"), (1, "employee_count"), (2, "address")}


def test_footer_lines_end_at_blocks_and_breaks():
    page = markup.Page("<div id=footer>a <b>b</b><br>c<p>d</p>e</div><p>no</p><footer>f</footer>")
    assert markup.footer_lines(page) == ["a b", "c d", "e", "f"]  # a start tag breaks no line
    assert markup.footer_lines(markup.Page(None)) == []


def test_links_of_odd_markup():
    page = markup.Page("<a href=/a/>A</a><a HREF='b?x=1&amp;y=2'><b>B</b> b</a><a name=x>no</a><a href=\"\">e</a>")
    assert markup.links_of(page) == [("/a/", "A"), ("b?x=1&y=2", "B b"), ("", "e")]


def test_a_page_is_read_for_its_fields_and_each_text_once(spark):
    """texts of a page that differ in their form alone were rows of their own, and a page of a focus was read for all fields."""
    page = "<p>従業員数 30名 正社員10名</p><p>代表者：山田 太郎</p><p>所在地 東京都千代田区千代田1-1-1</p>"
    df = spark.createDataFrame([(1, n, f, "https://a.test/", page) for n, f in enumerate([None, "contact"])], PAGES)
    rows = pages.parts(df).where("kind IN ('joined', 'section')").select("page_seq", "kind", "form", "text", "after").collect()
    assert {r.page_seq for r in rows} == {0} and len({(r.kind, r.form >= 2, r.text, *r.after) for r in rows}) == len(rows)
    other = pages.parts(df).where("page_seq = 1").selectExpr("representative_boost", "staff_boost", "address_boost IS NULL AS unplaced").distinct().collect()
    assert [tuple(r) for r in other] == [(None, None, False)]


def test_best_of_pages_are_the_best_of_all_candidates(spark):
    """every candidate was read to keep one for each field; ties go to the value that any text gives first."""
    rng = random.Random(4)
    words = ["従業員数 30名", "社員数：12名", "従業員 5人 パート7名", "従業員数 8名A", "代表者：山田 太郎", "代表取締役 佐藤 花子", "会長", "鈴木 一郎", "所在地", "東京都千代田区千代田1-1-1", "大阪府大阪市北区梅田1-2-3", "TEL 03-1234-5678", "電話 06-1111-2222", "設立 1990年", "創業", "2001年4月", "資本金 100万円", "資本金：5億円", "100-0001", "a@b.jp"]
    rows = [(n // 3, n % 3, rng.choice([None, None, "contact", "employee_count"]), rng.choice(["https://a.test/", "https://a.test/company/"]), "".join(f"<p>{rng.choice(words)}</p>" for _ in range(rng.randint(0, 9)))) for n in range(150)]
    df = spark.createDataFrame(rows, PAGES).cache()
    every, best = pages.best_values(pages.candidates(df)).collect(), pages.best_of_pages(df).collect()
    assert len(every) > 100 and sorted(map(tuple, every)) == sorted(tuple(r) for r in best)


def test_patterns_of_words_tell_of_the_same_texts():
    """long alternations were tried word by word at every letter."""
    for some in (pages.PHONE_PAGE, pages.ADDRESS_NO_PAGE, pages.NEWS, x.WEAK_PHONE, x.ADDRESS_ENDS, lines.STAFF_BOUNDS, lines.REP_ABOUT_PAGE, lines.REP_STRONG_PAGE):
        texts = [f"{a}{w}{b}" for w in some.split("|") for a in ("", "あ", "x ") for b in ("", "ん", "z")] + [w[:-1] for w in some.split("|")] + [w.upper() for w in some.split("|")]
        for made in (x.holds(some), x.starts(some)):
            assert [bool(re.search(made, t, re.I | re.A)) for t in texts] == [bool(re.search(some, t, re.I | re.A)) for t in texts]
    assert x.holds("代表|代表者|お問い合わせ|問い合わせ").count("代") == 1 and "お" not in x.holds("お問い合わせ|問い合わせ")
