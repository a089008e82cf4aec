"""Golden rows of the normal forms, and properties of the list's operators."""

import pytest
from pyspark.sql import functions as F

from meibo.functions import derive, text
from meibo.operators import dedupe, filters, merge, pages
from meibo.operators.filters import AdvancedFilter, FieldFilter, Range, Request
from meibo.schema import COMPANIES, CSV_HEADERS, NAMES
from meibo.sources import files
from meibo.streaming import ingest


def one(spark, make, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["o"] for r in df.select("k", make("v").alias("o")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (text.format_phone, {"0312345678": "03-1234-5678", "0661234567": "06-6123-4567", "09012345678": "090-1234-5678", "0120123456": "0120-123-456", "0570123456": "0570-12-3456", "0451234567": "0451-23-4567", "123456789012": None, "1312345678": None, None: None, "": None}),
        (text.zipcode, {"〒123-4567": "123-4567", "１２３４５６７": "123-4567", "12-345": None, None: None}),
        (text.phone, {"TEL：03-1234-5678": "03-1234-5678", "電話 0451234567 FAX 0451234568": "0451-23-4567", "なし": None}),
        (text.representative_phone, {"FAX 03-1234-5678": None, "090-1234-5678": None, "電話 03-1234-5678": "03-1234-5678"}),
        (text.fax, {"FAX: 03-1111-2222": "03-1111-2222", "電話兼用": None}),
        (text.email, {"連絡 info@example.co.jp まで": "info@example.co.jp", "no": None}),
        (text.established, {"1990年4月1日": "1990年4月", "1990": "1990年", "昭和50年": None}),
        (derive.established_ym, {"1990年4月1日": "199041", "1990年4月": "199004", "199004": "199004", "": None, "昭和50年": None, None: None}),
        (lambda c: derive.capital_numeric(c).cast("double"), {"1,000万円": 1000.0, "1e6": 1e6, ".5": 0.5, "-": None, "": None, None: None}),
        (lambda c: derive.employee_numeric(c).cast("int"), {"連結 120名": 120, "単体30人（連結 90人）": 90, "正社員10名 パート5名": 15, "250": 250, "1,234名": 1234, "約50人": 50, "契約社員 5名": 5, "": None}),
        (derive.prefecture, {"東京都港区1": "東京都", "港区1": None, None: None}),
        (derive.city, {"三重県四日市市1": "四日市", "東京都府中市栄町": "府中市", "大阪府大阪市北区": "大阪市", "東京都1町": None}),
        (text.permit_category, {"派13-123456": "労働者派遣", "派１３－１２３４５６ 13-ユ-654321": "労働者派遣・有料職業紹介", "x": None}),
        (text.company_name, {"ホーム | 株式会社青空": "株式会社青空", "Top": None}),
        (text.compare_key, {"Ａ b　Ｃ": "abc"}),
    ],
)
def test_golden(spark, make, cases):
    assert one(spark, make, list(cases)) == list(cases.values())


def table(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in ("id", *NAMES)) for r in rows], COMPANIES)


def test_filters_and_delete_split_the_table(spark):
    c = table(spark, [{"id": 1, "company": "株式会社A", "capital": "1,000"}, {"id": 2, "company": None}, {"id": 3, "company": "　", "capital": "5"}])
    request = Request({"company": FieldFilter("contains", "株式")}, AdvancedFilter(capital=Range(10)))
    hit = [r["id"] for r in filters.filter_companies(c, request).collect()]
    rest = sorted(r["id"] for r in dedupe.delete_rows(c, request).collect())
    assert hit == [1] and rest == [2, 3]
    assert [r["id"] for r in c.where(filters.blank("company")).orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in c.where(filters.blank("company", strict_space=True)).collect()] == [2]


def test_keep_first_keeps_blanks_and_is_idempotent(spark):
    c = table(spark, [{"id": k, "company": n} for k, n in enumerate(["a", " a ", None, "", "b", "a"])])
    kept = dedupe.keep_first(c, "company", ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert dedupe.keep_first(kept, "company", ["id"]).count() == 4


def test_numbers_are_consecutive_in_order(spark):
    c = table(spark, [{"id": k, "company": f"c{k % 7}"} for k in range(50)]).repartition(5)
    rows = dedupe.number_rows(c, [F.col("company"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(50))
    assert [(r["company"], r["id"]) for r in rows] == sorted((r["company"], r["id"]) for r in rows)


def test_csv_round_trip_and_bad_header(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    head = ",".join(CSV_HEADERS)
    cells = ['" 株式会社A "', '"a ""b"", c\nd"'] + [""] * (len(CSV_HEADERS) - 2)
    good.write_bytes(("﻿" + head + "\r\n" + ",".join(cells) + "\r\n" + "," * 27 + "\r\n短い\r\n").encode())
    out, counts = files.import_companies(spark, str(good))
    rows = out.orderBy("id").collect()
    assert [r["company"] for r in rows] == ["株式会社A", "短い"] and rows[0]["zipcode"] == 'a "b", c\nd' and [r["id"] for r in rows] == [1, 2]
    assert counts.first().asDict() == {"inserted": 2, "skipped": 0}
    bad.write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.import_companies(spark, [str(good), str(bad)])


def test_diff_after_merge_is_empty_but_for_the_shown_equal(spark):
    c = table(spark, [{"id": 1, "company": "A", "phone": "1"}, {"id": 2}])
    x = spark.createDataFrame(
        [("p1", 1, 0, ["03-1111-2222"], "B", "山田"), ("p2", 2, 0, ["03-3333-4444"], "C", None)],
        "preview_row_id string, row_id long, office_index int, phone array<string>, company string, representative_name string",
    )
    changes = merge.diff(merge.bundle(x), c)
    none = spark.createDataFrame([], "preview_row_id string, field string, value string")
    merged = merge.merge_candidates(c, merge.selected_values(changes, none))
    got = {r["id"]: (r["company"], r["phone"], r["representative_name"]) for r in merged.collect()}
    assert got == {1: ("A", "03-1111-2222", "山田"), 2: ("C", "03-3333-4444", None)}
    again = {(r["row_id"], r["field"]) for r in merge.diff(merge.bundle(x), merged).collect()}
    assert again == {(1, "company"), (1, "representative_name")}


def test_late_and_missing_results(spark):
    rows = [("j", 0, "done", "r", 0), ("j", 3, "done", "r", 0), ("j", 1, "done", "late", 1), ("j", 3, "failed", "twice", 1), ("j", 4, "skipped", "r", 1)]
    df = spark.createDataFrame(rows, "job_id string, target_index long, status string, reason string, batch int")
    got = sorted((r["target_index"], r["status"]) for r in ingest.ingest_results(df).collect())
    assert got == [(0, "done"), (1, "failed"), (2, "failed"), (3, "done"), (4, "skipped")]


def test_bodies_in_japanese_charsets(spark):
    s = "<p>会社の電話と住所</p>"
    rows = [(k, s.encode(k), "text/html") for k in ("utf-8", "shift_jis", "euc_jp", "iso2022_jp")] + [("none", None, None)]
    df = spark.createDataFrame(rows, "name string, body binary, content_type string")
    got = {r["name"]: r["html"] for r in pages.decode_body(df).collect()}
    assert got == {"utf-8": s, "shift_jis": s, "euc_jp": s, "iso2022_jp": s, "none": ""}


def test_entry_and_queries_have_equal_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_names():
    from meibo.functions.names import inspect_name

    cases = {
        "": "none", "　": "none", None: "none", "ご挨拶": "delete", "氏名 山田 太郎": "update", "山田 太郎 様": "update", "代表取締役 山田太郎": "none",
        "ジョン・スミス": "none", "山田 太郎・鈴木 一郎": "none", "名古屋市": "none", "株式会社山田": "delete", "山田　太郎": "update", "代表取締役": "delete",
    }
    assert {v: inspect_name(v)[0] for v in cases} == cases
    assert inspect_name("山田 太郎 様")[1] == "山田 太郎"


MARKUPS = {
    "table": "<table><tr><th>{}</th><td>{}</td></tr></table>", "list": "<dl><dt>{}</dt><dd>{}</dd></dl>", "colon": "<p>{}：{}</p>",
    "spans": "<li><span>{}</span> <em><a href='#'>{}</a></em></li>", "mixed": "<div><dt>{}</dt><dd>{}<br></dd></div>",
    "classes": '<h5><span class="item-label">{}</span><span class="item-value">{}</span></h5>',
    "divs": "<article><p>{}</p><p>{}</p></article>", "heading": "<section><h3>{}</h3><a href='#'>{}</a></section>",
}


def test_pairs_of_each_markup(spark):
    rows = [(k, f"<html><body>{markup.format('資本金', f'{n + 1}00万円')}</body></html>") for n, (k, markup) in enumerate(MARKUPS.items())]
    got = pages.extract_pairs(spark.createDataFrame(rows, "kind string, html string"), ["kind"]).collect()
    assert {(r["kind"], r["label"], r["value"]) for r in got} == {(k, "資本金", f"{n + 1}00万円") for n, k in enumerate(MARKUPS)}


def test_candidates_of_each_source(spark):
    url = "https://a.jp/"
    made = {
        "tel": '<a href="tel:03-1234-5678">call</a>', "line": "<p>TEL 03-1234-5679</p>", "below": "<h4>電話番号</h4><h4>本店</h4><h4>03-1234-5670</h4>",
        "contact": "<dl><dt>連絡先</dt><dd>TEL 03-1234-5671 FAX 03-1234-5672</dd></dl>", "weak": "<dl><dt>採用TEL</dt><dd>03-1234-5673</dd></dl>",
        "form": '<a href="/x.docx">お問い合わせ</a><a href="/ask">お問い合わせ</a><a href="/contact">c</a>', "text": "<h4>設立 1990年4月</h4><h4>資本金</h4><h4>500万円</h4>",
        "business": "<h4>事業内容</h4><h4>広告の企画と販売</h4><h4>営業時間 9時</h4>", "zip": "<dl><dt>住所</dt><dd>〒100-0001 東京都千代田区1-2</dd></dl>",
    }
    rows = [(k, 0, None, url, f"<body>{h}</body>") for k, h in made.items()] + [("job", 0, None, url + "recruit", made["tel"])]
    got = pages.candidates(spark.createDataFrame(rows, "company_id string, page_seq int, focus string, final_url string, html string")).collect()
    values = {(r["company_id"], r["field"], r["value"], r["score"]) for r in got}
    assert values >= {
        ("tel", "phone", "03-1234-5678", 260), ("line", "phone", "03-1234-5679", 340), ("below", "phone", "03-1234-5670", 340),
        ("contact", "phone", "03-1234-5671", 360), ("contact", "fax", "03-1234-5672", 210), ("form", "form_url", "https://a.jp/ask", 120),
        ("text", "established_date", "1990年4月", 165), ("text", "capital", "500万円", 195), ("business", "business_content", "広告の企画と販売", 210),
        ("zip", "zipcode", "100-0001", 230), ("zip", "address", "東京都千代田区1-2", 320 + 220 + 180 + 160),
    }
    assert not {v for v in values if v[0] in ("weak", "job") and v[1] == "phone"}
    assert [v for v in values if v[:2] == ("form", "form_url")] == [("form", "form_url", "https://a.jp/ask", 120)]


def test_addresses(spark):
    from meibo.functions import text as x

    cases = {
        "本社所在地：〒123-4567 東京都港区芝公園1-2-3 TEL 03-1234-5678": "東京都港区芝公園1-2-3",
        "住所　四日市市中町１２番地 営業部": "四日市市中町12番地",
        "大阪府大阪市北区梅田2丁目 アクセス方法 駅から5分": "大阪府大阪市北区梅田2丁目",
        "東京都港区の採用サービス1": None, "東京都港区ああああ": None, "東京都港区1-2-3@x": None, "港区1": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, t string")
    got = {r["k"]: r["v"] for r in df.select("k", x.address("t").alias("v")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_lines_about_heads_and_phones(spark):
    from meibo.functions import text as x

    lines = ["従業員数 20名", "募集人数 3名", "売上高 3億円", "", None, "代表電話", "電話 採用担当", "FAX", "ほか"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, t string")
    out = df.orderBy("k").select(x.employee_context("t"), x.employee_noise("t"), x.phone_label_context("t")).collect()
    assert [tuple(r) for r in out] == [
        (True, False, False), (False, True, False), (False, True, False), (False, True, False), (False, True, False),
        (False, False, True), (False, False, False), (False, False, False), (False, False, False),
    ]


def test_iso_datetimes(spark):
    from meibo.functions import text as x

    cases = {"2024/03/05": "2024-03-05T00:00:00.000Z", " 2023-12-31 23:59:01 ": "2023-12-31T23:59:01.000Z", "2024-01-01T09:00:00+09:00": "2024-01-01T00:00:00.000Z", "まだ": None, " ": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, t string")
    assert {r["k"]: r["v"] for r in df.select("k", x.iso_datetime("t").alias("v")).collect()} == dict(enumerate(cases.values()))


def test_long_runs_of_letters_are_read_by_their_ends():
    from meibo.functions.names import inspect_name

    assert inspect_name("株式会社山田")[0] == inspect_name("名古屋")[0] == inspect_name("ご挨拶")[0] == "delete"
    assert inspect_name("あいうえおかきくけこさしすせそたちつてと")[:2] == ("update", "すせそたちつてと")
    assert inspect_name("ABCDEFGHIJKLMNOPQRSTUVWXYZ")[:2] == ("update", "ABCDEFGHIJKLMNOPQRST")


def test_csv_for_the_job_board_is_read_back(spark, tmp_path):
    import csv
    import io

    from meibo.sources import files

    first, second = files.COLUMNS[:2]
    df = spark.createDataFrame([('b, "c"', None), ("改行\nあり", "x")], f"`{first}` string, `{second}` string, other string".replace(", other string", ""))
    files.write_jobboard_csv(df, str(tmp_path / "board"))
    data = b"".join(p.read_bytes() for k in (0, 1) for p in sorted((tmp_path / "board" / f"part={k}").glob("part-*")))
    assert data.startswith(b"\xef\xbb\xbf")
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert rows[0] == list(files.COLUMNS)
    assert sorted((r[0], r[1]) for r in rows[1:]) == [('b, "c"', ""), ("改行\nあり", "x")]


def test_export_of_job_rows(spark):
    from meibo.schema import NAMES
    from meibo.sources import files

    targets = spark.createDataFrame([(0, 10, "done"), (1, 11, "pending")], "target_index int, row_id long, status string")
    changes = spark.createDataFrame([(10, "phone", "old", ["a", "b"])], "row_id long, field string, before string, candidates array<string>")
    names = ", ".join(f"{n} string" for n in NAMES)
    stored = spark.createDataFrame([(10, *["v"] * len(NAMES)), (11, *["w"] * len(NAMES))], f"id long, {names}")
    every = {r["row_id"]: r for r in files.export_job_rows(targets, changes, stored).collect()}
    assert every[10]["phone_before"] == "old" and every[10]["phone_candidates"] == "a\nb" and every[11]["phone_before"] is None and every[11]["company"] == "w"
    assert [r["row_id"] for r in files.export_job_rows(targets, changes, stored, "done").collect()] == [10]
    assert "company" not in files.export_job_rows(targets, changes, stored, "candidates_only").columns


def test_elements_of_a_page():
    from meibo.operators import markup

    assert markup.pairs(None) == markup.pairs("") == [] and markup.footer(None) == ""
    # open cells and items end with the next; repeated pairs come once; scripts and comments hold none
    assert markup.pairs("<table><tr><th>A<td>1<tr><th>B<td>2 &amp; 3</table><!-- <p>C: 4</p> --><script>'<p>D: 5</p>'</script>") == [("A", "1"), ("B", "2 & 3")]
    assert markup.pairs("<p>A: 1<p>A: 1<p>: 2<p>" + "x" * 61 + ": 3") == [("A", "1")]
    assert markup.pairs("<dl><dt>A</dt><dd></dd><dt>B</dt><dd>a<br>b</dd></dl></div></p>") == [("B", "a b")]
    assert markup.pairs("<div>" * 5000 + "A: 1")[:1] == [("A", "1")]
    page = '<div class="site-info"><div id="contact">a</div>b</div><footer>c</footer><p>d</p><section id=x>e</section>'
    assert markup.footer(page) == "a b c"


def test_meta_of_a_page(spark):
    from meibo.operators import pages

    ld = '{"@context":"x","@graph":[{"@type":"WebSite","name":"no"},{"@type":["Organization"],"name":" 株式会社A ","address":{"@type":"PostalAddress"}}]}'
    rows = [
        ("order", '<meta content="a > b" name="Description"><META property=\'og:site_name\' content=\'c\'>'),
        ("blank", '<meta name="description" content=""><meta name="description" content="second">'),
        ("graph", f'<script type="application/ld+json">{{"broken</script><script type="application/ld+json">{ld}</script>'),
        ("owner", '<script type="application/ld+json">{"@type":"WebPage","name":"no","publisher":{"@type":"Organization","name":"B"}}</script>'),
        ("null", None),
    ]
    df = spark.createDataFrame(rows, "k string, html string")
    got = {r["k"]: tuple(r)[1:] for r in df.select("k", pages.meta_description("html"), pages.og_site_name("html"), pages.jsonld_name("html")).collect()}
    assert got == {
        "order": ("a > b", "c", None), "blank": ("second", None, None), "graph": (None, None, "株式会社A"), "owner": (None, None, "B"), "null": (None, None, None),
    }


def test_contact_numbers_in_order(spark):
    from meibo.operators import pages

    rows = [
        ("a", 1, "<p>TEL 03-1111-2222</p>"), ("a", 0, "<p>電話 03-3333-4444 / ０３ー１１１１ー２２２２</p><p>TEL/FAX 03-5555-6666</p><p>03-7777-8888</p>"),
        ("b", 0, None), ("c", 0, "<p>電話</p>"),
    ]
    df = spark.createDataFrame(rows, "company_id string, page_seq int, html string")
    assert sorted(map(tuple, pages.contact_numbers(df, "phone").collect())) == [("a", "03-1111-2222", 2), ("a", "03-3333-4444", 1)]
    assert [tuple(r) for r in pages.contact_numbers(df, "fax").collect()] == [("a", "03-5555-6666", 1)]
