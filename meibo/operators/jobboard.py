"""Records of a job board's stored pages: outline tables, contact tables and result counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions import text as x
from meibo.functions.derive import text
from meibo.operators.pages import strip_html, strip_html_lines

# Columns of a record, the labels that feed them, labels of a site and of an e-mail address, and domains of no company.
COLUMNS = (
    "会社名", "本社郵便番号", "本社所在地", "本社電話番号", "URL", "E-MAIL", "設立", "資本金", "従業員", "売上高", "代表者", "業種", "採用実績（学校）", "採用実績（人数）",
    "問合せ先", "交通機関", "元URL",
)
LABELS = {
    "本社郵便番号": ("本社郵便番号", "郵便番号"), "本社所在地": ("本社所在地", "所在地"), "本社電話番号": ("本社電話番号", "電話番号", "代表電話番号"),
    "設立": ("設立", "創業"), "資本金": ("資本金",), "従業員": ("従業員", "社員数"), "売上高": ("売上高", "年商"), "代表者": ("代表者", "代表取締役", "社長"),
}
SITE = ("URL", "ホームページ", "企業ホームページ", "会社ホームページ", "HP", "企業サイト", "コーポレートサイト")
MAIL = ("E-MAIL", "メールアドレス", "MAIL", "Mail", "Email", "EMAIL")
CONTACT = ("問合せ先", "交通機関", *MAIL)
NOT_COMPANY = ("job.mynavi.jp", "maps.google.", "goo.gl", "instagram.com", "x.com", "twitter.com", "youtube.com", "youtu.be", "facebook.com", "line.me")


def clean_text(c: str | Column) -> Column:
    """A text of the job board: no-break spaces as spaces, no carriage returns, runs of blanks one, at most one empty line, ends trimmed; null is empty."""
    t = F.regexp_replace(F.translate(text(c), "\u00a0\r", " "), r"[ \t]+", " ")
    return x.trim_all(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def without_controls(c: str | Column) -> Column:
    """A text without control characters but for tabs and line ends, as spreadsheets take it."""
    return F.regexp_replace(text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def plain_label(c: str | Column) -> Column:
    """A label without any white space; unlike ``label_key`` with its colons."""
    return F.regexp_replace(clean_text(c), r"[\s　]+", "")


def label_key(c: Column) -> Column:
    """A label without white space and colons."""
    return F.regexp_replace(c, r"[\s　:：]+", "")


def table_rows(html: str | Column) -> Column:
    """array<struct<key, label, value, cell>> of rows that have a heading and a cell, the first of each label."""
    rows = F.regexp_extract_all(text(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda r, tag: F.regexp_extract(r, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    read = lambda label, own: F.struct(label_key(label).alias("key"), label.alias("label"), strip_html_lines(own).alias("value"), own.alias("cell"))
    made = F.transform(
        F.filter(rows, lambda r: r.rlike("(?is)<th[ >].*</th>") & r.rlike("(?is)<td[ >].*</td>")),
        lambda r: x.once(strip_html(cell(r, "th")), lambda label: x.once(cell(r, "td"), lambda own: read(label, own))),
    )
    # what a lambda names is worked out for each of its rows: rows and keys are made once and bound
    first = lambda b: F.filter(b["made"], lambda r, i: (r["key"] != "") & (F.array_position(b["keys"], r["key"]) == i + 1))
    return x.once(made, lambda m: x.once(F.struct(m.alias("made"), F.transform(m, lambda r: r["key"]).alias("keys")), first))


def row_value(rows: Column, exact: tuple[str, ...], partial: tuple[str, ...] = ()) -> Column:
    """The value of the first exact label that has one, else of the first row whose label holds a partial one; else empty."""
    hit = lambda test: F.nullif(F.get(F.filter(rows, lambda r: test(r) & (r["value"] != "")), F.lit(0))["value"], F.lit(""))
    found = [hit(lambda r, e=e: r["key"] == e) for e in exact]
    if partial:
        found.append(hit(lambda r: reduce(lambda a, p: a | F.contains(r["key"], F.lit(p)), partial, F.lit(False))))
    return F.coalesce(*found, F.lit(""))


def company_url(c: Column) -> Column:
    """True for an address that may be a company's own."""
    low = F.lower(text(c))
    return low.rlike("^https?://") & ~reduce(lambda a, d: a | F.contains(low, F.lit(d)), NOT_COMPANY, F.lit(False))


def site(rows: Column, html: str | Column) -> Column:
    """The company's own address: of a cell so labelled, its link or text, then of a label that holds one, then any link."""
    links = lambda h: F.regexp_extract_all(h, F.lit(r"""(?i)<a\b[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    first = lambda urls: F.get(F.filter(urls, company_url), F.lit(0))
    of = lambda r: F.coalesce(first(links(r["cell"])), first(F.array(F.regexp_extract(r["value"], r"(https?://[^\s]+)", 1))))
    named = lambda test: F.get(F.filter(F.transform(F.filter(rows, lambda r: test(r)), of), lambda u: u.isNotNull()), F.lit(0))
    exact = [named(lambda r, s=s: r["key"] == s) for s in SITE]
    holds = named(lambda r: reduce(lambda a, s: a | F.contains(r["key"], F.lit(s)), SITE, F.lit(False)))
    return F.coalesce(*exact, holds, first(links(text(html))), F.lit(""))


def outline_record(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A record of 17 columns from each outline page."""
    rows = df.withColumn("_rows", table_rows(html))
    name = strip_html(F.regexp_extract(text(html), r"""(?is)<div[^>]*class=["'][^"']*heading1[^"']*["'][^>]*>.*?<h1[^>]*>(.*?)</h1>""", 1))
    block = F.regexp_extract(text(html), r"""(?is)<div[^>]*class=["'][^"']*category[^"']*["'][^>]*>(.*?)</div>""", 1)
    kinds = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<span[^>]*>(.*?)</span>"), F.lit(1)), strip_html), lambda s: s != "")
    cell = lambda row: F.regexp_extract(text(html), rf"""(?is)<tr[^>]*id=["']{row}["'][^>]*>.*?<td[^>]*>(.*?)</td>""", 1)
    made = {c: row_value(F.col("_rows"), labels) for c, labels in LABELS.items()} | {
        "会社名": name, "URL": site(F.col("_rows"), html), "業種": F.array_join(kinds, " / "), "元URL": text(url),
        "採用実績（学校）": x.trim_all(F.replace(strip_html(cell("school")), F.lit("もっと見る"), F.lit(""))), "採用実績（人数）": strip_html_lines(cell("ninzuu")),
    }
    return rows.select(*[made.get(c, F.lit("")).alias(c) for c in COLUMNS])


def contact_rows(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, label, value) of contact tables: the known table's rows, else those of tables that have a contact label."""
    known = F.regexp_extract(text(html), r"""(?is)<table[^>]*class=["']dataTable last dataTable02 ver02["'][^>]*>(.*?)</table>""", 1)
    tables = F.transform(F.regexp_extract_all(text(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1)), table_rows)
    some = F.flatten(F.filter(tables, lambda t: F.exists(t, lambda r: r["label"].isin(*CONTACT))))
    rows = df.select(*keys, F.explode_outer(F.when(known != "", table_rows(known)).otherwise(some)).alias("r")).where("r IS NOT NULL")
    return rows.select(*keys, "r.label", "r.value")


def merge_contacts(rows: DataFrame, company: str, order: str) -> DataFrame:
    """(company, label, value): the first value that is not empty, by page order; a label with none keeps an empty one."""
    filled = F.struct(F.col("value") == "", order)
    return rows.groupBy(company, "label").agg(F.min_by("value", filled).alias("value"))


def contact_fields(merged: DataFrame, company: str) -> DataFrame:
    """(company, contact, access, mail): the address of the first mail label, else one in the contact's text."""
    pick = lambda label: F.max(F.when(F.col("label") == label, F.nullif("value", F.lit(""))))
    names = {label: f"c{k}" for k, label in enumerate(CONTACT)}  # labels that differ by case only need names of their own
    wide = merged.groupBy(company).agg(*[pick(label).alias(n) for label, n in names.items()])
    mail = F.coalesce(*[F.col(names[m]) for m in MAIL], x.email(names["問合せ先"]), F.lit(""))
    return wide.select(company, text(names["問合せ先"]).alias("contact"), text(names["交通機関"]).alias("access"), mail.alias("mail"))


def result_count(html: str | Column, size: int = 100) -> Column:
    """struct<total, pages> of a search page."""
    t = strip_html(html)
    total = F.coalesce(
        *[F.regexp_replace(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), ",", "").cast("int") for p in (r"企業検索結果\s*([0-9,]+)\s*社", r"全\s*([0-9,]+)\s*社\s*\d+\s*-\s*\d+\s*社表示")],
        F.lit(0),
    )
    return F.struct(total.alias("total"), F.ceil(total / size).cast("int").alias("pages"))


def first_page_of(df: DataFrame, url: str = "url", page: str = "page") -> DataFrame:
    """The first result page of each company's address."""
    return df.groupBy(url).agg(F.min(page).alias(page))


def merge_offices(offices: DataFrame) -> DataFrame:
    """Offices of a company that share a name, else an address, else the company: one each, its candidates in order.

    ``offices`` has company_id, seq, office_name, company and arrays of candidates.
    """
    arrays = [f.name for f in offices.schema.fields if f.dataType.typeName() == "array"]
    key = F.coalesce(x.nullable("office_name"), x.nullable(F.get("address", F.lit(0))), x.nullable("company"), F.concat(F.lit("office-"), "seq"))
    grouped = offices.withColumn("key", key).groupBy("company_id", "key").agg(
        F.min("seq").alias("seq"), F.min_by("office_name", "seq").alias("office_name"), F.min_by("company", F.when(F.col("company").isNotNull(), F.col("seq"))).alias("company"),
        F.array_sort(F.collect_list(F.struct("seq", *arrays))).alias("all"),
    )
    return grouped.select("company_id", "seq", "office_name", "company", *[x.unique_texts(F.flatten(F.col(f"all.{a}"))).alias(a) for a in arrays])


def focus_cutoff(values: DataFrame, needed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(company_id, focus, page_seq): pages that are read before all needed fields of their focus have a value.

    ``values`` has company_id, focus, page_seq, field of every value found. The page that first gives
    the last needed field is the last one read; focuses that ``needed`` does not name read all.
    """
    first = values.groupBy("company_id", "focus", "field").agg(F.min("page_seq").alias("page_seq"))
    sizes = F.create_map(*[F.lit(v) for f, fields in needed.items() for v in (f, len(fields))])
    wanted = reduce(lambda a, b: a | b, [(F.col("focus") == f) & F.col("field").isin(*fields) for f, fields in needed.items()], F.lit(False))
    ready = first.where(wanted).groupBy("company_id", "focus").agg(F.count("*").alias("k"), F.max("page_seq").alias("at"))
    ready = ready.where(F.col("k") >= F.element_at(sizes, F.col("focus"))).select("company_id", "focus", "at")
    pages = values.select("company_id", "focus", "page_seq").distinct()
    return pages.join(ready, ["company_id", "focus"], "left").where("at IS NULL OR page_seq <= at").drop("at")
