"""Offices and labelled values read out of a page's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from meibo.operators.markup import slices

# Words that end an office's name, lines that end a block, and shapes of contact data.
_HEAD = re.compile(r"^(.{1,50}?(?:本社|本店|支店|営業所|工場|事業所|センター|事業部|営業部|管理部|総務部|経理部|人事部))(?:\s|$|[:：])")
_STOP = re.compile(r"^(?:会社情報|業種|創業|設立|資本金|従業員数|取引先|経営理念|沿革|Access|Contact|History)")
_ZIP = re.compile(r"(?:〒\s*)?(\d{3})-?(\d{4})(?!\d)")
_NUMBER = re.compile(r"0\d{1,4}-?\d{1,4}-?\d{3,4}")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_FAX = re.compile("FAX|ＦＡＸ|ファックス", re.IGNORECASE)
_ADDRESS = re.compile(r"((?:北海道|東京都|京都府|大阪府|[^\s\d]{2,3}県)[^\s]*[市区町村郡][^\s]*\d[^\s]*)")
_WIDE = str.maketrans("０１２３４５６７８９－", "0123456789-")


def evidence(line: str) -> dict[str, list[str]]:
    """The contact data of one line."""
    s = line.translate(_WIDE)
    numbers = [m[0] for m in _NUMBER.finditer(s) if 10 <= len(m[0].replace("-", "")) <= 11]
    fax = bool(_FAX.search(s))
    zips = ["-".join(m.groups()) for m in _ZIP.finditer(s) if not any(m[0] in n for n in numbers)]
    return {
        "phone": [] if fax else numbers, "fax": numbers if fax else [], "email": _MAIL.findall(s), "zipcode": zips,
        "address": [m[1] for m in _ADDRESS.finditer(s)][:1],
    }


def office_blocks(lines: list[str]) -> list[dict]:
    """Blocks from a line that names an office and has contact data, or whose next line has, to the next such line or a stop.

    A block without contact data is none; an office has the first address of its block.
    """
    found = [evidence(line) for line in lines]
    out: list[dict] = []
    now: dict | None = None
    for k, line in enumerate(lines):
        head = _HEAD.match(line)
        near = any(any(e.values()) for e in found[k : k + 2])
        if head and near:
            now = {"office_name": head[1], **{f: [] for f in found[k]}}
            out.append(now)
        elif now and _STOP.match(line):
            now = None
        if now:
            for f, values in found[k].items():
                now[f] += [v for v in values if v not in now[f] and (f != "address" or not now[f])]
    return [o for o in out if any(o[f] for f in ("phone", "fax", "email", "zipcode", "address"))]


def extract_offices(df: DataFrame, key: str = "company_id", seq: str = "page_seq", company: str = "company", lines: str = "lines") -> DataFrame:
    """(key, seq, office_name, company, phone, fax, email, zipcode, address) of the offices that pages' lines name.

    ``seq`` orders offices by page and place; a company's name gets the office's name if it does not hold it.
    """
    arrays = ("phone", "fax", "email", "zipcode", "address")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, seq long, office_name string, company string, " + ", ".join(f"{a} array<string>" for a in arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for k, page, name, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for n, o in enumerate(office_blocks((text or "").split("\n"))):
                    full = o["office_name"] if not name else name if o["office_name"] in name else f"{name} {o['office_name']}"
                    rows.append((k, (page << 32) + n, o["office_name"], full, *(o[a] for a in arrays)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [key, "seq", "office_name", "company", *arrays])

    return df.select(key, seq, company, lines).mapInArrow(run, schema)


def labelled_line(lines: list[str], labels: str) -> str | None:
    """The value after a label on a line, with or without a colon or bar, or on the line after a label alone."""
    inline = re.compile(rf"^(?:{labels})\s*[:：|｜]\s*(.+)$|^(?:{labels})\s+(\S.*)$")
    alone = re.compile(rf"^(?:{labels})\s*[:：|｜]?$")
    for k, line in enumerate(lines):
        if m := inline.match(line):
            return (m[1] or m[2]).strip()
        if alone.match(line) and k + 1 < len(lines) and lines[k + 1].strip():
            return lines[k + 1].strip()
    return None


def labelled_values(df: DataFrame, labels: dict[str, str], key: str = "company_id", lines: str = "lines") -> DataFrame:
    """(key, field, value) of every field of ``labels`` (field -> pattern) that a page's lines name."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (text or "").split("\n")
                rows += [(k, f, v) for f, p in labels.items() if (v := labelled_line(own, p))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            types = (batch.schema.field(0).type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [key, "field", "value"])

    return df.select(key, lines).mapInArrow(run, schema)
