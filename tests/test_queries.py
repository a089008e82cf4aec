"""Registered queries beside their SQL, on the smallest data folder."""

import os

import pytest

from meibo.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Some of each kind; the driver compares all of them.
NAMES = sorted(ORACLES)[::5]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    wanted = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(map(tuple, wanted), key=key)


def test_a_row_of_an_outline_table_is_read_once(spark):
    """rows were read again for each row of the page, and all pages were one task."""
    from meibo.operators import jobboard as j

    assert str(j.table_rows("html")).count("</tr>") == 1
    page = "<table>" + "".join(f"<tr><th> 資本金 {n % 3}：</th><td>{n}<br>円</td></tr>" for n in range(7)) + "<tr><th></th><td>x</td></tr></table>"
    (row,) = spark.createDataFrame([(page,)], "html string").select(j.table_rows("html").alias("r")).collect()
    assert [tuple(r) for r in row.r] == [(f"資本金{n}", f"資本金 {n}：", f"{n}\n円", f"{n}<br>円") for n in range(3)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
@pytest.mark.parametrize("name", ["outline_record", "outline_rows", "extract_offices"])
def test_pages_of_one_file_are_many_tasks(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
def test_parts_grow_with_companies(spark):
    """a task held the same share of all companies, however many there were."""
    from meibo.schema import dealt_companies

    assert dealt_companies(spark, DATA, 10).rdd.getNumPartitions() == 15
    assert dealt_companies(spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_head_count_is_read_once(spark):
    """a rule's number was read again each time that it was named."""
    from meibo.functions import text as x

    assert str(x.employee_count("c")).count("単体[^0-9]") == 1


def test_pages_are_read_in_small_slices():
    """all lines of a batch of 10 000 pages were held as Python objects at once."""
    pa = pytest.importorskip("pyarrow")
    from meibo.operators import markup

    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], ["n"])
    some = list(markup.slices(iter([batch])))
    assert [b.num_rows for b in some] == [64, 64, 22]
    assert [n for b in some for n in b.column(0).to_pylist()] == list(range(150))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
def test_the_gate_of_later_pages_reads_those_pages(spark, monkeypatch):
    """top pages were read for candidates that the count leaves out by their place."""
    from meibo.operators import pages as p

    read, real = [], p.candidates
    monkeypatch.setattr(p, "candidates", lambda pages: read.append(pages) or real(pages))
    got = {r.field: r.n for r in QUERIES["page_field_gate"](spark, DATA).collect()}
    assert got == {"email": 150, "form_url": 150}
    assert [r.page_seq for r in read[0].select("page_seq").distinct().collect()] == [1]
