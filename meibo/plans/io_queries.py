"""Queries of import, export, mirrors, JSON and the result stream."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.operators.filters import FieldFilter, Request
from meibo.plans.job_queries import TARGETS
from meibo.schema import CSV_HEADERS, FIELDS, NAMES, companies, with_companies
from meibo.sources import files
from meibo.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    from meibo.sources.shared import cut

    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


#: Files of a list: each has rows of a range of ids and the header.
N_FILES = 4


def _written(spark: SparkSession, sf_dir: str, where: str = "true") -> str:
    """The companies as CSV files, each with the header, cells with quotes and line ends among them, and a blank row at the end."""
    path = f"{_folder(spark)}/csv"
    rows = companies(spark, sf_dir).where(where).withColumn("memo", F.when(F.col("id") % 10 == 0, F.concat(F.lit(' "引用",\n'), "id", F.lit("行 "))).otherwise(F.col("memo")))
    blank = spark.range(1).select(F.lit(1 << 60).alias("id"), *[F.lit(" ").alias(f) for f in NAMES])
    every = rows.unionByName(blank).repartitionByRange(N_FILES, "id").sortWithinPartitions("id")
    every.select(*[F.col(f).alias(h) for f, h in zip(NAMES, CSV_HEADERS, strict=True)]).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_CELL = lambda c: f"nullif(trim(coalesce({c}, ''), ' 　' || chr(10)), '')"
_MEMO = "CASE WHEN id % 10 = 0 THEN '\"引用\",' || chr(10) || id || '行' ELSE memo END"
_CLEAN = f"(SELECT id, {', '.join(f'{_CELL(f)} AS {f}' for f in NAMES if f != 'memo')}, {_MEMO} AS memo FROM companies)"


def read_company_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.clean_csv_cells(files.read_company_csv(spark, _written(spark, sf_dir))).select(*NAMES)


QUERIES["read_company_csv"] = read_company_csv
ORACLES["read_company_csv"] = with_companies(f"SELECT {', '.join(NAMES)} FROM {_CLEAN}")
QUERIES["import_companies"] = lambda spark, sf_dir: files.import_companies(spark, _written(spark, sf_dir), unique_by="company")[0]
ORACLES["import_companies"] = with_companies(
    f"SELECT row_number() OVER (ORDER BY id) AS id, {', '.join(NAMES)} FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY id) AS n FROM {_CLEAN}) WHERE company IS NULL OR n = 1"
)
QUERIES["csv_import_counts"] = lambda spark, sf_dir: files.import_companies(spark, _written(spark, sf_dir), unique_by="company")[1]
ORACLES["csv_import_counts"] = with_companies(
    f"SELECT count(*) FILTER (company IS NULL OR n = 1) AS inserted, count(*) FILTER (company IS NOT NULL AND n > 1) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY id) AS n FROM {_CLEAN})"
)


def check_csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = files.read_company_csv(spark, _written(spark, sf_dir))
    return raw.agg(F.count("*").alias("n_rows")).withColumn("n_bad", F.lit(len(files.check_csv_headers(raw))))


QUERIES["check_csv_headers"] = check_csv_headers
ORACLES["check_csv_headers"] = with_companies(f"SELECT count(*) + 1 + {N_FILES} AS n_rows, 0 AS n_bad FROM companies")
_LINE = " || ',' || ".join(f"'\"' || replace(coalesce({f}, ''), '\"', '\"\"') || '\"'" for f in NAMES)
QUERIES["export_company_csv"] = lambda spark, sf_dir: files.export_lines(
    companies(spark, sf_dir), Request({"closing_month": FieldFilter("equals", "3月")}), unique_by="small_industry"
)
ORACLES["export_company_csv"] = with_companies(
    f"""SELECT {_LINE} AS value FROM (SELECT *, row_number() OVER (PARTITION BY trim(coalesce(small_industry, ''), ' ') ORDER BY coalesce(company, ''), coalesce(address, ''), id) AS n
    FROM companies WHERE closing_month = '3月') WHERE trim(coalesce(small_industry, ''), ' ') = '' OR n = 1"""
)


def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    files.export_company_csv(companies(spark, sf_dir), path)
    return spark.read.text(path, lineSep="\r\n").agg(F.count("*").alias("n_lines"), F.max("part").cast("int").alias("parts"))


QUERIES["export_company_file"] = export_file
ORACLES["export_company_file"] = with_companies("SELECT count(*) + 1 AS n_lines, 1 AS parts FROM companies")


def jobboard_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job-board file written, and its cells read back."""
    path = _folder(spark)
    files.write_jobboard_csv(companies(spark, sf_dir).select(F.col("company").alias("会社名"), F.col("address").alias("本社所在地"), F.col("email").alias("E-MAIL")), path)
    schema = ", ".join(f"`{c}` string" for c in files.COLUMNS)
    rows = spark.read.csv([f"{path}/part=0", f"{path}/part=1"], schema=schema, multiLine=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    head = [F.col(f"`{c}`").eqNullSafe(("\ufeff" if k == 0 else "") + c) | F.col(f"`{c}`").eqNullSafe(c) for k, c in enumerate(files.COLUMNS)]
    return rows.where(~reduce(lambda a, b: a & b, head)).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in files.COLUMNS])


QUERIES["write_jobboard_csv"] = jobboard_file
ORACLES["write_jobboard_csv"] = with_companies(
    "SELECT "
    + ", ".join({"会社名": "coalesce(company, '')", "本社所在地": "coalesce(address, '')", "E-MAIL": "coalesce(email, '')"}.get(c, "''") + f' AS "{c}"' for c in files.COLUMNS)
    + " FROM companies"
)
QUERIES["mirror_table"] = lambda spark, sf_dir: files.mirror_table(companies(spark, sf_dir), {n: f"{_folder(spark)}/{n}" for n in ("a", "b")})
ORACLES["mirror_table"] = "SELECT name, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer) AS source_rows, true AS same FROM (VALUES ('a'), ('b')) t(name)"
QUERIES["parse_json_columns"] = lambda spark, sf_dir: files.parse_json(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", "k long").select("event_id", "props.k")
ORACLES["parse_json_columns"] = "SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
QUERIES["to_json_columns"] = lambda spark, sf_dir: files.to_json(companies(spark, sf_dir).select("id", F.struct("company", "tag").alias("j")), "j")
ORACLES["to_json_columns"] = with_companies(
    """SELECT id, '{' || CASE WHEN company IS NOT NULL THEN '"company":"' || company || '",' ELSE '' END || '"tag":"' || tag || '"}' AS j FROM companies"""
)

# results: every target's, less each seventh, each fifth twice
RESULTS = """
SELECT job_id, cast(target_index AS bigint) AS target_index, CASE WHEN status IN ('done', 'skipped') THEN status ELSE 'failed' END AS status, CAST('r' AS string) AS reason, 0 AS batch
FROM ({targets}) WHERE target_index % 7 <> 3 AND target_index % 7 <> 4
UNION ALL SELECT job_id, cast(target_index AS bigint), 'failed', 'twice', 1 FROM ({targets}) WHERE target_index % 5 = 0
"""
_RESULTS = RESULTS.replace("{targets}", TARGETS)
_INGESTED = f"""WITH r AS ({_RESULTS.format(orders='orders')}),
 s AS (SELECT *, coalesce(max(target_index) OVER (PARTITION BY job_id ORDER BY batch, target_index, status, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS nxt FROM r),
 g AS (SELECT * FROM s WHERE target_index >= nxt)
SELECT job_id, target_index, status, reason FROM g UNION ALL
SELECT job_id, unnest(range(nxt, target_index)), 'failed', '{ingest.GAP}' FROM g WHERE target_index > nxt"""
QUERIES["ingest_results"] = lambda spark, sf_dir: ingest.ingest_results(spark.sql(_RESULTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")))
ORACLES["ingest_results"] = _INGESTED


def append_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists appended, the first of them twice."""
    path, first, second = f"{_folder(spark)}/table", _written(spark, sf_dir, "id % 3 <> 0"), _written(spark, sf_dir, "id % 3 = 0")
    for batch, source in (("a/1", first), ("a/1", first), ("b", second), ("a/1", second)):
        out = files.append_companies(spark, path, source, batch, unique_by="company")
    return out.select("id", "batch", *NAMES)


QUERIES["append_companies"] = append_companies
_ONCE = "(SELECT *, CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a/1' END AS batch, row_number() OVER (PARTITION BY company, id % 3 = 0 ORDER BY id) AS n FROM {clean})"
ORACLES["append_companies"] = with_companies(
    f"SELECT row_number() OVER (ORDER BY batch, id) AS id, batch, {', '.join(NAMES)} FROM {_ONCE.format(clean=_CLEAN)} WHERE company IS NULL OR n = 1"
)


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both batches of results, each taken by a run of the stream of its own; the state of the first is there for the second."""
    path = _folder(spark)
    rows = spark.sql(_RESULTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    for batch in (0, 1):
        rows.where(F.col("batch") == batch).write.mode("append").parquet(f"{path}/in")
        out = ingest.run_once(ingest.ingest_results_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)
    return out


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins as a stream of files by time, each file sent twice."""
    path = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("logged_at"), F.concat(F.lit("198.51.100."), F.col("event_id") % 256).alias("ip_address"))
    ends = events.select(F.percentile_approx("logged_at", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("e")).first()["e"]
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        some = events.where((F.lit(low).isNull() | (F.col("logged_at") > F.lit(low))) & (F.lit(high).isNull() | (F.col("logged_at") <= F.lit(high))))
        for _ in range(2):
            some.write.mode("append").parquet(f"{path}/in")
            out = ingest.run_once(ingest.login_history(spark.readStream.schema(events.schema).parquet(f"{path}/in"), delay="366 days"), path)
    return out.withColumn("logged_at", F.col("logged_at").cast("timestamp_ntz"))


QUERIES["login_history_stream"] = logins
ORACLES["login_history_stream"] = "SELECT event_id, user_id, ts AS logged_at, '198.51.100.' || event_id % 256 AS ip_address FROM events"
QUERIES["ingest_results_stream"] = stream
ORACLES["ingest_results_stream"] = _INGESTED


# a job's targets with what was found for two fields, the company's own columns beside them
CHANGES = """SELECT id AS row_id, 'phone' AS field, phone AS before, array('0' || cast(id AS string), '1') AS candidates FROM {companies} WHERE id % 2 = 0
UNION ALL SELECT id, 'memo', NULL, array('m') FROM {companies} WHERE id % 3 = 0"""


def job_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    own, orders = companies(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet")
    targets = spark.sql(TARGETS, orders=orders).where("job_id = 'j3'")
    out = files.export_job_rows(targets, spark.sql(CHANGES, companies=own), own, kind)
    return out.select("target_index", "row_id", "status", "phone_before", "phone_candidates", "memo_candidates", *([] if kind == "candidates_only" else ["company"]))


_JOB = f"""SELECT target_index, t.row_id, status, CASE WHEN t.row_id % 2 = 0 THEN phone END AS phone_before, CASE WHEN t.row_id % 2 = 0 THEN '0' || t.row_id || chr(10) || '1' END AS phone_candidates,
 CASE WHEN t.row_id % 3 = 0 THEN 'm' END AS memo_candidates, company FROM ({TARGETS.format(orders='orders')}) t JOIN companies ON id = t.row_id WHERE job_id = 'j3'"""
for _kind, _where in (("all", "true"), ("done", "status IN ('done', 'skipped', 'failed')"), ("candidates", "row_id % 2 = 0 OR row_id % 3 = 0"), ("candidates_only", "row_id % 2 = 0 OR row_id % 3 = 0")):
    QUERIES[f"export_job_rows_{_kind}"] = lambda spark, sf_dir, k=_kind: job_rows(spark, sf_dir, k)
    ORACLES[f"export_job_rows_{_kind}"] = with_companies(f"SELECT {'* EXCLUDE (company)' if _kind == 'candidates_only' else '*'} FROM ({_JOB}) WHERE {_where}")
