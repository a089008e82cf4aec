"""CSV in and out, tables by JDBC, JSON columns, and mirrored tables."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meibo.operators.dedupe import assign_missing_ids, js_trim, keep_first
from meibo.operators.filters import Request, predicate
from meibo.operators.jobboard import COLUMNS
from meibo.operators.listing import list_order
from meibo.schema import CSV_HEADERS, FIELD_OF_HEADER, FIELDS, NAMES
from meibo.sources.shared import cut

_RAW = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(CSV_HEADERS))])


def read_company_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every row of the files, headers included, as 28 texts with ``_file`` and ``_row``, which order them.

    Quotes are doubled inside quotes, and a quoted cell may hold line ends (CRLF there reads as LF). A
    byte-order mark is dropped. A file is read by one task, since a quoted line end cannot be told
    from a row's end by a reader that starts in the middle. ``_row`` orders the rows of one file only.
    """
    raw = spark.read.csv(paths, schema=_RAW, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_row", F.monotonically_increasing_id())


def check_csv_headers(raw: DataFrame) -> list[str]:
    """The files whose first row is not the 28 headers in order; a file of fewer than two rows is not looked at."""
    cells = [F.regexp_replace(js_trim(F.coalesce(F.col(f"_c{k}"), F.lit(""))), "^﻿", "") for k in range(len(CSV_HEADERS))]
    first = F.min_by(F.array(*cells), "_row").alias("head")
    heads = raw.groupBy("_file").agg(first, F.count("*").alias("n"))
    bad = heads.where((F.col("n") >= 2) & (F.col("head") != F.array(*[F.lit(h) for h in CSV_HEADERS])))
    return [r["_file"] for r in bad.select("_file").orderBy("_file").collect()]


def clean_csv_cells(raw: DataFrame) -> DataFrame:
    """Rows after each file's first, by field; cells trimmed, blank ones null, rows of none but blanks dropped."""
    first = raw.groupBy("_file").agg(F.min("_row").alias("_head"))
    rows = raw.join(F.broadcast(first), "_file").where("_row > _head")  # one row for each file
    rows = rows.where(js_trim(F.concat_ws("", *[f"_c{k}" for k in range(len(CSV_HEADERS))])) != "")
    trimmed = rows.select("_file", "_row", *[js_trim(F.col(f"_c{k}")).alias(FIELD_OF_HEADER[h]) for k, h in enumerate(CSV_HEADERS)])
    return trimmed.select("_file", "_row", *[F.when(F.col(f) != "", F.col(f)).alias(f) for f in NAMES])


def import_companies(spark: SparkSession, paths: str | list[str], existing: DataFrame | None = None, unique_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies with the files' rows appended and numbered, counts of inserted and skipped rows).

    One bad header rejects all files. With ``unique_by`` the first row of each value, by file and row,
    is taken. Rows come after the existing ones and take the ids after theirs.
    """
    raw = read_company_csv(spark, paths)
    bad = check_csv_headers(raw)
    if bad:
        raise ValueError(f"not the company list's headers: {', '.join(bad)}")
    rows = cut(clean_csv_cells(raw))  # the files are parsed once
    kept = rows if unique_by is None else keep_first(rows, unique_by, ["_file", "_row"], unicode_trim=True)
    new = kept.select(F.lit(None).cast("long").alias("id"), *NAMES, "_file", "_row")
    none = [F.lit(None).cast("string").alias("_file"), F.lit(None).cast("long").alias("_row")]
    every = new if existing is None else existing.select("id", *NAMES, *none).unionByName(new)
    return assign_missing_ids(every, order=[F.col("_file"), F.col("_row")]).drop("_file", "_row"), import_counts(rows, kept)


def append_companies(spark: SparkSession, path: str, files: str | list[str], batch: str, unique_by: str | None = None) -> DataFrame:
    """The table of companies under ``path`` with the files' rows appended as a batch; a batch that is there is not added again.

    Batches are folders of the table. A batch is written as a whole or not at all, numbered from the
    greatest stored id on, and stored rows are read for that number alone, so that appending costs
    what the new rows cost. One writer at a time is assumed, as a number is no lock.
    """
    held = stored_companies(spark, path)
    if held is not None and not held.where(F.col("batch") == batch).isEmpty():
        return held
    top = 0 if held is None else held.agg(F.max("id")).first()[0] or 0
    rows, _ = import_companies(spark, files, None, unique_by)
    rows.withColumn("id", F.col("id") + top).write.mode("append" if held is None else "overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/batch={quote(batch, safe='')}")
    return stored_companies(spark, path)


def stored_companies(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, fields, batch) of a table that ``append_companies`` wrote; null if there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    return spark.read.schema(T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, T.StringType()) for f in NAMES], T.StructField("batch", T.StringType())])).parquet(path)


def import_counts(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: inserted and skipped rows."""
    counted = rows.select(F.lit(0).alias("k")).unionByName(kept.select(F.lit(1).alias("k")))
    n = lambda k: F.count_if(F.col("k") == k)
    return counted.agg(n(1).alias("inserted"), (n(0) - n(1)).alias("skipped"))


def csv_line(columns: list[Column]) -> Column:
    """Cells in quotes, quotes doubled, null as an empty cell."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[cell(c) for c in columns])


def export_lines(df: DataFrame, request: Request | None = None, scope: Request | None = None, unique_by: str | None = None) -> DataFrame:
    """Sorted CSV lines of the companies; without a request all of the scope's, with ``unique_by`` the first of each value."""
    rows = df.where(predicate(request or Request(), scope))
    if unique_by is not None:
        keys = [F.coalesce(c, F.lit("")).alias(f"_o{k}") for k, c in enumerate(("company", "address"))]
        rows = keep_first(rows.select("*", *keys), unique_by, ["_o0", "_o1", "id"], unicode_trim=True)
    return rows.orderBy(*list_order()).select(csv_line([F.col(f) for f in NAMES]).alias("value"))


def export_company_csv(df: DataFrame, path: str, **how) -> None:
    """Sorted lines as files that, one after the other, make one CSV with byte-order mark, header and CRLF."""
    head = "﻿" + ",".join(f'"{h}"' for _, _, h in FIELDS)
    spark = df.sparkSession
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/part=0", lineSep="\r\n")
    export_lines(df, **how).write.text(f"{path}/part=1", lineSep="\r\n")


def export_job_rows(targets: DataFrame, changes: DataFrame, companies: DataFrame, kind: str = "all") -> DataFrame:
    """Targets with a before and a candidates column for each changed field.

    ``kind``: all rows, ``done`` ones, those with ``candidates``, or ``candidates_only`` without the
    company's own columns.
    """
    wide = changes.groupBy("row_id").pivot("field", sorted(NAMES)).agg(
        F.first("before").alias("before"), F.first(F.array_join("candidates", "\n")).alias("candidates")
    )
    own = companies.withColumnRenamed("id", "row_id").select("row_id", *NAMES)
    rows = targets.where("status IN ('done', 'skipped', 'failed')") if kind == "done" else targets
    out = rows.select("target_index", "row_id", "status").join(wide, "row_id", "inner" if kind.startswith("candidates") else "left")
    return out if kind == "candidates_only" else out.join(own, "row_id", "left")


def jobboard_table(df: DataFrame) -> DataFrame:
    """The 17 columns of a job-board export in order; absent ones are empty."""
    return df.select(*[(F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in COLUMNS])


def write_jobboard_csv(df: DataFrame, path: str) -> None:
    """Files that, one after the other, make one CSV with byte-order mark and header."""
    head = "\ufeff" + ",".join(f'"{c}"' for c in COLUMNS)
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/part=0", lineSep="\r\n")
    lines = jobboard_table(df).select(csv_line([F.col(c) for c in COLUMNS]).alias("value"))
    lines.write.text(f"{path}/part=1", lineSep="\r\n")


def read_table_jdbc(spark: SparkSession, url: str, name: str, low: int, high: int, parts: int = 64, **options) -> DataFrame:
    """A table read by ranges of its id; each range is a query of its own."""
    return spark.read.jdbc(url, name, column="id", lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_table_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options) -> None:
    df.write.jdbc(url, name, mode=mode, properties=options)


def mirror_table(source: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Writes the source over every target folder and reports (name, rows, source_rows, same)."""
    spark = source.sparkSession
    counts = [source.agg(F.lit("").alias("name"), F.count("*").alias("rows"))]
    for name, path in targets.items():
        source.write.mode("overwrite").parquet(path)
        counts.append(spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("rows")))
    total = counts[0].first()["rows"]
    out = counts[1]
    for c in counts[2:]:
        out = out.unionByName(c)
    return out.withColumn("source_rows", F.lit(total)).withColumn("same", F.col("rows") == F.col("source_rows"))


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text as a struct; what is no JSON is null."""
    return df.withColumn(column, F.from_json(column, schema))


def to_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))
