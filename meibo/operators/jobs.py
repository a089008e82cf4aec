"""Accounting of extraction jobs: targets with their places, progress, time spent, and what is left to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.operators.dedupe import number_rows
from meibo.operators.listing import list_order

DONE = ("done", "skipped", "failed")
NO_RESULT = "結果がありません"
NO_CHANGE = "更新候補なし"


def create_targets(companies: DataFrame, job_id: str) -> DataFrame:
    """A target for each company that has a site, numbered from 0 in list order."""
    rows = companies.where(F.trim(F.coalesce("website_url", F.lit(""))) != "")
    out = number_rows(rows, list_order(), "target_index")
    return out.select(
        F.lit(job_id).alias("job_id"), F.col("target_index").cast("int"), F.col("id").alias("row_id"), "company", "address", "website_url",
        F.lit("waiting").alias("status"),
    )


def targets_join_companies(targets: DataFrame, companies: DataFrame) -> DataFrame:
    """Targets with their company's present name; the target's own address goes first."""
    c = companies.select(F.col("id").alias("row_id"), F.col("company").alias("now_company"), F.col("address").alias("now_address"))
    out = targets.join(c, "row_id", "left")
    return out.withColumn("address", F.coalesce("address", "now_address")).drop("now_address")


def targets_without_preview(targets: DataFrame, preview: DataFrame) -> DataFrame:
    """Ended targets that left nothing to review."""
    return targets.where(F.col("status").isin(*DONE)).join(preview.select("job_id", "row_id"), ["job_id", "row_id"], "left_anti")


def job_progress(targets: DataFrame) -> DataFrame:
    """Counts by status and the first unfinished place of each job, its total if there is none."""
    ended = F.col("status").isin(*DONE)
    count = lambda s: F.count_if(F.col("status") == s)
    out = targets.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(ended).alias("processed"), count("done").alias("updated"), count("skipped").alias("skipped"),
        count("failed").alias("failed"), F.min(F.when(~ended, F.col("target_index"))).alias("next_index"),
    )
    out = out.withColumn("next_index", F.coalesce(F.col("next_index").cast("long"), "total"))
    return out.withColumn("completed", (F.col("total") > 0) & (F.col("next_index") >= F.col("total")))


def job_elapsed_ms(targets: DataFrame, now: Column) -> DataFrame:
    """Milliseconds that the targets of each job took; one still in work counts up to ``now``."""
    ms = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
    end = F.coalesce("finished_at", F.when(F.col("status") == "processing", now), "started_at")
    spent = F.greatest(F.lit(0.0), ms(end) - ms(F.col("started_at")))
    return targets.where("started_at IS NOT NULL").groupBy("job_id").agg(F.floor(F.sum(spent)).cast("long").alias("elapsed_ms"))


def preview_page(preview: DataFrame, job_id: str, page: int = 1, size: int = 20) -> DataFrame:
    """A page of a job's preview by row and office; sizes of 1 to 100, pages within the job's."""
    size = min(max(size, 1), 100)
    own = preview.where(F.col("job_id") == job_id)
    page = min(max(page, 1), max(1, -(-own.count() // size)))
    return own.orderBy("row_id", "office_index").offset((page - 1) * size).limit(size)


def preview_counts(targets: DataFrame, preview: DataFrame) -> DataFrame:
    """Preview rows and targets without any, of each job."""
    shown = preview.groupBy("job_id").agg(F.count("*").alias("preview_total"))
    hidden = targets_without_preview(targets, preview).groupBy("job_id").agg(F.count("*").alias("excluded_count"))
    jobs = targets.select("job_id").distinct()
    out = jobs.join(shown, "job_id", "left").join(hidden, "job_id", "left")
    return out.fillna(0, ["preview_total", "excluded_count"])


def result_status(status: Column, has_payload: Column, n_changes: Column) -> Column:
    """struct<status, reason> of a worker's result."""
    made = lambda s, r=None: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    other = F.struct(status.alias("status"), F.lit(None).cast("string").alias("reason"))
    return (
        F.when((status == "done") & ~has_payload, made("failed", NO_RESULT))
        .when((status == "done") & (n_changes == 0), made("skipped", NO_CHANGE))
        .otherwise(other)
    )


def target_status_update(targets: DataFrame, updates: DataFrame) -> DataFrame:
    """Targets after updates (job_id, target_index, status, reason, at): when begun, when ended, and why.

    A target in work begins at ``at`` unless it has begun; an ended one ends at ``at``. The reason
    of a skip and the message of a failure stand in their own columns, and others are cleared.
    """
    u = updates.select("job_id", "target_index", F.col("status").alias("s"), F.col("reason").alias("r"), "at")
    hit = F.col("s").isNotNull()
    ended = F.col("s").isin(*DONE)
    when = lambda test, new, old: F.when(hit, F.when(test, new)).otherwise(F.col(old))
    return targets.join(u, ["job_id", "target_index"], "left").withColumns(
        {
            "status": F.coalesce("s", "status"),
            "started_at": F.when(hit, F.coalesce("started_at", "at")).otherwise(F.col("started_at")),
            "finished_at": when(ended, F.col("at"), "finished_at"),
            "skip_reason": when(F.col("s") == "skipped", F.col("r"), "skip_reason"),
            "error_message": when(F.col("s") == "failed", F.col("r"), "error_message"),
        }
    ).drop("s", "r", "at")
