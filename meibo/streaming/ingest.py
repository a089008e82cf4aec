"""Results of workers, applied to jobs in target order: as a stream with state, and over a table at once.

A result below its job's next place is late and dropped. One above it fails the places between. State
is one number for each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meibo.sources.shared import cut

GAP = "途中の結果が届きませんでした"
SCHEMA = "job_id string, target_index long, status string, reason string"


def ingest_results(results: DataFrame, order: str = "batch") -> DataFrame:
    """(job_id, target_index, status, reason) of all results at once; ``order`` says which came first.

    Within one ``order`` results go by place, and the first of equal places counts. The next place is
    the greatest so far plus one: a running maximum in two levels. Rows are sorted by range, so that a
    job of any size is many parts; each part has a running maximum of its own, and the greatest place
    of a job's parts before it, one row for each part and job, is added.
    """
    rows = results.select("job_id", F.col("target_index").cast("long").alias("target_index"), "status", "reason", order)
    rows = cut(rows.orderBy("job_id", order, "target_index", "status", "reason").withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("job_id", "_part").agg(F.max("target_index").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("job_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("job_id", "_part", before.alias("_before"))
    seen = Window.partitionBy("job_id", "_part").orderBy(order, "target_index", "status", "reason").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.max("target_index").over(seen)).join(parts, ["job_id", "_part"])
    rows = rows.withColumn("next", F.coalesce(F.greatest("_own", "_before") + 1, F.lit(0)))
    good = rows.where("target_index >= next")
    gaps = good.where("target_index > next").select("job_id", F.explode(F.sequence("next", F.col("target_index") - 1)).alias("target_index"))
    gaps = gaps.select("job_id", "target_index", F.lit("failed").alias("status"), F.lit(GAP).alias("reason"))
    return good.select("job_id", "target_index", "status", "reason").unionByName(gaps)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at = state.get[0] if state.exists else 0
    good = []
    for batch in batches:  # the first result of each place that is not passed, batch by batch
        batch = batch[batch["target_index"] >= at].sort_values(["target_index", "status", "reason"])
        good.append(batch.drop_duplicates("target_index"))
    rows = pd.concat(good).sort_values(["target_index", "status", "reason"]).drop_duplicates("target_index")
    end = int(rows["target_index"].max()) + 1 if len(rows) else at
    missing = np.setdiff1d(np.arange(at, end), rows["target_index"].to_numpy(), assume_unique=True)
    gaps = pd.DataFrame({"job_id": key[0], "target_index": missing, "status": "failed", "reason": GAP})
    state.update((end,))
    yield pd.concat([rows, gaps])[["job_id", "target_index", "status", "reason"]]


def ingest_results_stream(results: DataFrame) -> DataFrame:
    """The same over a stream: one job's results of a micro-batch meet in one task with its state."""
    rows = results.select("job_id", F.col("target_index").cast("long").alias("target_index"), "status", "reason")
    return rows.groupBy("job_id").applyInPandasWithState(_advance, SCHEMA, "next long", "append", GroupStateTimeout.NoTimeout)


def run_once(out: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet under ``path``, and reads that."""
    query = out.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/data")


def login_history(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Login events of a stream (user_id, event_id, logged_at and others), each once.

    An event that comes again within ``delay`` of its time is a replay and dropped; what is known of an
    event is forgotten after that, so state does not grow with the table. Events later than that are dropped.
    """
    return events.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def login_history_stream(events: DataFrame, path: str, delay: str = "1 day"):
    """Appends login events to a table, replays left out; the caller stops the returned query."""
    out = login_history(events, delay).writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
    return out.outputMode("append").start()
