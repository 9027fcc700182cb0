"""Progress of a stream: statistics of each micro-batch and of everything so far."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quincunx.functions import summary
from quincunx.operators.moments import EMPTY_STATE, MERGE_STATES, STATE, column_moments
from quincunx.operators.sketch import NAMES, POINTS, bins_sql, block_sketches, quantiles_sql
from quincunx.sources.stored import new_folder

_STATE_DDL = "struct<candidates:bigint,n:bigint,mean:double,m2:double,low:double,high:double>"
_STORED_DDL = f"id string, batch_state {_STATE_DDL}, total {_STATE_DDL}, sketch binary"


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share."""
    return new_folder(spark)


def write_progress(batch: DataFrame, measures: Mapping[str, str], folder: str, number: int) -> None:
    """Stores the moment states of micro-batch ``number``, and the states and sketches of all rows
    up to it: those of the batch before, merged with its own.

    A batch costs the same however many came before.  Running one again, after a restart,
    reads the same batch before it and replaces its own folder, so that it counts once.
    """
    spark, state = batch.sparkSession, f"struct({', '.join(STATE)})"
    sketches = block_sketches(batch, "1L", measures).select("id", "sketch")
    fresh = column_moments(batch, measures).join(F.broadcast(sketches), "id").selectExpr("id", f"{state} AS s", "sketch")  # one row per measure
    if number:
        before = spark.read.schema(_STORED_DDL).parquet(f"{folder}/progress/batch={number - 1}")
        before = before.selectExpr("id", "0 AS place", "total AS s", "sketch")
    else:
        before = fresh.where("false").selectExpr("id", "0 AS place", "s", "sketch")
    both = before.unionByName(fresh.selectExpr("id", "1 AS place", "s", "sketch")).groupBy("id").agg(
        F.expr("max_by(s, place)").alias("batch_state"),
        F.expr(f"aggregate(transform(array_sort(collect_list(struct(place, s))), x -> x.s), {EMPTY_STATE}, (a, b) -> {MERGE_STATES})").alias("total"),
        F.expr(f"kll_merge_agg_double(sketch, {POINTS})").alias("sketch"),
    )
    both.coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")


def start_progress(
    stream: DataFrame, measures: Mapping[str, str], folder: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Runs ``stream`` and keeps the states of each micro-batch under ``folder``, which the
    driver and all executors must share."""

    return (
        stream.writeStream.foreachBatch(lambda batch, number: write_progress(batch, measures, folder, number))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, folder: str, total_rows: int | None = None) -> DataFrame:
    """(batch, id, batch_state, total, sketch, progress): after each batch the state and the
    sketch of all rows so far, and their share of ``total_rows``.

    Totals were merged, in batch order, as the batches came.
    """
    whole = "cast(NULL AS double)" if total_rows is None else f"total.candidates / {max(1, total_rows)}"
    rows = spark.read.schema(f"{_STORED_DDL}, batch long").parquet(f"{folder}/progress")
    return rows.selectExpr("batch", "id", "batch_state", "total", "sketch", f"{whole} AS progress")


def progress_events(progress: DataFrame, total_rows: int, bins: int = 30) -> DataFrame:
    """The event log as JSON in ``value``: start, one event per batch and measure, complete.

    A batch event has the counts, quantiles, diagnostics and histogram of all rows so far;
    quantiles and bins are read off the merged sketch, and the bins add up to the valid rows.
    """
    t = {c: f"total.{c}" for c in STATE}
    quantiles = quantiles_sql(n=t["n"])
    record = summary.diagnostics(t["n"], t["candidates"], t["mean"], t["m2"], t["low"], t["high"])
    body = f"""named_struct('type', kind, 'id', id, 'batch_index', number, 'processed_iterations', {t['candidates']},
        'valid_results', {t['n']}, 'discarded_results', {t['candidates']} - {t['n']}, 'total_iterations', {total_rows}L,
        {', '.join(f"'{name}', q[{k}]" for k, name in enumerate(NAMES))}, 'diagnostics', {record},
        'histogram', named_struct('data_min', {t['low']}, 'data_max', {t['high']}, 'total_count', {t['n']}, 'bins', bins))"""
    last = progress.groupBy("id").agg(F.expr("max_by(struct(batch, total, sketch), batch)").alias("s")).select("id", "s.*")
    rows = progress.selectExpr("'batch' AS kind", "id", "batch", "batch AS number", "total", "sketch").unionByName(
        last.selectExpr("'complete' AS kind", "id", "batch + 1 AS batch", "cast(NULL AS bigint) AS number", "total", "sketch")
    )
    events = rows.selectExpr("batch", "id", "number", "kind", "total", f"{quantiles} AS q",
                             f"{bins_sql(bins, t['low'], t['high'], t['n'])} AS bins")
    events = events.selectExpr("batch", f"to_json({body}) AS value")
    start = progress.sparkSession.range(1).selectExpr(
        "-1L AS batch", f"to_json(named_struct('type', 'start', 'total_iterations', {total_rows}L)) AS value"
    )
    return start.unionByName(events)
