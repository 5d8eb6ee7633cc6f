"""The same operators on streams: uploads, ledger events, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import evaluate, ingest, ledger


def ingest_stream(uploads: DataFrame, horizon: str, tender: str = "tender_ref") -> DataFrame:
    """Hash, check and de-duplicate arriving files.

    Copies of a tender are recognised within ``horizon``, which bounds the state.
    """
    rows = ingest.validate_upload(ingest.ingest_documents(uploads, "text"))
    rows = rows.withColumn("doc_format", ingest.detect_format(F.col("filename"))).where(F.col("code").isNull()).drop("code")
    keys = [tender, "sha256_hash"]
    timed = rows.withColumn("event_time", F.to_timestamp("uploaded_at")).withWatermark("event_time", horizon)
    return timed.dropDuplicatesWithinWatermark(keys)


def tail_runs(batches: int) -> list[tuple[int, int]]:
    """The runs (first and last batch) of stored tails after so many batches: one for each bit of their number."""
    runs, first = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            runs.append((first, first + (1 << bit) - 1))
            first += 1 << bit
    return runs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ledger_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Chain arriving events behind the stored tails of their tenders.

    Every micro-batch writes its own folder of entries, so a batch that is run again after a
    lost executor replaces what it wrote before. The last hashes of tenders are stored in runs
    of batches, merged as in a binary counter: batch n finds at most log2(n) runs, each tender
    at most once in each, and writes one, with its own tails and those of the runs that it
    takes in. Runs taken in by a batch go when the next one starts, since that batch is then
    committed and never run again.
    """

    def path(run: tuple[int, int]) -> str:
        return f"{folder}/tails/{run[0]}-{run[1]}"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = tail_runs(batch_id), tail_runs(batch_id + 1)
        for run in set(tail_runs(max(batch_id - 1, 0))) - set(before):
            _remove(spark, path(run))

        def latest(runs: list[tuple[int, int]], own: DataFrame | None = None) -> DataFrame:
            parts = [spark.read.parquet(path(run)).withColumn("_last", F.lit(run[1])) for run in runs]
            parts += [] if own is None else [own.withColumn("_last", F.lit(batch_id))]
            whole = reduce(DataFrame.unionByName, parts)
            return whole.groupBy("tender_id").agg(F.max_by("tail_hash", "_last").alias("tail_hash")) if len(parts) > 1 else whole.drop("_last")

        tails = latest(before).join(batch.select("tender_id").distinct(), "tender_id", "left_semi") if before else None
        ledger.append_events(batch, tails).write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch_id}")
        moved = ledger.ledger_tails(spark.read.parquet(f"{folder}/ledger/batch={batch_id}"))
        latest([run for run in before if run[0] >= after[-1][0]], moved).write.mode("overwrite").parquet(path(after[-1]))

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_stream(evidence: DataFrame, criteria: DataFrame, thresholds: tuple[Column, Column]) -> DataFrame:
    """Judge and route arriving evidence by a pair of thresholds; row-local apart from the criteria lookup."""
    rows = evidence.join(criteria, "criterion_id").withColumn("_v", evaluate.evaluate_by_type())
    rows = rows.drop("evaluation_method").select("*", "_v.*")
    route = evaluate.compute_route(
        F.col("verdict"), F.col("confidence"), F.col("criterion_type"), evaluate.case_flags(), F.col("is_mandatory"), thresholds
    )
    rows = rows.withColumn("_r", route).select("*", "_r.*").drop("_r", "_v")
    return rows.withColumn("status", evaluate.status_from_route(F.col("route")))
