"""Read-side projections: listings, filters, details, summaries of ledger events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clauses import event_progress


def evaluations_view(
    evaluations: DataFrame, bidders: DataFrame, criteria: DataFrame, *, tender=None, bidder=None, status=None, route=None
) -> DataFrame:
    """Evaluations with bidder and criterion names, filtered by equality."""
    rows = evaluations
    for column, value in (("tender_id", tender), ("bidder_id", bidder), ("status", status), ("route", route)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.join(bidders.select("bidder_id", "company_name"), "bidder_id")
    return rows.join(criteria.select("criterion_id", "criterion_text", "criterion_type"), "criterion_id")


def audit_trail(ledger: DataFrame, event_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ledger rows by type and inclusive ISO range; data that is not JSON stays text."""
    rows = ledger
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    if start is not None:
        rows = rows.where(F.col("ts_text") >= start)
    if end is not None:
        rows = rows.where(F.col("ts_text") <= end)
    parsed = F.try_parse_json("event_data")
    return rows.withColumn("is_json", parsed.isNotNull()).withColumn(
        "event_data", F.coalesce(F.to_json(parsed), F.col("event_data"))
    )


def tender_detail(tenders: DataFrame, documents: DataFrame, bidders: DataFrame) -> DataFrame:
    """Tender header with its documents and bidders, one row per child (long form)."""
    docs = documents.select("tender_id", F.lit("document").alias("child_kind"), F.col("document_id").cast("string").alias("child_id"), F.col("doc_type").alias("child_label"))
    bids = bidders.select("tender_id", F.lit("bidder").alias("child_kind"), F.col("bidder_id").cast("string").alias("child_id"), F.col("company_name").alias("child_label"))
    return tenders.join(docs.unionByName(bids), "tender_id", "left")


def summarise_event(data: Column) -> Column:
    """Key facts of an event in one line; other data is cut to 100 characters."""
    field = lambda k: F.get_json_object(data, f"$.{k}")
    short = lambda k, label: F.concat(F.lit(f"{label}="), F.substring(field(k), 1, 8), F.lit("..."))
    full = lambda k, label: F.concat(F.lit(f"{label}="), field(k))
    line = F.concat_ws(
        "; ",
        short("bidder_id", "bidder"), short("criterion_id", "criterion"), full("verdict", "verdict"), full("decision", "decision"),
        full("officer_id", "officer"), full("is_debarred", "debarred"), short("report_id", "report"),
    )
    return F.when(F.length(line) > 0, line).otherwise(F.substring(data, 1, 100))


def poll_status(tenders: DataFrame) -> DataFrame:
    return tenders.select("tender_id", "status", event_progress(F.col("status")).alias("progress_pct"), F.col("status").alias("current_step"))


def page_words(words: DataFrame, page: Column | None = None) -> DataFrame:
    """Words with a box struct; the reading order is (y, x)."""
    rows = words if page is None else words.where(page)
    order = W.partitionBy("page_id").orderBy("y_min", "x_min", "word_no")
    box = F.struct("x_min", "y_min", "x_max", "y_max")
    return rows.withColumn("reading_order", F.row_number().over(order)).withColumn("bbox", box).drop("x_min", "y_min", "x_max", "y_max")


def first_nit(documents: DataFrame) -> DataFrame:
    """The earliest tender notice of every tender (a partial aggregate, no window)."""
    nits = documents.where(F.col("doc_type") == "nit")
    return nits.groupBy("tender_ref").agg(F.min(F.struct("uploaded_at", "upload_id")).alias("_m")).select(
        "tender_ref", F.col("_m.upload_id").alias("upload_id"), F.col("_m.uploaded_at").alias("uploaded_at")
    )


def evaluation_detail(evaluations: DataFrame) -> DataFrame:
    """Wide row with the box parsed and the stored value opened."""
    box = F.from_json("source_bbox", "x bigint, y bigint")
    return evaluations.withColumn("bbox_x", box["x"]).withColumn("bbox_y", box["y"]).drop("source_bbox")
