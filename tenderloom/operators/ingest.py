"""Documents, pages and words: intake checks, de-duplication, text assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.common import plain_spaces, strip


def ingest_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the SHA-256 of the content of every file."""
    return files.withColumn("sha256_hash", F.sha2(F.col(content), 256)).drop(content)


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None, tender: str = "tender_id") -> DataFrame:
    """One row per (tender, content): the earliest new upload unless the content is stored already.

    The earliest row is a partial aggregate over the metadata, so a content repeated
    a billion times shrinks before the shuffle.
    """
    keys = [tender, "sha256_hash"]
    rest = [c for c in new.columns if c not in keys]
    order = ["uploaded_at", "upload_id"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    kept = new.groupBy(*keys).agg(first).select(*keys, "_first.*")
    return kept if existing is None else kept.join(existing.select(*keys), keys, "left_anti")


def extension(filename: Column) -> Column:
    return F.regexp_extract(F.lower(filename), r"\.([a-z0-9]+)$", 1)


def validate_upload(uploads: DataFrame) -> DataFrame:
    """Add the refusal code of an upload, null when it is accepted."""
    code = F.when(~extension(F.col("filename")).isin(*P.ACCEPTED_EXTENSIONS), "INVALID_FILE_TYPE").when(
        ~F.col("doc_type").isin(*P.DOC_TYPES), "INVALID_DOC_TYPE"
    )
    return uploads.withColumn("code", code)


def detect_format(filename: Column) -> Column:
    ext = extension(filename)
    return (
        F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin(*P.IMAGE_EXTENSIONS), "image").otherwise("unknown")
    )


def classify_scanned(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Scanned when the pages of a document average fewer than 50 characters of text."""
    chars = F.sum(F.length(strip(F.coalesce("embedded_text", F.lit("")))))
    stats = pages.groupBy("document_id").agg((chars / F.count(F.lit(1))).alias("avg_chars"))
    if documents is not None:
        stats = documents.select("document_id").join(stats, "document_id", "left").na.fill(0.0, ["avg_chars"])
    return stats.withColumn("is_scanned", F.col("avg_chars") < P.SCANNED_CHARS_PER_PAGE)


def clean_ocr_rows(rows: DataFrame) -> DataFrame:
    """OCR engine rows as words: no blanks, no layout rows, boxes instead of sizes."""
    text = strip(F.col("text"))
    return rows.where((F.length(text) > 0) & (F.col("conf") >= 0)).select(
        "page_id", "word_no", text.alias("text_content"),
        F.col("left_px").alias("x_min"), F.col("top_px").alias("y_min"),
        (F.col("left_px") + F.col("width_px")).alias("x_max"), (F.col("top_px") + F.col("height_px")).alias("y_max"),
        F.round(F.col("conf") / 100, 4).alias("confidence"),
    )


def page_confidence(words: DataFrame) -> DataFrame:
    """Length-weighted mean confidence per page, 0 when no character was read."""
    n = F.length("text_content")
    total = F.sum(n)
    return words.groupBy("page_id").agg(
        F.when(total > 0, F.sum(n * F.col("confidence")) / total).otherwise(0.0).alias("page_confidence")
    )


def page_text(words: DataFrame) -> DataFrame:
    """Words of a page joined in order (a page is one sheet, so the list is bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text_content")))
    return words.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda w: w["text_content"]), " ").alias("ocr_text"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def choose_page_text(pages: DataFrame, scanned: DataFrame, words: DataFrame) -> DataFrame:
    """Embedded text for word-processor and digital pages, OCR text otherwise."""
    read = page_text(words).join(page_confidence(words), "page_id")
    rows = pages.join(scanned.select("document_id", "is_scanned"), "document_id", "left").join(read, "page_id", "left")
    digital = (F.length(strip(F.coalesce("embedded_text", F.lit("")))) > 0) & ~F.coalesce("is_scanned", F.lit(True)) & (F.col("doc_format") == "pdf")
    embedded = (F.col("doc_format") == "docx") | digital
    return rows.select(
        "page_id", "document_id", "page_number", "doc_format",
        F.when(embedded, F.col("embedded_text")).otherwise(F.coalesce("ocr_text", F.lit(""))).alias("raw_text"),
        F.when(embedded, F.lit(0.95)).otherwise(F.coalesce("page_confidence", F.lit(0.0))).alias("page_confidence"),
    )


def is_degraded(confidence: Column) -> Column:
    return confidence < P.DEGRADED_BELOW


def document_rollup(pages: DataFrame) -> DataFrame:
    """Mean page confidence, page count, degraded page numbers and status per document."""
    degraded = F.when(is_degraded(F.col("page_confidence")), F.col("page_number"))
    return pages.groupBy("document_id").agg(
        F.avg("page_confidence").alias("avg_ocr_confidence"),
        F.count(F.lit(1)).alias("page_count"),
        F.array_sort(F.collect_list(degraded)).alias("degraded_pages"),
        F.lit("complete").alias("processing_status"),
    )


_LAYOUT = "page_id string, word_no int, text_content string, x_min double, y_min double, x_max double, y_max double, confidence double"


def layout_words(pages: DataFrame) -> DataFrame:
    """Words of embedded text on a fixed grid of lines (left 50, right 2430, 20 per line).

    Line breaks depend on everything before them in the page, so each page is laid out
    in one pass; pages are independent and nothing is shuffled.
    """

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, held = [], 0
        for pdf in batches:
            for page_id, text in zip(pdf["page_id"].tolist(), pdf["raw_text"].tolist()):
                tokens = (text or "").split()
                if not tokens:
                    continue
                widths = np.array([len(t) for t in tokens], dtype=float) * 8.0
                ends = np.cumsum(widths + 10.0)  # running x without breaks
                x, y = np.empty(len(tokens)), np.empty(len(tokens))
                start, line = 0, 50.0
                while start < len(tokens):
                    base = ends[start - 1] if start else 0.0
                    # A word stays while its right edge fits; an over-long word has a line of its own.
                    fits = int(np.searchsorted(ends - 10.0, 2430.0 - 50.0 + base, side="right"))
                    fits = max(fits, start + 1)
                    x[start:fits] = 50.0 + (ends[start:fits] - widths[start:fits] - 10.0) - base
                    y[start:fits] = line
                    start, line = fits, line + 20.0
                if 50.0 + widths[0] > 2430.0:  # the first word breaks at once when it is too wide
                    y += 20.0
                frames.append(
                    pd.DataFrame(
                        {
                            "page_id": page_id, "word_no": np.arange(len(tokens), dtype=np.int32), "text_content": tokens,
                            "x_min": x.round(1), "y_min": y, "x_max": (x + widths).round(1), "y_max": y + 14.0, "confidence": 0.95,
                        }
                    )
                )
                held += len(tokens)
                if held >= 50_000:
                    yield pd.concat(frames)
                    frames, held = [], 0
        if frames:
            yield pd.concat(frames)

    return pages.select("page_id", "raw_text").mapInPandas(lay_out, _LAYOUT)


def assemble_text(pages: DataFrame, *keys: str) -> DataFrame:
    """Non-empty page texts of a file joined by line breaks, with the mean page confidence.

    The key is the file: pages of one file fit one value.  Bidders and tenders may own
    any number of files, so their evidence is reduced over files, never concatenated.
    No-break and other Unicode spaces become blanks, which the patterns read.
    """
    entry = F.when(F.length("raw_text") > 0, F.struct("page_number", "raw_text"))
    texts = F.sort_array(F.collect_list(entry))["raw_text"]
    return pages.groupBy(*keys).agg(
        plain_spaces(F.array_join(texts, "\n")).alias("text"),
        F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.sum("ocr_confidence"), F.lit(0.0)).alias("confidence_sum"),
        F.count("ocr_confidence").alias("confidence_pages"),
        F.max("uploaded_at").alias("uploaded_at") if "uploaded_at" in pages.columns else F.lit("").alias("uploaded_at"),
    )


def flatten_table_row(cells: Column) -> Column:
    """Tab-joined cells with line breaks as blanks; null when every cell is empty."""
    clean = F.transform(cells, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    return F.when(F.exists(clean, lambda c: F.length(c) > 0), F.array_join(clean, "\t"))


def insert_if_absent(seed: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key the target does not hold."""
    return seed.join(target.select(key), key, "left_anti")


def register_rows(batch: DataFrame, tenders: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """New rows with default states; rows of unknown tenders carry a code."""
    known = tenders.select("tender_id", F.lit(True).alias("_known")).distinct()
    rows = batch.join(known, "tender_id", "left")
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.lit(value))
    return rows.withColumn("code", F.when(F.col("_known").isNull(), "TENDER_NOT_FOUND")).drop("_known")


def reprocess_documents(documents: DataFrame) -> DataFrame:
    """Unfinished documents, oldest first; unreadable ones become error rows."""
    open_docs = documents.where(F.col("processing_status").isin("pending", "processing"))
    fmt = detect_format(F.col("filename"))
    return (
        open_docs.withColumn("doc_format", fmt)
        .withColumn("processing_status", F.when(F.col("doc_format") == "unknown", "error").otherwise("complete"))
        .withColumn("fatal", (F.col("processing_status") == "error") & (F.col("doc_type") != "corrigendum"))
    )
