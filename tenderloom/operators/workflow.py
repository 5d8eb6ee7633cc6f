"""Tender workflow: legal transitions, guards, replay, derived states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.files import kept
from .report import PENDING


def _edges() -> Column:
    return F.array(*[F.lit(f"{a}>{b}") for a, b in P.TRANSITIONS])


def is_legal(current: Column, target: Column) -> Column:
    return F.array_contains(_edges(), F.concat_ws(">", current, target))


def tender_facts(documents: DataFrame, bidders: DataFrame, criteria: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row of counts per tender, from one partial aggregate per table."""
    one = F.count(F.lit(1))
    parts = [
        documents.groupBy("tender_id").agg(one.alias("documents"), F.count_if(F.col("processing_status") != "complete").alias("unprocessed")),
        bidders.groupBy("tender_id").agg(F.count_if(F.col("debarment_status") == "flagged").alias("flagged"), F.count_if(F.col("status") != "excluded").alias("bidders")),
        criteria.groupBy("tender_id").agg(F.count_if(F.col("status") == "approved").alias("approved")),
        evaluations.groupBy("tender_id").agg(one.alias("evaluations"), F.count_if(F.col("status").isin(*PENDING)).alias("pending")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "tender_id", "full")
    return out.na.fill(0)


def guard_reason(current: Column, target: Column) -> Column:
    """Why a legal transition must wait; null when its guard passes."""
    edge = F.concat_ws(">", current, target)
    n = lambda c: F.col(c).cast("string")
    expected = F.col("bidders") * F.col("approved")
    return (
        F.when((edge == "DOCUMENTS_UPLOADED>PROCESSING_OCR") & (F.col("documents") == 0), F.lit("At least one document must be uploaded before processing"))
        .when((edge == "PROCESSING_OCR>OCR_COMPLETE") & (F.col("unprocessed") > 0), F.concat(n("unprocessed"), F.lit(" document(s) still processing")))
        .when((edge == "DEBARMENT_CHECK>EVALUATING") & (F.col("flagged") > 0), F.concat(n("flagged"), F.lit(" bidder(s) flagged for debarment — must resolve first")))
        .when(
            (edge == "EVALUATING>VERDICTS_COMPUTED") & (F.col("evaluations") < expected),
            F.concat(F.lit("Only "), n("evaluations"), F.lit("/"), expected.cast("string"), F.lit(" evaluations completed")),
        )
        .when((edge == "VERDICTS_COMPUTED>HITL_PENDING") & (F.col("pending") == 0), F.lit("No cases pending HITL review"))
        .when((edge == "HITL_PENDING>EVALUATION_COMPLETE") & (F.col("pending") > 0), F.concat(n("pending"), F.lit(" case(s) still pending officer review")))
    )


def validate_transitions(tenders: DataFrame, requests: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Each request with its code: unknown tender, illegal step, guard failed, or null."""
    rows = requests.join(tenders.select("tender_id", "status"), "tender_id", "left")
    code = F.when(F.col("status").isNull(), "TENDER_NOT_FOUND").when(~is_legal(F.col("status"), F.col("target_status")), "INVALID_TRANSITION")
    if facts is None:
        return rows.withColumn("code", code).withColumn("new_status", F.when(F.col("code").isNull(), F.col("target_status")))
    counts = [c for c in facts.columns if c != "tender_id"]
    rows = rows.join(facts, "tender_id", "left").na.fill(0, counts)
    rows = rows.withColumn("guard", guard_reason(F.col("status"), F.col("target_status")))
    rows = rows.withColumn("code", code.when(F.col("guard").isNotNull(), "GUARD_FAILED"))
    rows = rows.withColumn("guard", F.when(F.col("code") == "GUARD_FAILED", F.col("guard")))
    return rows.withColumn("new_status", F.when(F.col("code").isNull(), F.col("target_status"))).drop(*counts)


def status_after_evaluation(evaluations: DataFrame) -> DataFrame:
    pending = F.count_if(F.col("status").isin(*PENDING))
    return evaluations.groupBy("tender_id").agg(
        pending.alias("pending"), F.when(pending > 0, "HITL_PENDING").otherwise("EVALUATION_COMPLETE").alias("new_status")
    )


def status_after_processing(tenders: DataFrame, criteria: DataFrame) -> DataFrame:
    counts = criteria.groupBy("tender_id").agg(F.count(F.lit(1)).alias("criteria_count"))
    out = tenders.select("tender_id").join(counts, "tender_id", "left").na.fill(0, ["criteria_count"])
    return out.withColumn("new_status", F.when(F.col("criteria_count") > 0, "SCHEMA_PENDING_REVIEW").otherwise("OCR_COMPLETE"))


def replay_status(tenders: DataFrame, requests: DataFrame, chunks: int | None = None) -> DataFrame:
    """State of the tender after each of its requests, in request order.

    A request maps every state to the one it leaves behind, and such maps compose. Rows are cut into ranges of
    (tender, date, id), so a tender with most requests fills many chunks; the composed maps of its chunks, one
    row each, give the state that every chunk starts from, and chunks are then replayed side by side. ``chunks``
    is the number of ranges; without it Spark chooses. A status outside the known states allows nothing and stays.
    """
    rows = requests.join(tenders.select("tender_id", "status"), "tender_id")
    rows = rows.select("tender_id", "request_id", "requested_on", "target_status", "status")
    order = ["tender_id", "requested_on", "request_id"]
    ranges = rows.repartitionByRange(*([chunks] if chunks else []), *order)
    rows = kept(ranges.withColumn("chunk", F.spark_partition_id()), "requests")
    sorted_rows = lambda d: d.repartition("tender_id", "chunk").sortWithinPartitions("tender_id", "chunk", "requested_on", "request_id")

    steps, legal, code = _steps()
    known = F.create_map(*[F.lit(x) for pair in code.items() for x in pair])
    coded = rows.withColumn("target", F.coalesce(F.try_element_at(known, "target_status"), F.lit(len(code))))
    kind = dict(rows.dtypes)["tender_id"]

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, whole = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            first = _starts(pdf, key)
            maps = steps[pdf["target"].to_numpy()]
            if not first[0]:
                maps[0] = maps[0][whole]
            maps = _running(maps, first)
            ends = np.flatnonzero(first[1:])
            if first[0] and key is not None:
                yield pd.DataFrame({"tender_id": [key[0]], "chunk": [key[1]], "to": [whole.tolist()]})
            yield pd.DataFrame({"tender_id": pdf["tender_id"].to_numpy()[ends], "chunk": pdf["chunk"].to_numpy()[ends], "to": pd.Series(list(maps[ends]), dtype=object)})
            key, whole = (pdf["tender_id"].iloc[-1], pdf["chunk"].iloc[-1]), maps[-1]
        if key is not None:
            yield pd.DataFrame({"tender_id": [key[0]], "chunk": [key[1]], "to": [whole.tolist()]})

    heads = sorted_rows(coded.select(*order, "chunk", "target")).mapInPandas(composed, f"tender_id {kind}, chunk int, to array<bigint>")
    begin = F.coalesce(F.try_element_at(known, "status"), F.lit(len(code))).cast("bigint")
    # One head per chunk at most: a list no longer than the number of ranges.
    lists = heads.groupBy("tender_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "to"))).alias("heads"))
    lists = lists.join(tenders.select("tender_id", begin.alias("begin")), "tender_id")
    states = F.aggregate("heads", F.array("begin"), lambda acc, x: F.concat(acc, F.array(F.get(x["to"], F.element_at(acc, -1).cast("int")))))
    entries = lists.select("tender_id", F.posexplode("heads.chunk").alias("n", "chunk"), states.alias("states"))
    entries = entries.select("tender_id", "chunk", F.get("states", F.col("n")).alias("entry"))

    names = np.array([*code, None], dtype=object)

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            target, before = pdf["target"].to_numpy(), pdf["entry"].to_numpy(copy=True)
            continues = not _starts(pdf, key)[0]
            if continues:
                before[0] = state
            first = _starts(pdf, None)
            maps = steps[target]
            # From a known state a map is constant.
            maps[first] = np.take_along_axis(maps[first], before[first, None], 1)
            after = _running(maps, first)[:, 0]
            inner = np.flatnonzero(~first)
            before[inner] = after[inner - 1]
            text = np.where(after == len(code), pdf["status"].to_numpy(object), names[after])
            yield pdf[["tender_id", "request_id", "target_status"]].assign(accepted=legal[before, target], state_after=text)
            key, state = (pdf["tender_id"].iloc[-1], pdf["chunk"].iloc[-1]), after[-1]

    schema = f"tender_id {kind}, request_id {dict(rows.dtypes)['request_id']}, target_status string, accepted boolean, state_after string"
    return sorted_rows(coded.join(entries, ["tender_id", "chunk"])).mapInPandas(replayed, schema)


def _steps() -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """For a target the state that each state goes to, whether a step is legal, and the numbers of states; one number more is any other text."""
    code = {state: i for i, state in enumerate(P.STATES)}
    steps = np.tile(np.arange(len(code) + 1), (len(code) + 1, 1))
    legal = np.zeros(steps.shape, bool)
    for a, b in P.TRANSITIONS:
        steps[code[b], code[a]] = code[b]
        legal[code[a], code[b]] = True
    return steps, legal, code


def _starts(pdf: pd.DataFrame, before: tuple | None) -> np.ndarray:
    """Where a chunk of a tender begins; ``before`` is the key of the row above."""
    tender, chunk = pdf["tender_id"].to_numpy(), pdf["chunk"].to_numpy()
    above = before is not None and (tender[0], chunk[0]) == before
    return np.concatenate([[not above], (tender[1:] != tender[:-1]) | (chunk[1:] != chunk[:-1])])


def _running(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composition of maps from the start of each stretch to every row, in a logarithmic number of rounds."""
    width = 1
    while width < len(maps):
        both = np.take_along_axis(maps[width:], maps[:-width], 1)
        maps = np.concatenate([maps[:width], np.where(first[width:, None], maps[width:], both)])
        first = np.concatenate([first[:width], first[width:] | first[:-width]])
        width *= 2
    return maps
