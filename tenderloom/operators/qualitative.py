"""Wording criteria: how near a bid and the precedents come to them, recorded answers, and both branches together.

The first branch compares vectors: a criterion with all chunks of a bidder, of which the nearest counts, and with the
precedents of its scope. The second reads the answer that a response log holds for the prompt of
a case. A case without vectors has similarity 0, one without an answer keeps the first branch alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import two
from .branches import prompt_hash, qualitative_union, repair_json, replay_responses
from .retrieve import cosine_top_k, semantic_verdict

PROMPT_TYPE = "qualitative_evaluation"
_ANSWER = "struct<verdict:string,confidence:double,reasoning:string,factors:array<string>,key_quote:string,precedent_alignment:string>"


def document_similarity(cases: DataFrame, criteria: DataFrame, chunks: DataFrame, block: int = 1024) -> DataFrame:
    """The greatest similarity of each case's criterion to a chunk of its bidder, as document_similarity.

    ``cases`` are (tender_id, bidder_id, criterion_id), ``criteria`` (criterion_id, embedding), ``chunks`` (bidder_id,
    chunk_no, embedding); vectors have length one. Criteria and chunks of a tender are cut into blocks, whatever the size of
    a tender or a bidder; a task multiplies two blocks and returns one number for each bidder and criterion in them.
    """
    wanted = cases.select("tender_id", "criterion_id").distinct().join(criteria.select("criterion_id", "embedding"), "criterion_id")
    offered = cases.select("tender_id", "bidder_id").distinct().join(chunks.select("bidder_id", "chunk_no", "embedding"), "bidder_id")

    def cut(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        counts = rows.groupBy("tender_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias(f"{name}s"))
        return rows.join(counts, "tender_id").withColumn(name, F.pmod(F.xxhash64(*keys), F.col(f"{name}s")))

    def met(rows: DataFrame, others: DataFrame, count: str, name: str) -> DataFrame:
        numbers = others.select("tender_id", count).distinct()
        return rows.join(numbers, "tender_id").withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))).drop(count)

    c, o = cut(wanted, "cb", "criterion_id"), cut(offered, "ob", "bidder_id", "chunk_no")
    left, right = met(c, o, "obs", "ob").drop("cbs"), met(o, c, "cbs", "cb").drop("obs")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"bidder_id": [], "criterion_id": [], "similarity": []})
        b = b.sort_values("bidder_id")
        products = np.stack(b["embedding"].to_numpy()).astype(np.float64) @ np.stack(a["embedding"].to_numpy()).astype(np.float64).T
        bidders, starts = np.unique(b["bidder_id"].to_numpy(), return_index=True)
        best = np.round(np.maximum.reduceat(products, starts, axis=0), 6)
        names = a["criterion_id"].to_numpy()
        return pd.DataFrame({"bidder_id": np.repeat(bidders, len(names)), "criterion_id": np.tile(names, len(bidders)), "similarity": best.ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in cases.schema}
    keys = ["tender_id", "cb", "ob"]
    right = right.select(*[F.col(k).alias(f"other_{k}") for k in keys], "bidder_id", "embedding")  # both come from the cases
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"other_{k}" for k in keys])).applyInPandas(nearest, f"bidder_id {kinds['bidder_id']}, criterion_id {kinds['criterion_id']}, similarity double")
    best = found.groupBy("bidder_id", "criterion_id").agg(F.max("similarity").alias("document_similarity"))
    return cases.join(best, ["bidder_id", "criterion_id"], "left").na.fill(0.0, ["document_similarity"])


def semantic_branch(cases: DataFrame, criteria: DataFrame, chunks: DataFrame, precedents: DataFrame) -> DataFrame:
    """Cases with rules_verdict, rules_confidence and rules_factors.

    ``criteria`` has criterion_id, scope and embedding, ``precedents`` precedent_id, scope and embedding.
    """
    rows = document_similarity(cases, criteria, chunks)
    queries = criteria.join(cases.select("criterion_id").distinct(), "criterion_id").select(F.col("criterion_id").alias("query_id"), "scope", "embedding")
    top = cosine_top_k(queries, precedents, k=1).select(F.col("query_id").alias("criterion_id"), "precedent_id", F.col("similarity").alias("precedent_similarity"))
    rows = rows.join(top, "criterion_id", "left").na.fill(0.0, ["precedent_similarity"])
    verdict, confidence = semantic_verdict(F.col("document_similarity"), F.col("precedent_similarity"))
    factors = F.array_compact(
        F.array(
            F.concat(F.lit("criterion↔document similarity: "), two(F.col("document_similarity"))),
            F.concat(F.lit("best precedent similarity: "), two(F.col("precedent_similarity"))),
            F.concat(F.lit("top precedent: "), F.col("precedent_id").cast("string")),
        )
    )
    return rows.withColumns({"rules_verdict": verdict, "rules_confidence": confidence, "rules_factors": factors})


def prompt_of(criterion_text: Column, company_name: Column, bidder_id: Column) -> Column:
    """What a model is asked about a case; bids of one company are told apart by their id."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("Criterion: "), text(criterion_text), F.lit(" Bidder: "), text(company_name), F.lit(" Bid: "), text(bidder_id))


def answered(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Cases (with bidder_id, criterion_text and company_name) and the last answer that the log holds for their prompt.

    Adds model_verdict, model_confidence, model_reasoning, model_factors, key_quote and precedent_alignment; all null
    without an entry, or where the response holds no JSON object with a verdict.
    """
    asked = cases.withColumn("prompt_hash", prompt_hash(F.lit(PROMPT_TYPE), prompt_of(F.col("criterion_text"), F.col("company_name"), F.col("bidder_id"))))
    rows = replay_responses(asked, log).withColumn("_a", F.from_json(repair_json(F.col("response")), _ANSWER))
    valid = F.col("_a.verdict").isin("PASS", "FAIL", "REVIEW")
    part = lambda name: F.when(valid, F.col(f"_a.{name}"))
    return rows.withColumns(
        {
            "model_verdict": part("verdict"), "model_confidence": part("confidence"), "model_reasoning": part("reasoning"), "model_factors": part("factors"),
            "key_quote": part("key_quote"), "precedent_alignment": F.coalesce(part("precedent_alignment"), F.lit("unknown")),
        }
    ).drop("_a", "response", "cache_hit", "prompt_hash", "model_version")


def assess(cases: DataFrame, criteria: DataFrame, chunks: DataFrame, precedents: DataFrame, log: DataFrame) -> DataFrame:
    """Both branches of every wording case and their consensus, with the factors of both, the model's first."""
    branch = semantic_branch(cases.select("tender_id", "bidder_id", "criterion_id", "criterion_text", "company_name"), criteria, chunks, precedents)
    rows = answered(branch, log).withColumn("top_factor", F.col("rules_factors")[0])
    none = F.array().cast("array<string>")
    return qualitative_union(rows).withColumn("factors", F.concat(F.coalesce("model_factors", none), F.coalesce("rules_factors", none)))


def log_at(log: DataFrame, version: int) -> DataFrame:
    """A response log as it stood at a version: entries are only ever added."""
    return log.where(F.col("version") <= version)
