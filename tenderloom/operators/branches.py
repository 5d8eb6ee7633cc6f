"""Cross validation of two branches: rules and recorded model responses."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import patterns as P
from ..functions.common import json_object, json_string, let, two


def rules_confidence(n: Column, has_clause_ref: Column) -> Column:
    base = 0.5 + F.least(0.08 * n, F.lit(0.4))
    return F.when(n == 0, 0.3).otherwise(F.round(F.when(has_clause_ref, F.least(F.lit(1.0), base + 0.05)).otherwise(base), 3))


def model_confidence(n: Column, failed: Column) -> Column:
    return F.when(failed, 0.0).when(n == 0, 0.3).otherwise(F.round(0.6 + F.least(0.05 * n, F.lit(0.3)), 3))


def consensus_confidence(rules: Column, model: Column, agreement: Column) -> Column:
    """Agreement lifts the geometric mean, disagreement lowers the minimum."""
    return (
        F.when(model == 0, rules)
        .when(rules == 0, model * 0.8)
        .when(agreement == "agree", F.round(F.least(F.lit(1.0), F.sqrt(rules * model) + 0.1), 3))
        .when(agreement == "disagree", F.round(F.least(rules, model) * 0.7, 3))
        .otherwise(F.round((rules + model) / 2, 3))
    )


def agreement_label(rules_n: Column, model_n: Column, agreements: Column) -> tuple[Column, Column]:
    """(label, score) of a merge from the number of items of both sides and of matches."""
    total = rules_n + model_n - agreements
    score = F.when((rules_n == 0) & (model_n == 0), 0.0).when((rules_n == 0) | (model_n == 0), 0.5).otherwise(agreements / total)
    label = (
        F.when((rules_n == 0) & (model_n == 0), "neither").when(model_n == 0, "rules_only").when(rules_n == 0, "llm_only")
        .when(score >= 0.6, "agree").when(score < 0.3, "disagree").otherwise("partial")
    )
    return label, score


def verdict_agreement(rules: Column, model: Column) -> tuple[Column, Column]:
    soft = (rules == "REVIEW") | (model == "REVIEW")
    label = F.when(rules == model, "agree").when(soft, "partial").otherwise("disagree")
    return label, F.when(rules == model, 1.0).when(soft, 0.5).otherwise(0.0)


def consensus_verdict(rules: Column, model: Column) -> Column:
    return (
        F.when((rules == "FAIL") | (model == "FAIL"), "REVIEW").when((rules == "PASS") & (model == "PASS"), "PASS")
        .when(rules == model, model).otherwise("REVIEW")
    )


# --- recorded model responses -----------------------------------------------------------


def latest_responses(log: DataFrame) -> DataFrame:
    """The last logged response of every prompt (a partial aggregate per prompt)."""
    return log.groupBy("prompt_hash").agg(
        F.max_by("response", "logged_at").alias("response"), F.max_by("model_version", "logged_at").alias("model_version")
    )


def replay_responses(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts with the recorded response, and whether there was one."""
    return prompts.join(latest_responses(log), "prompt_hash", "left").withColumn("cache_hit", F.col("response").isNotNull())


def prompt_hash(prompt_type: Column, text: Column) -> Column:
    """SHA-256 of the canonical request."""
    return F.sha2(json_object({"prompt_type": json_string(prompt_type), "text": json_string(text)}), 256)


def repair_json(text: Column) -> Column:
    """JSON of a response: fenced, bare, or the outermost object or array in other text."""
    fenced = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.when(F.length(fenced) > 0, fenced).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))

    def parse(t: Column) -> Column:
        cut = lambda p: F.regexp_extract(t, p, 0)
        as_json = lambda x: F.to_json(F.try_parse_json(x))
        return F.coalesce(as_json(t), as_json(F.nullif(cut(r"(?s)\{.*\}"), F.lit(""))), as_json(F.nullif(cut(r"(?s)\[.*\]"), F.lit(""))))

    return let(bare, parse)


_MODEL_CRITERION = (
    "criterion_text string, criterion_type string, gfr_override_permitted boolean, gfr_rule_number string, is_mandatory boolean, "
    "source_clause_ref string, measurement_period string, needs_review boolean, review_reason string, threshold_value struct<value:double,unit:string,rupees:bigint>"
)


def normalise_model_criterion(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Model output rows with types and defaults; rows without text are dropped."""
    c = F.from_json(column, _MODEL_CRITERION)
    rows = raw.withColumn("_c", c).where(F.length("_c.criterion_text") > 0)
    return rows.select(
        *[n for n in raw.columns if n != column],
        F.trim("_c.criterion_text").alias("criterion_text"),
        F.coalesce("_c.criterion_type", F.lit("qualitative_assessment")).alias("criterion_type"),
        F.coalesce("_c.gfr_override_permitted", F.lit(True)).alias("gfr_override_permitted"),
        F.coalesce("_c.is_mandatory", F.lit(False)).alias("is_mandatory"),
        F.coalesce("_c.source_clause_ref", F.lit("")).alias("source_clause_ref"),
        F.col("_c.threshold_value.rupees").alias("threshold_rupees"),
        F.coalesce("_c.needs_review", F.lit(False)).alias("needs_review"),
    )


def response_log_rows(responses: DataFrame, prompt_type: str, model_version: str, logged_at: str) -> DataFrame:
    """Rows to append to the response log."""
    request = json_object({"prompt_type": json_string(F.lit(prompt_type)), "text": json_string(F.col("prompt"))})
    return responses.select(
        "tender_id", F.lit(prompt_type).alias("prompt_type"), F.sha2(request, 256).alias("prompt_hash"), request.alias("prompt_content"),
        "response", F.lit(model_version).alias("model_version"), F.lit(logged_at).alias("logged_at"),
    )


# --- merging criteria of both branches --------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


#: Products of whole blocks round otherwise than sums term by term; pairs so near to a bound are summed again.
_SLACK = 1e-9


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    longest = lambda x: np.sqrt(np.nan_to_num(np.square(x).sum(1), nan=0.0, posinf=0.0).max(initial=0.0))
    return float(_SLACK * (1 + longest(a) * longest(b)))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in the order of ``dot``."""
    total = np.zeros(max(len(a), len(b)))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows whose vector can be similar to another: not null and without nulls. Its width is _d."""
    whole = rows.where(F.col("document_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    return whole.select("document_id", "item_no", F.size("embedding").alias("_d"), "embedding")


def similar_pairs(rules: DataFrame, model: DataFrame, threshold: float = P.MERGE_SIMILARITY, block: int = 1024) -> DataFrame:
    """Rule and model items of the same document at or above the similarity threshold.

    Both sides of a document are cut into blocks of bounded size, whatever the size of the document; a task multiplies
    two blocks and returns the pairs that count.
    """

    def cut(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("document_id", "_d").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias(f"{name}s"))
        return rows.join(counts, ["document_id", "_d"]).withColumn(name, F.pmod(F.xxhash64("item_no", "embedding"), F.col(f"{name}s")))

    def met(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
        numbers = others.select("document_id", "_d", f"{name}s").distinct()
        return rows.join(numbers, ["document_id", "_d"]).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{name}s") - 1)))

    r, m = cut(_whole_vectors(rules), "rb"), cut(_whole_vectors(model), "mb")
    keys = ["document_id", "_d", "rb", "mb"]
    left = met(r.drop("rbs"), m, "mb").select(*keys, F.col("item_no").alias("rule_no"), F.col("embedding").alias("_r"))
    right = met(m.drop("mbs"), r, "rb").select(*[F.col(k).alias(f"other_{k}") for k in keys], F.col("item_no").alias("model_no"), F.col("embedding").alias("_m"))
    schema = T.StructType([left.schema["document_id"], left.schema["rule_no"], right.schema["model_no"], T.StructField("similarity", T.DoubleType())])

    def similar(one: pa.Table, other: pa.Table) -> pa.Table:
        names = {"document_id": one, "rule_no": one, "model_no": other}
        if not one.num_rows or not other.num_rows:
            return pa.table({**{n: pa.array([], t.schema.field(n).type) for n, t in names.items()}, "similarity": pa.array([], pa.float64())})
        width = one["_d"][0].as_py()
        a, b = _vectors(one["_r"].combine_chunks(), width), _vectors(other["_m"].combine_chunks(), width)
        i, j = np.nonzero(~(a @ b.T < threshold - _slack(a, b)))
        step = 1 << 14
        exact = np.concatenate([_dots(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]) if len(i) else np.zeros(0)
        keep = ~(exact < threshold)
        i, j = pa.array(i[keep]), pa.array(j[keep])
        return pa.table({"document_id": one["document_id"].take(i), "rule_no": one["rule_no"].take(i), "model_no": other["model_no"].take(j), "similarity": exact[keep]})

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"other_{k}" for k in keys])).applyInArrow(similar, schema)


class _Taking:
    """The model items of a document while its rule items, in order, each take the most similar that is free."""

    def __init__(self, document, threshold: float) -> None:
        self.document, self.threshold = document, threshold
        self.parts: list[tuple[pa.Array, np.ndarray]] = []
        self.numbers = self.rule = None
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple] = []

    def offer(self, numbers: pa.Array, vectors: list[np.ndarray]) -> None:
        self.parts.append((numbers, vectors))

    def _ready(self) -> None:
        numbers = [n for part, _ in self.parts for n in part.to_pylist()]
        vectors = [v for _, part in self.parts for v in part]
        self.numbers, self.taken = numbers, np.zeros(len(numbers), bool)
        self.without = sum(n is None for n in numbers)
        self.sorted = numbers[self.without :]
        self.by_width = {}
        for width in {len(v) for v in vectors}:
            at = np.array([k for k, v in enumerate(vectors) if len(v) == width])
            self.by_width[width] = (at, np.stack([vectors[k] for k in at]))
        self.parts = []

    def take(self, numbers: list, vectors: list[np.ndarray]) -> None:
        """Rule items that follow those before; equal numbers choose together, one without a number takes all it likes."""
        if self.numbers is None:
            self._ready()
        step = max(1, (1 << 22) // max(len(self.numbers), 1))
        for start in range(0, len(numbers), step):
            chosen = vectors[start : start + step]
            near = {}
            for width in {len(v) for v in chosen} & set(self.by_width):
                rows = [k for k, v in enumerate(chosen) if len(v) == width]
                a, b = np.stack([chosen[k] for k in rows]), self.by_width[width][1]
                products = a @ b.T
                products[np.isnan(products)] = np.inf
                near |= dict(zip(rows, zip(products, [_slack(a, b)] * len(rows), strict=True), strict=True))
            for k, vector in enumerate(chosen):
                if k not in near:
                    continue
                number = numbers[start + k]
                if number is None:
                    self.settle()
                    at, exact = self._exact(vector, *near[k], every=True)
                    for minus, at in sorted((-s, k) for k, s in zip(at.tolist(), exact.tolist(), strict=True) if not s < self.threshold):
                        if not self.taken[at]:
                            self._match(None, at, -minus)
                    continue
                if number != self.rule:
                    self.settle()
                    self.rule = number
                self.waiting.append((vector, *near[k]))

    def _exact(self, vector: np.ndarray, near: np.ndarray, slack: float, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Free model items that may be the most similar (or all above the threshold), and their similarity."""
        at, vectors = self.by_width[len(vector)]
        near = np.where(self.taken[at], -np.inf, near)
        least = self.threshold if every else max(near.max(initial=-np.inf) - slack, self.threshold)
        hit = np.flatnonzero(near >= least - slack)
        exact = _dots(vector[None, :], vectors[hit]) if len(hit) else np.zeros(0)
        return at[hit], np.where(np.isnan(exact), np.inf, exact)

    def _match(self, rule, k: int, similarity: float) -> None:
        """Item k is taken, with all rows of its number; one without a number stays free."""
        number = self.numbers[k]
        self.found.append((self.document, rule, number, similarity))
        if number is not None:
            self.taken[bisect_left(self.sorted, number) + self.without : bisect_right(self.sorted, number) + self.without] = True

    def settle(self) -> None:
        """The rule item that waits takes its model item."""
        options = [self._exact(*row) for row in self.waiting]
        best = [(-s, k) for at, exact in options for s, k in zip(exact.tolist(), at.tolist(), strict=True) if not s < self.threshold]
        if best:
            minus, k = min(best)
            self._match(self.rule, k, -minus)
        self.waiting, self.rule = [], None


def best_matches(rules: DataFrame, model: DataFrame, threshold: float = P.MERGE_SIMILARITY) -> DataFrame:
    """What ``greedy_matches`` finds among the similar pairs, without writing or sorting the pairs.

    The order of the rule items of a document is part of the result, so they pass one task in order, which holds the
    vectors of the document's model items; similarities are computed there for a few rule items at a time.
    """
    sides = [_whole_vectors(rows).withColumn("_rule", F.lit(is_rule)).withColumn("item_no", F.col("item_no").cast("bigint")).drop("_d") for is_rule, rows in ((False, model), (True, rules))]
    numbers = [T.StructField(c, T.LongType()) for c in ("rule_no", "model_no")]
    schema = T.StructType([sides[0].schema["document_id"], *numbers, T.StructField("similarity", T.DoubleType())])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(schema)]
        rows_of = lambda taking: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*taking.found, strict=True), kinds, strict=True)], schema.names)
        now = None
        for batch in batches:
            documents, is_rule = batch.column("document_id"), batch.column("_rule").to_numpy(zero_copy_only=False)
            names = documents.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (is_rule[1:] != is_rule[:-1])) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                document = documents[a].as_py()
                if now is None or now.document != document:
                    if now is not None:
                        now.settle()
                        if now.found:
                            yield rows_of(now)
                    now = _Taking(document, threshold)
                column = batch.column("embedding").slice(a, b - a)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
                vectors = np.split(flat, ends[:-1])
                items = batch.column("item_no").slice(a, b - a)
                if is_rule[a]:
                    now.take(items.to_pylist(), vectors)
                else:
                    now.offer(items, vectors)
        if now is not None:
            now.settle()
            if now.found:
                yield rows_of(now)

    both = sides[0].unionByName(sides[1])
    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "document_id").sortWithinPartitions("document_id", "_rule", "item_no")
    return ordered.select("document_id", "_rule", "item_no", "embedding").mapInArrow(matched, schema)


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches: rule items in order take the most similar free model item.

    Only pairs above the threshold arrive here and they arrive one by one in rule
    order; the fold remembers the taken model items of the current document.
    """
    numbers = [T.StructField(c, T.LongType()) for c in ("rule_no", "model_no")]
    schema = T.StructType([pairs.schema["document_id"], *numbers, T.StructField("similarity", T.DoubleType())])

    def fold(batches):
        import pandas as pd

        document, rule, taken = None, None, set()
        for pdf in batches:
            out = []
            for d, r, m, s in zip(pdf["document_id"].tolist(), pdf["rule_no"].tolist(), pdf["model_no"].tolist(), pdf["similarity"].tolist()):
                if d != document:
                    document, rule, taken = d, None, set()
                if r == rule or m in taken:
                    continue
                rule = r
                taken.add(m)
                out.append((d, r, m, s))
            if out:
                yield pd.DataFrame(out, columns=["document_id", "rule_no", "model_no", "similarity"])

    ordered = pairs.select(
        "document_id", F.col("rule_no").cast("bigint").alias("rule_no"),
        F.col("model_no").cast("bigint").alias("model_no"), "similarity",
    ).repartition("document_id").sortWithinPartitions("document_id", "rule_no", F.desc("similarity"), "model_no")
    return ordered.mapInPandas(fold, schema)


def merge_branches(rules: DataFrame, model: DataFrame, threshold: float = P.MERGE_SIMILARITY) -> DataFrame:
    """Criteria of both branches, one row each, matched rows once, with their sources.

    A matched row is the model's, except that the rules' rupee threshold and, when the
    model has none, the rules' clause reference are kept.
    """
    matches = best_matches(rules, model, threshold)
    r = rules.drop("embedding").withColumnRenamed("item_no", "rule_no").join(matches, ["document_id", "rule_no"], "left")
    m = model.drop("embedding").select("document_id", *[F.col(c).alias(f"m_{c}") for c in model.columns if c not in ("document_id", "embedding")])
    joined = r.join(m.withColumnRenamed("m_item_no", "model_no"), ["document_id", "model_no"], "full")
    both = F.col("rule_no").isNotNull() & F.col("model_no").isNotNull()
    ref = F.when(F.length("m_source_clause_ref") > 0, F.col("m_source_clause_ref")).otherwise(F.col("source_clause_ref"))
    return joined.select(
        "document_id", "rule_no", "model_no",
        F.coalesce("m_criterion_text", "criterion_text").alias("criterion_text"),
        F.coalesce("rupees", "m_rupees").alias("rupees"),
        ref.alias("source_clause_ref"),
        F.when(both, F.array(F.lit("rules"), F.lit("llm"))).when(F.col("rule_no").isNotNull(), F.array(F.lit("rules"))).otherwise(F.array(F.lit("llm"))).alias("sources"),
        F.when(both, F.col("similarity")).alias("agreement_similarity"),
    )


def criteria_union(documents: DataFrame, merged: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per document: counts, confidences, agreement, method and the reasoning line."""
    stats = merged.groupBy("document_id").agg(
        F.count("rule_no").alias("rules_n"), F.count("model_no").alias("model_n"),
        F.count_if(F.col("rule_no").isNotNull() & F.col("model_no").isNotNull()).alias("matched"),
        F.coalesce(F.max(F.col("rule_no").isNotNull() & (F.length("source_clause_ref") > 0)), F.lit(False)).alias("has_ref"),
    )
    rows = documents.select("document_id").join(stats, "document_id", "left").na.fill(0, ["rules_n", "model_n", "matched"]).na.fill(False, ["has_ref"])
    if failed is not None:
        rows = rows.join(failed.select("document_id", F.lit(True).alias("failed")), "document_id", "left").na.fill(False, ["failed"])
    else:
        rows = rows.withColumn("failed", F.lit(False))
    label, score = agreement_label(F.col("rules_n"), F.col("model_n"), F.col("matched"))
    rows = rows.withColumn("rules_confidence", rules_confidence(F.col("rules_n"), F.col("has_ref")))
    rows = rows.withColumn("model_confidence", model_confidence(F.col("model_n"), F.col("failed")))
    rows = rows.withColumn("agreement", label).withColumn("agreement_score", score)
    rows = rows.withColumn("confidence", consensus_confidence(F.col("rules_confidence"), F.col("model_confidence"), F.col("agreement")))
    n = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("Rules extracted "), n("rules_n"), F.lit(" criteria (conf "), two(F.col("rules_confidence")), F.lit(") | LLM extracted "), n("model_n"),
        F.lit(" criteria (conf "), two(F.col("model_confidence")), F.lit(") | Cross-validation: "), F.col("agreement"), F.lit(" (score "), two(F.col("agreement_score")), F.lit(")"),
    )
    method = F.when(F.col("model_n") > 0, "rules+llm").when(F.col("rules_n") > 0, "rules_only").otherwise("neither")
    return rows.withColumn("method", method).withColumn("reasoning", text).drop("failed", "has_ref")


def qualitative_union(pairs: DataFrame) -> DataFrame:
    """Consensus of the semantic verdict and the recorded model verdict.

    Columns in: rules_verdict, rules_confidence, top_factor, model_verdict,
    model_confidence, model_reasoning (null when there is no response).
    """
    rules = F.coalesce("rules_verdict", F.lit("REVIEW"))
    model = F.coalesce("model_verdict", F.lit("REVIEW"))
    conf = F.coalesce("model_confidence", F.lit(0.0))
    label, score = verdict_agreement(rules, model)
    default = F.concat(
        F.lit("Semantic analysis: "), F.coalesce("top_factor", F.lit("no specific factors identified")), F.lit(". Rules-LLM "), label,
        F.lit(". Routing to officer review."),
    )
    reasoning = F.when(F.length("model_reasoning") > 0, F.col("model_reasoning")).otherwise(default)
    return pairs.select(
        *[c for c in pairs.columns if c not in ("rules_verdict", "model_verdict", "model_confidence")],
        rules.alias("rules_verdict"), F.col("model_verdict").alias("branch_verdict"), conf.alias("model_confidence"),
        consensus_verdict(rules, model).alias("verdict"), label.alias("agreement"), score.alias("agreement_score"),
        consensus_confidence(F.col("rules_confidence"), conf, label).alias("confidence"), reasoning.alias("reasoning"),
        F.when(F.col("model_verdict").isNotNull(), "rules+llm").otherwise("rules_only").alias("method"),
    )
