"""Quality rules: an isolation forest on rule statistics.

Every document gets base statistics and two fixed rules (fewer than 20 words; over 30 % of the words in
repeated 8-word windows). Documents that pass are judged by an isolation forest. Each rule statistic has
limits, the values that all but a thousandth of the good labelled documents keep on either side, and the
forest sees by how much a document exceeds them: trees of random splits isolate rows with rare excesses
after few splits. The threshold on the score is the one that all but ``good_loss`` of the good labelled
documents stay under.

The statistics of all documents are counted once, from whole texts, and written. Limits, scales and the
threshold come from all good labelled documents: quantiles are exact, found digit by digit from counts over all
rows. Only the trees draw rows, as isolation trees do: each draws 256 of at most about ``tree_rows`` labelled rows
chosen by a hash of doc_id.

Null and empty texts have no words and fail the base rule. Repeated rows get equal results. Empty tables
give no rows. Without labelled rows every document that passes the base rule is kept. Extra columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blobs_of, slices, uniform, written
from .statistics import NAMES, RATIOS, ratios, statistics

TREE_ROWS = 20_000
#: Bits of a value that one pass over the rows finds.
DIGIT_BITS = 13
GOOD_LOSS = 0.003
#: The share of good documents beyond each limit, and what is added to a standard deviation, which may be 0.
LIMIT, SPREAD = 0.001, 1e-9
BASE = NAMES[:5]
N_RULES = RATIOS.index("words_per_line")


@dataclass(frozen=True)
class Forest:
    """Limits, and trees of one depth as arrays: node k has the children 2k + 1 and 2k + 2."""

    low: np.ndarray
    high: np.ndarray
    scale: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    depth: int
    usual: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / usual length): near 1 for rows that few splits isolate."""
        x = excess(x, self.low, self.high, self.scale)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += length[node - (2**self.depth - 1)]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.usual)


def usual_length(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree: split features and cuts of the inner nodes, path lengths of the leaves."""
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    length = np.zeros(2**depth)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        if level == depth:
            length[node - (2**depth - 1)] = level + usual_length(len(rows))
            continue
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(high > low)
        if len(rows) <= 1 or not len(open_):
            # A leaf above the last level: rows go left down to it, and unseen values go nowhere else.
            first, last = node, node
            for _ in range(depth - level):
                first, last = 2 * first + 1, 2 * last + 2
            length[first - (2**depth - 1) : last + 1 - (2**depth - 1)] = level + usual_length(len(rows))
            continue
        feature[node] = rng.choice(open_)
        cut[node] = rng.uniform(low[feature[node]], high[feature[node]])
        right = x[rows, feature[node]] > cut[node]
        todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature, cut, length


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """How far each rule statistic lies outside its limits."""
    x = x[:, : len(low)]
    return (np.maximum(x - high, 0) + np.maximum(low - x, 0)) / scale


def no_forest() -> Forest:
    """Without good rows nothing is judged."""
    return Forest(*np.zeros((2, N_RULES)), np.ones(N_RULES), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0, 1.0, np.inf)


def grow_forest(x: np.ndarray, limits: tuple[np.ndarray, np.ndarray, np.ndarray], trees: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """Trees on the excesses of ``x`` over the limits (low, high, scale); no threshold yet."""
    own = excess(x, *limits)
    rng = np.random.default_rng(seed)
    n = min(rows, len(own))
    depth = max(1, int(np.ceil(np.log2(max(n, 2)))))
    grown = [grow(own[rng.choice(len(own), n, replace=False)], rng, depth) for _ in range(trees)]
    return Forest(*limits, *(np.stack(part) for part in zip(*grown, strict=True)), depth, max(usual_length(n), 1e-9), np.inf)


def fit_forest(x: np.ndarray, good: np.ndarray, trees: int = 100, rows: int = 256, good_loss: float = GOOD_LOSS, limit: float = LIMIT, seed: int = 7) -> Forest:
    """Limits from the good rows, trees on all, and the threshold that a share of ``good_loss`` of the good exceeds; for rows in memory."""
    rules = x[:, :N_RULES]
    if not good.any():
        return no_forest()
    low, high = np.quantile(rules[good], [limit, 1 - limit], axis=0)
    forest = grow_forest(x, (low, high, rules[good].std(0) + SPREAD), trees, rows, seed)
    return replace(forest, threshold=float(np.quantile(forest.score(x[good]), 1 - good_loss)))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = np.uint64(key)
    return float(np.array([bits ^ np.uint64(1 << 63) if bits >> np.uint64(63) else ~bits], np.uint64).view(np.float64)[0])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def values_at(rows: DataFrame, wanted: list[tuple[int, int]], width: int) -> list[float]:
    """The exact value at a rank (from 0) of a column of the arrays ``x``, over all rows, for each (column, rank).

    A pass counts the next digit of the values that share the digits found so far; the driver sees counts of digits.
    """
    found = [(j, 0, rank) for j, rank in wanted]
    left = 64
    while left:
        known, bits = 64 - left, min(DIGIT_BITS, left)
        left -= bits
        cells = sorted({(j, prefix) for j, prefix, _ in found})

        def counted(batches: Iterator[pa.RecordBatch], cells=cells, known=known, bits=bits, left=left) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(cells), 1 << bits), np.int64)
            for batch in batches:
                keys = _sortable(_matrix(batch.column("x"), width))
                for c, (j, prefix) in enumerate(cells):
                    own = keys[:, j]
                    if known:
                        own = own[own >> np.uint64(64 - known) == np.uint64(prefix)]
                    total[c] += np.bincount(((own >> np.uint64(left)) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            cell, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(digit), pa.array(total[cell, digit])], ["cell", "digit", "n"])

        sums = rows.select("x").mapInArrow(counted, "cell bigint, digit bigint, n bigint").groupBy("cell", "digit").agg(F.sum("n").alias("n")).orderBy("cell", "digit").toPandas()
        at = {c: (part["digit"].to_numpy(), part["n"].to_numpy().cumsum()) for c, part in sums.groupby("cell")}
        for i, (j, prefix, rank) in enumerate(found):
            digits, upto = at[cells.index((j, prefix))]
            k = int(np.searchsorted(upto, rank, side="right"))
            found[i] = (j, prefix << bits | int(digits[k]), rank - (int(upto[k - 1]) if k else 0))
    return [_double(prefix) for _, prefix, _ in found]


def quantiles(rows: DataFrame, n: int, shares: list[float], width: int) -> np.ndarray:
    """Quantiles of every column of the arrays ``x`` over all ``n`` rows, between ranks as numpy has them: one row for each share."""
    places = [(n - 1) * share for share in shares]
    ranks = [(min(int(p), n - 1), min(int(p) + 1, n - 1)) for p in places]
    values = np.array(values_at(rows, [(j, r) for pair in ranks for r in pair for j in range(width)], width)).reshape(len(shares), 2, width)
    part = np.array([p - int(p) for p in places])[:, None]
    a, b = values[:, 0], values[:, 1]
    return np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)


def text_statistics(docs: DataFrame, column: str = "quality") -> DataFrame:
    """One row per document: ``column`` and all counts as an array."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                blobs = blobs_of(batch.column("text").slice(a, b - a))
                counts = pa.array(statistics(blobs, hashes).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(column).slice(a, b - a), counts], [column, "counts"])

    return docs.select(column, "text").mapInArrow(counted, f"{column} {dict(docs.dtypes)[column]}, counts array<bigint>")


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, written once for the fit and the verdicts."""
    return written(text_statistics(docs, "doc_id"), "statistics")


def fit_rules(docs: DataFrame, labels: DataFrame, **options) -> Forest:
    """The forest for these documents, from all labelled ones."""
    return fit_counts(measured(docs), labels, **options)


def fit_counts(counted: DataFrame, labels: DataFrame, tree_rows: int = TREE_ROWS, good_loss: float = GOOD_LOSS, seed: int = 7) -> Forest:
    """The same from what ``measured`` gives for the documents."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = usable.count()
    labelled = counted.join(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _matrix(batch.column("counts"), len(NAMES))
            passed = ~base_failed(counts)
            x = ratios(counts[passed])[:, :N_RULES]
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], ["x"])

    good = written(labelled.where("quality = 1").mapInArrow(rules, "x array<double>"), "rules")
    spread = [F.stddev_pop(F.col("x")[j]) for j in range(N_RULES)]
    n, *scale = good.agg(F.count(F.lit(1)), *spread).first()
    drawn = labelled.where(uniform("doc_id", seed=seed) < tree_rows / max(total, 1)).select("quality", "counts").orderBy("quality", "counts").toPandas()
    counts = np.array(drawn["counts"].tolist(), np.int64).reshape(-1, len(NAMES))
    x = ratios(counts[~base_failed(counts)])
    if not n or not len(x):
        return no_forest()
    low, high = quantiles(good, n, [LIMIT, 1 - LIMIT], N_RULES)
    forest = grow_forest(x, (low, high, np.array(scale) + SPREAD), seed=seed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(_matrix(batch.column("x"), N_RULES))
            yield pa.RecordBatch.from_arrays([pa.array(score[:, None].tolist(), pa.list_(pa.float64()))], ["x"])

    scores = written(good.mapInArrow(scored, "x array<double>"), "scores")
    return replace(forest, threshold=float(quantiles(scores, n, [1 - good_loss], 1)[0, 0]))


def apply_rules(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly score and kept for every document."""
    return judge_counts(text_statistics(docs, "doc_id"), forest)


def judge_counts(counted: DataFrame, forest: Forest) -> DataFrame:
    """The same from what ``measured`` gives for the documents."""
    names = ["doc_id", *BASE, "base_failed", "anomaly", "kept"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _matrix(batch.column("counts"), len(NAMES))
            failed, score = base_failed(counts), forest.score(ratios(counts))
            out = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))]
            yield pa.RecordBatch.from_arrays(out, names)

    kinds = f"doc_id {dict(counted.dtypes)['doc_id']}, " + ", ".join(f"{k} bigint" for k in BASE) + ", base_failed boolean, anomaly double, kept boolean"
    return counted.select("doc_id", "counts").mapInArrow(judged, kinds)
