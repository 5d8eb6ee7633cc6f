"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are ratios of whole-text counts (see statistics.py); labels, language, source and doc_id are
not among them. Values are binned at quantiles of the training rows, trees grow level by level on
histograms of gradients, and the finished trees lie in flat arrays that numpy walks for many rows at once.

Training sees at most about ``sample_rows`` labelled documents, chosen by a hash of doc_id among rows
whose crc32(doc_id as text) mod 3 is not 1; all documents are scored in one pass without a shuffle.

Null and empty texts get the score of a text without words. Repeated rows get equal scores. Without
training rows every score is 0.5. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blobs_of, slices, uniform
from .isolation import text_statistics
from .statistics import NAMES, ratios, statistics

SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Trees:
    """Complete trees: node k of a tree has the children 2k + 1 and 2k + 2; leaves hold log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers, and for each feature the upper edges of its bins."""
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, most + 1)[1:-1], method="lower")) for col in x.T]
    return np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1), edges


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``rounds`` trees on the logistic loss."""
    if not len(x) or y.min() == y.max():
        start = 0.0 if not len(x) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0, start)
    binned, edges = _bins(x, bins)
    n, width = binned.shape
    flat = binned + np.arange(width) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, start)
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g = np.bincount(cells, np.repeat(gradient, width), k * width * bins).reshape(k, width, bins).cumsum(2)
            h = np.bincount(cells, np.repeat(hessian, width), k * width * bins).reshape(k, width, bins).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = 0
            for j, edge in enumerate(edges):
                gain[:, j, len(edge) :] = 0
            best = gain.reshape(k, -1).argmax(1)
            split = np.full(k, bins)
            for i in np.flatnonzero(gain.reshape(k, -1).max(1) > 1e-12):
                j, split[i] = divmod(int(best[i]), bins)
                feature[first + i], cut[first + i] = j, edges[j][split[i]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[node - first])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, gradient, 2**depth) / (np.bincount(at, hessian, 2**depth) + ridge)
        total += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.stack(features), np.stack(cuts), np.stack(leaves), depth, start)


def held_out() -> Column:
    """Whether a row belongs to the fold that is never learnt from; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """Texts and qualities of about ``rows`` labelled documents at most, chosen by a hash of doc_id.

    The chosen labels are at most ``rows`` pairs of numbers (give or take the spread of the hash), so they are
    broadcast and the documents are not shuffled.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = usable.count()
    chosen = usable.where(uniform("doc_id", seed=seed) < rows / max(total, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Trees for these documents, from a bounded sample of labelled rows outside the held-out fold."""
    sample = text_statistics(labelled_sample(docs, labels.where(~held_out()), sample_rows)).orderBy("quality", "counts").toPandas()
    counts = np.array(sample["counts"].tolist(), np.int64).reshape(-1, len(NAMES))
    return fit_trees(ratios(counts), sample["quality"].to_numpy(dtype=np.float64), **options)


def keep_good(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose text has a score of ``least`` or more."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                blobs = blobs_of(batch.column("text").slice(a, b - a))
                good = trees.score(ratios(statistics(blobs, hashes))) >= least
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                blobs = blobs_of(batch.column("text").slice(a, b - a))
                score = trees.score(ratios(statistics(blobs, hashes)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
