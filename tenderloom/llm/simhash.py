"""Document fingerprints: SimHash of 128 bits, and permuted block tables for near fingerprints.

Terms are runs of one to three words, weighted by how often they occur and by their length in words; each
term's hash bits vote with its weight, and the sign of the votes is the fingerprint. Equal texts have equal
fingerprints. Likeness is the share of equal bits. A text without words has the fingerprint zero.

Search: a fingerprint is cut into ``radius + 1`` blocks of bits. Two fingerprints within the radius agree in a
whole block, so one table for each block, with that block moved to the front as the key, finds every one.
Equal fingerprints are one entry of the tables.

``edited`` pairs each document with the next one in descending doc_id order (after the last the first): texts
are dealt to ranges of doc_id and sorted, neighbours meet inside a range, and the greatest document
of each range is sent to the range above as well. A lone document is its own neighbour. Null texts count as
empty; a null doc_id comes last; repeated rows are neighbours. Empty tables give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, mixed, range_bounds, range_number, window_hashes

BITS, RADIUS, WIDTHS = 128, 5, (1, 2, 3)
ROWS_A_RANGE = 4_000
#: Terms that vote at once, in groups whose counts fit a byte; bounds the memory of a vote.
GROUP = 255
BLOCK = 64 * GROUP


def ones(terms: np.ndarray) -> np.ndarray:
    """How many of the terms' hashes have each of the bits."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(terms), BLOCK):
        own = terms[at : at + BLOCK]
        pair = np.zeros((-(-len(own) // GROUP) * GROUP, 2), np.uint64)
        pair[: len(own), 0] = mixed(own)
        pair[: len(own), 1] = mixed(own + np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(pair.view(np.uint8).reshape(-1)).reshape(-1, GROUP, BITS)
        total += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return total


def fingerprint(words: np.ndarray) -> tuple[int, int]:
    """The high and low 64 bits for the hashes of a text's words, as signed integers."""
    votes = np.zeros(BITS, np.int64)
    for width in WIDTHS:
        terms = window_hashes(words, width)
        votes += width * (2 * ones(terms) - len(terms))
    high, low = np.packbits(votes > 0).view(">i8")
    return int(high), int(low)


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(float(BITS))


def shown(high: Column, low: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (range, doc_id, text, sent) so that sorting a range by sent and descending doc_id lines up neighbours.

    Rows with ``sent`` are the copies that only serve as the last neighbour of a range. The number of ranges
    comes with them.
    """
    bounds, n_ranges = range_bounds(docs.select("doc_id"), ROWS_A_RANGE)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.select(range_number(F.col("doc_id"), bounds).alias("range"), "doc_id", "text", "tie", F.lit(0).alias("sent"))
    # One row per range, MOST_RANGES at most; texts join it by the greatest key.
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")
    heads = rows.groupBy("range").agg(F.max(order).alias("top"), F.max_by("text", order).alias("text"))
    every = W.orderBy("range")
    above = F.coalesce(F.lead("range").over(every), F.min("range").over(W.partitionBy(F.lit(0))))
    sent = heads.select(above.alias("range"), F.col("top.doc_id").alias("doc_id"), "text", F.col("top.tie").alias("tie"), F.lit(1).alias("sent"))
    return rows.unionByName(sent), n_ranges


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and fingerprints (high, low) of every text, its edited text and its neighbour's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows, n_ranges = neighbours(docs)
    rows = rows.repartitionById(n_ranges, "range").sortWithinPartitions("range", "sent", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    prints = [f"{p}_{h}" for p in ("own", "edited", "next") for h in ("high", "low")]
    names = ["doc_id", "n_chars", "edited_sha256", *prints]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        before: tuple | None = None  # range, doc_id, text, fingerprint

        def pair(text: str, own: tuple[int, int], after: str, following: tuple[int, int]) -> tuple:
            half = len(text) // 2
            whole = (text[: len(text) - half] + after[:half]).encode("utf-8", "replace")
            return (len(text), hashlib.sha256(whole).hexdigest(), *own, *fingerprint(hashes(whole.split())), *following)

        for batch in batches:
            names_type = batch.column("doc_id").type
            out = []
            for at, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("range", "doc_id", "text")), strict=True):
                own = fingerprint(hashes(text.encode("utf-8", "replace").split())) if before is None or before[0] != at or before[2] != text else before[3]
                if before is not None and before[0] == at:
                    out.append((before[1], *pair(before[2], before[3], text, own)))
                before = (at, doc_id, text, own)
            if out:
                kinds = [names_type, pa.int64(), pa.string(), *[pa.int64()] * len(prints)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("range", "doc_id", "text").mapInArrow(paired, f"doc_id {kind}, n_chars bigint, edited_sha256 string, " + ", ".join(f"{p} bigint" for p in prints))


def block_tables(high: Column, low: Column, radius: int = RADIUS) -> Column:
    """Keys (block number, the block's bits) of a fingerprint, one for each of radius + 1 blocks."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]

    def bits(start: int, end: int) -> Column:
        """Bits start to end, counted from the top; a block is shorter than 64."""
        mask = lambda n: (1 << n) - 1
        if end <= 64:
            return F.shiftrightunsigned(high, 64 - end).bitwiseAND(F.lit(mask(end - start)))
        if start >= 64:
            return F.shiftrightunsigned(low, 128 - end).bitwiseAND(F.lit(mask(end - start)))
        return F.shiftleft(bits(start, 64), end - 64).bitwiseOR(bits(64, end))

    if radius < 2:
        raise ValueError("a block must be shorter than 64 bits: radius 2 or more")
    return F.array(*(F.struct(F.lit(i).alias("block"), bits(a, b).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def find_near(prints: DataFrame, asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (high, low, other_high, other_low, distance) of different fingerprints within the radius.

    ``asked`` are the fingerprints searched for, ``prints`` all; both have high and low. No pair within the
    radius is missed, and each is given once.
    """
    keyed = lambda df: df.select("high", "low").distinct().select("high", "low", F.explode(block_tables(F.col("high"), F.col("low"), radius)).alias("key"))
    other = keyed(prints).select("key", F.col("high").alias("other_high"), F.col("low").alias("other_low"))
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("other_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("other_low")))
    met = keyed(asked).join(other, "key").withColumn("distance", distance).where(F.col("distance").between(1, radius))
    # A pair may agree in several blocks: the first of them gives it.
    same = F.filter(F.arrays_zip(block_tables(F.col("high"), F.col("low"), radius).alias("a"), block_tables(F.col("other_high"), F.col("other_low"), radius).alias("b")), lambda z: z["a"]["bits"] == z["b"]["bits"])
    return met.where(same[0]["a"]["block"] == F.col("key.block")).drop("key")
