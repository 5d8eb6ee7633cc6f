"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: ``[\x20\x09-\x0D]``. ``bytes.split()`` splits on the same six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset a temporary folder serves in
    local mode only; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tenderloom-")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to a shared folder and read them from there: lineage ends, columns can be pruned."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_text(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns nested in ``row`` with another text, and n_chars, where there is one, to fit."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return rows.select(*(new.get(c, F.col("row")[c].alias(c)) for c in columns))


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for a row."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / float(1 << 53)


def give_back(*caches: dict) -> None:
    """At the end of a task: forget what was remembered and return free memory to the system, since workers live on."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()


def blobs_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the rows of a text column with at most so many bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


class WordHashes:
    """64-bit hashes of words, remembered from row to row up to ``most`` words."""

    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in [w for w in set(words) if w not in known]:
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` word hashes (``len(words) - width + 1`` of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[k : k + n]
    return mixed(out)


#: At most so many ranges, and so many sampled keys for each, reach the driver.
MOST_RANGES, KEYS_A_RANGE = 32_768, 20


def range_bounds(keys: DataFrame, rows_a_range: int) -> tuple[list, int]:
    """Bounds that cut the one column of ``keys`` into ranges of about equal numbers of rows, and the number of ranges.

    There are as many ranges as shuffle partitions at least. The bounds come from a sample of keys: they balance the work and must not touch results. A key that holds
    many rows can be several bounds.
    """
    total = keys.count()
    least = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(MOST_RANGES, max(least, -(-total // rows_a_range))))
    name = keys.columns[0]
    found = sorted(r[0] for r in keys.where(F.col(name).isNotNull()).sample(min(1.0, KEYS_A_RANGE * n / max(total, 1)), seed=1).collect())
    return ([found[len(found) * i // n] for i in range(1, n)] if found else []), n


def range_number(key: Column, bounds: list) -> Column:
    """The number of the range of a numeric key, from 0; a null key is in range 0."""
    cuts = np.array(bounds)

    @F.pandas_udf("int")
    def number(keys):
        out = np.searchsorted(cuts, keys.to_numpy(), side="right") if len(cuts) else np.zeros(len(keys))
        return keys.__class__(np.where(keys.isna(), 0, out).astype(np.int32))

    return number(key)
