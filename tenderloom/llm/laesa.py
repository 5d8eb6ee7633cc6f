"""Vector code compression: product codes whose nearest entries are found by LAESA pivots.

Vectors become integers and are cut into equal parts; each part position has a small codebook, trained in
rounds of assigning and averaging. A few fixed pivots stand for each position, chosen among the
first entries, far from each other. The distances of all parts to their pivots are computed once and written
beside the integers. In a round the distances of pivots and entries give, by the triangle inequality, a lower
bound of each part's distance to each entry; entries are tried in the order of their bounds with exact integer
distances until the bound passes the best one found. Bounds are rounded down, so that pruning never changes a result.

Rows live in one written table; a round reads it, and only sums per part and entry leave the tasks, so that
neither a hot label nor a vector that many rows share meets in one task. Codebooks are small and go with the tasks.

Rows go whose vector is null or has a null or non-finite component. A vector without a length that the parts
divide, or of another length than the first kept one, keeps its row with code and error null. Order among
equal vec_ids: by the integers' bytes; a null vec_id comes last. Components beyond 2**62 count as 2**62, and an error beyond
the greatest long as that. With fewer rows than entries, codebooks are smaller. Repeated rows count
each. Empty tables give no rows. Extra columns are ignored; a missing label column is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 8, 16, 6, 4, 4096
LIMIT, MOST = 1 << 62, (1 << 63) - 1
#: Vectors handled at once inside a task.
AT_ONCE = 4_096
#: Below so many labels their sums are sent to all tasks; above, rows meet them under salts.
BROADCAST_LABELS, SALTS = 200_000, 32


@dataclass
class Codebooks:
    """Entries and pivots of each part position, as integers."""

    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    def digest(self) -> str:
        numbers = [str(x) for book in self.entries for x in book.reshape(-1).tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances of such integers surely fit a long."""
    return all(not a.size or (int(a.max()) < 1 << 26 and int(a.min()) >= -(1 << 26) and a.shape[-1] <= 256) for a in arrays)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python's integers serve where a long might not."""
    if fits(x, y):
        gap = x - y
        return np.einsum("ij,ij->i", gap, gap)
    gap = x.astype(object) - y.astype(object)
    return (gap * gap).sum(1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots as floats."""
    return np.stack([squared(x, np.broadcast_to(p, x.shape)).astype(float) for p in pivots], 1) ** 0.5


def choose_pivots(first: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n of the first entries, each as far as possible from those before."""
    chosen = [0]
    while len(chosen) < min(n, len(first)):
        gaps = distances(first, first[chosen]).min(1)
        chosen.append(int(gaps.argmax()))
    return first[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties: the lower index), its squared distance, and how many distances were computed."""
    n, exact = len(x), fits(x, entries)
    entry_gaps = distances(entries, pivots)
    bound = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        own = to_pivots[:, p, None].astype(float)
        # Stored distances have 24 bits; the slack is more than their rounding.
        np.maximum(bound, np.abs(own - entry_gaps[:, p]) - (own + entry_gaps[:, p]) * 1e-6, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    index = order[:, 0].copy()
    best = squared(x, entries[index])
    computed, alive = n, np.arange(n)
    for rank in range(1, len(entries)):
        e = order[alive, rank]
        near = bound[alive, e] <= best[alive].astype(float) * (1 + 1e-9)
        alive, e = alive[near], e[near]
        if not len(alive):
            break
        found = squared(x[alive], entries[e])
        computed += len(alive)
        if found.dtype != best.dtype and not exact:
            best, found = best.astype(object), found.astype(object)
        old = best[alive]
        better = (found < old) | ((found == old) & (e < index[alive]))
        index[alive[better]], best[alive[better]] = e[better], found[better]
    return index, best, computed


def integers(values: pa.Array, scale: int = SCALE) -> list[np.ndarray | None]:
    """Integer vectors of a list column; None for a vector that is null or has a null or non-finite component."""
    out: list[np.ndarray | None] = []
    flat = values.flatten().cast(pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False)  # null components become NaN
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(values).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    null = values.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        scaled = np.floor(numbers * scale)
        whole = np.where(np.abs(scaled) < LIMIT, scaled, 0).astype(np.int64)
        whole = np.where(scaled >= LIMIT, LIMIT, np.where(scaled <= -LIMIT, -LIMIT, whole))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    for end, size, gone in zip(ends.tolist(), sizes.tolist(), null.tolist(), strict=True):
        out.append(None if gone or bad[end] > bad[end - size] else whole[end - size : end])
    return out


def integer_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, and ``ints``, the integers of the kept vectors as little-endian longs."""
    kinds = dict(rows.dtypes)

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = integers(batch.column("embedding"), scale)
            kept = batch.select(["vec_id", "label"]).filter(pa.array([v is not None for v in found]))
            blobs = pa.array([v.astype("<i8").tobytes() for v in found if v is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns, blobs], ["vec_id", "label", "ints"])

    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(converted, f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints binary")


def cut(blobs: list[bytes], parts: int) -> np.ndarray:
    """Integers of equally long vectors, as (vector, part, component)."""
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), parts, -1)


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(at, AT_ONCE)


def with_pivots(rows: DataFrame, pivots: list[np.ndarray], length: int) -> DataFrame:
    """Adds ``gaps``: distances of each part to the pivots of its position, computed once, as 32-bit floats."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", gaps binary"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                blobs = batch.column("ints").to_pylist()
                gaps: list[bytes | None] = [None] * len(blobs)
                own = [i for i, b in enumerate(blobs) if len(b) == length]
                if own:
                    x = cut([blobs[i] for i in own], len(pivots))
                    found = np.stack([distances(x[:, p], pivots[p]) for p in range(len(pivots))], 1).astype("<f4")
                    for i, row in zip(own, found, strict=True):
                        gaps[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gaps, pa.binary())], [*batch.schema.names, "gaps"])

    return rows.mapInArrow(measured, schema)


def assign(x: np.ndarray, gaps: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for p, (entries, pivots) in enumerate(zip(books.entries, books.pivots, strict=True)):
        index, best, _ = nearest(x[:, p], gaps[:, p], entries, pivots)
        yield p, index, best


def read_chunk(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    x = cut(batch.column("ints").to_pylist(), len(books.entries))
    gaps = np.frombuffer(b"".join(batch.column("gaps").to_pylist()), "<f4").reshape(len(x), len(books.entries), -1)
    return x, gaps


def averaged(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floored means of the parts nearest to them; unused entries stay."""
    shape = [b.shape for b in books.entries]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(s, object) for s in shape]
        counts = [np.zeros(s[0], np.int64) for s in shape]
        for whole in batches:
            for batch in chunks(whole):
                x, gaps = read_chunk(batch, books)
                for p, index, _ in assign(x, gaps, books):
                    counts[p] += np.bincount(index, minlength=shape[p][0])
                    for e in np.unique(index).tolist():
                        own = x[:, p][index == e]
                        sums[p][e] += (own if fits(own) else own.astype(object)).sum(0)
        out = [(p, e, i, int(sums[p][e, i]), int(counts[p][e])) for p, (k, d) in enumerate(shape) for e in range(k) if counts[p][e] for i in range(d)]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "entry", "at", "total", "n"])

    sums = rows.select("ints", "gaps").mapInArrow(summed, "part int, entry int, at int, total decimal(38,0), n bigint")
    # One row for each component of each entry: its number does not depend on the input.
    totals = sums.groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    entries = [b.copy() for b in books.entries]
    for r in totals.collect():
        entries[r.part][r.entry, r["at"]] = int(r.total) // r.n
    return Codebooks(entries, books.pivots)


def encoded(rows: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error of every row."""
    kinds = dict(rows.dtypes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                fit = np.array([len(b) == length for b in batch.column("ints").to_pylist()], bool)
                codes: list[str | None] = [None] * batch.num_rows
                errors: list[int | None] = [None] * batch.num_rows
                if fit.any():
                    x, gaps = read_chunk(batch.filter(pa.array(fit)), books)
                    index, error = np.zeros((len(x), len(books.entries)), np.uint8), [0] * len(x)
                    for p, own, best in assign(x, gaps, books):
                        index[:, p] = own
                        error = [a + b for a, b in zip(error, best.tolist(), strict=True)]
                    for at, code, e in zip(np.flatnonzero(fit).tolist(), index, error, strict=True):
                        codes[at], errors[at] = code.tobytes().hex(), min(e, MOST)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints", "gaps").mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks, int] | None:
    """Integer rows with their pivot distances as a written table, the codebooks, and the bytes of a vector; None without rows that fit.

    ``rows`` are those of ``integer_rows``; the first entries are the parts of the smallest vec_ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries, two hexadecimal digits")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    fit = rows.where((F.length("ints") > 0) & (F.length("ints") % (8 * parts) == 0))
    lead = fit.orderBy(*order).select(F.length("ints").alias("n")).first()
    if lead is None:
        return None
    length = lead.n
    blobs = [bytes(r.ints) for r in fit.where(F.length("ints") == length).orderBy(*order).limit(entries).collect()]
    first = cut(blobs, parts)
    books = Codebooks([first[:, p].copy() for p in range(parts)], [choose_pivots(first[:, p], pivots) for p in range(parts)])
    ready = written(with_pivots(rows, books.pivots, length), "laesa-gaps")
    for _ in range(rounds):
        books = averaged(ready.where(F.length("ints") == length), books)
    return ready, books, length


def sum_by_label(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of errors over equal labels, null labels together."""
    most = F.lit(MOST).cast("decimal(38,0)")
    sums = written(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")), "laesa-labels")
    sums = sums.withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("own")), "left").drop("of", "salt", "own")


def compress(vectors: DataFrame, **settings: int) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error and label_error of every kept vector, and the codebooks.

    ``vectors`` has vec_id, embedding (a list of numbers) and label.
    """
    rows = written(integer_rows(vectors), "laesa-integers")
    trained = train(rows, **settings)
    if trained is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")), None
    ready, books, length = trained
    return sum_by_label(written(encoded(ready, books, length), "laesa-codes")), books


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same result in SQL, every distance computed."""
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    found = "SELECT vec_id, p, x, min(struct_pack(gap := {gap}, e := e)) AS m FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p, x"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({found.format(gap=gap, r=r)})")
        if r < rounds:
            mean = "(sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(
                f"m{r} AS (SELECT p, e, list(q ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, CAST({mean} AS BIGINT) AS q "
                f"FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, m.e, i) GROUP BY p, e), "
                f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, CAST(p AS INT) AS p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.gap) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books"""
