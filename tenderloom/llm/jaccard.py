"""N-gram Jaccard join: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

Equal texts are one class from the start. MinHash signatures are cut into bands; the numbers of bands and
rows follow from the target recall at the threshold (``bands_for``), and texts that agree in a band meet in a
bucket. Every pair of texts that meets in a bucket, and whose numbers of runs allow the similarity, is verified
on its full sets of runs, so there are no false links, and a link is missed only if no band agrees, with
probability below 1 - recall. Buckets are looked through in order of bucket and size, cut into even ranges
wherever they are large.

No pair is written. Candidate texts lie in blocks of about ``block_runs`` runs; texts of a bucket tend to share
a block. A pair of blocks that share a bucket is one task, which finds its candidate pairs by their
bands, verifies them in bounded slices with bit sets, and returns, per text, the number of links and the
smallest text of its local group. Links inside a large group that follow from the runs most of its texts have
are counted without their pairs (``Families``). Every pair of texts belongs to one pair of blocks, so links add up exactly; a large
group of near copies spreads over many pairs of blocks. Groups are joined by label propagation with the
labels written to the shared folder after each round.

A text of fewer than five words is one run of all its words. A text without words has no runs and no
links; equal ones still share a class. Null counts as empty. Words are ``[^\\x20\\x09-\\x0D]+`` as they stand.
Repeated rows are copies. The class id is the least doc_id of the class; null doc_ids do not count for it.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blobs_of, mixed, slices, window_hashes, written

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
BLOCK_RUNS, BLOCK_TEXTS = 250_000, 10_000
#: Bounds of what a task holds at once: pairs by bands, cells of texts by texts, bytes of bit sets.
SLICE_PAIRS, SLICE_CELLS, BIT_SET_BYTES = 2_000_000, 16_000_000, 32 << 20
LEAST_FAMILY = 64
HOPS = 2
RUN_BYTES = 5


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Numbers of bands and rows: the most rows, so the fewest chance meetings, that reach the recall with the hashes."""
    for rows in range(32, 0, -1):
        miss = math.log1p(-(threshold**rows))
        bands = max(1, math.ceil(math.log(1 - recall) / miss))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a text's runs of words; a short text is one run."""
    return window_hashes(words, min(width, len(words))) if len(words) else np.zeros(0, np.uint64)


def band_keys(runs: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A key for each band (columns) of each text (rows); texts must have runs."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    flat = np.concatenate(runs)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]])
    keys = np.empty((len(runs), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(runs), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = mixed(key + np.minimum.reduceat((flat * factors[k] + shifts[k]) >> np.uint64(32), starts))
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_runs (its distinct runs) and band keys of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                blobs = blobs_of(batch.column("text").slice(a, b - a))
                words = [(x or b"").split() for x in blobs]
                flat, ends = hashes([w for own in words for w in own]), np.cumsum([len(own) for own in words])
                runs = [runs_of(flat[e - len(own) : e], width) for own, e in zip(words, ends, strict=True)]
                full = [i for i, r in enumerate(runs) if len(r)]
                found = band_keys([runs[i] for i in full], bands, rows).view(np.int64).tolist() if full else []
                keys: list[list[int]] = [[] for _ in runs]
                for i, own in zip(full, found, strict=True):
                    keys[i] = own
                out = [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array([len(distinct(r)) for r in runs], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "key", "n_runs", "bands"])

    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    return keyed.mapInArrow(signed, f"doc_id {kind}, key binary, n_runs bigint, bands array<bigint>")


def text_key():
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def bucket_members(entries: DataFrame, threshold: float) -> DataFrame:
    """bucket and id for entries (bucket, n_runs, id) with a neighbour in the bucket of a size that allows the similarity.

    Sorted by bucket and size, an entry that has such a companion has one next to it. Entries at the ends of
    a batch, whose neighbours are out of sight, stay.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, size = (batch.column(k).to_numpy() for k in ("bucket", "n_runs"))
            pair = (bucket[1:] == bucket[:-1]) & (size[:-1] >= threshold * size[1:] - 1e-9)
            keep = np.ones(len(bucket), bool)
            keep[1:-1] = pair[:-1] | pair[1:]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("id")], ["bucket", "id"]).filter(pa.array(keep))

    order = ["bucket", "n_runs", "id"]
    return entries.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(close, "bucket bigint, id bigint")


def near_labels(members: DataFrame) -> DataFrame:
    """id and a label that texts of one bucket tend to share; it only decides which block a text lies in."""
    labels = members.select("id", F.col("id").alias("label")).distinct()
    for _ in range(HOPS):
        tops = members.join(labels, "id").groupBy("bucket").agg(F.min("label").alias("label"))
        labels = members.join(tops, "bucket").groupBy("id").agg(F.min("label").alias("label"))
    return labels


def blocks(members: DataFrame, texts: DataFrame, block_runs: int) -> DataFrame:
    """id and block for candidate texts (id, n_runs).

    Labels are dealt to bins of about ``block_runs`` runs; one with more runs is cut by a hash of the text.
    A text counts as so many runs at least that a block has about ``BLOCK_TEXTS`` texts at most.
    """
    sized = written(texts.join(near_labels(members), "id"), "labelled")
    weight = F.sum(F.greatest("n_runs", F.ceil(F.lit(block_runs) / BLOCK_TEXTS)))
    bins = max(1, -(-(sized.agg(weight).first()[0] or 0) // block_runs))
    labels = sized.groupBy("label").agg(F.greatest(F.ceil(weight / block_runs), F.lit(1)).alias("chunks"))
    bin_, chunk = F.pmod(F.xxhash64("label"), F.lit(bins)), F.pmod(F.xxhash64("id"), F.col("chunks"))
    return sized.join(labels, "label").select("id", (bin_ * (1 << 31) + chunk).alias("block"))


class Families:
    """Large groups of texts around a core of runs, and the links inside them that the core proves.

    Two texts with c and d of the core's k runs share at least c + d - k runs. Written as one integer weight a
    text, the bound proves a link wherever two weights of a family add up to 0 or more, so such links are
    counted on sorted weights and no pair of them is made. Pairs that the bound leaves open are verified.
    """

    def __init__(self, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> None:
        n = len(sets)
        self.family, self.weight, self.number = np.full(n, -1), np.zeros(n, np.int64), 0
        sizes = np.array([len(s) for s in sets])
        flat, starts = None, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seeds = np.ones(n, bool)
        for column in bands.T:
            order = np.argsort(column, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(column[order]) != 0, [True]]))
            for at in np.flatnonzero(np.diff(cuts) >= LEAST_FAMILY):
                group = order[cuts[at] : cuts[at + 1]]
                group = group[seeds[group]]
                if len(group) < LEAST_FAMILY:
                    continue
                seeds[group] = False
                flat = np.concatenate(sets) if flat is None else flat
                values, counts = np.unique(np.concatenate([sets[k] for k in group]), return_counts=True)
                core = values[2 * counts > len(group)]
                inside = np.add.reduceat(np.isin(flat, core).astype(np.int64), starts)
                weight = np.floor(1000 * ((1 + threshold) * (inside - len(core) / 2) - threshold * sizes)).astype(np.int64)
                free = self.family < 0
                own = free & (weight + weight[free].max(initial=-(1 << 40)) >= 0)
                if own.sum() >= LEAST_FAMILY:
                    self.family[own], self.weight[own] = self.number, weight[own]
                    self.number += 1
                    seeds[own] = False

    def links(self, same: bool, sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of proven links of each text, and pairs (i, j) that join what they join."""
        links, stars = np.zeros(len(self.family), np.int64), [np.zeros((2, 0), np.int64)]
        for number in range(self.number):
            for side, other in [(sides[0], sides[0])] if same else [sides, sides[::-1]]:
                own, others = (np.flatnonzero((self.family == number) & x) for x in (side, other))
                if not len(own) or not len(others):
                    continue
                weight, ordered = self.weight[own], np.sort(self.weight[others])
                links[own] += len(ordered) - np.searchsorted(ordered, -weight) - (same & (weight >= 0))
                # Whatever has a proven link has one with the greatest weight of the other side.
                top = others[np.argmax(self.weight[others])]
                joined = own[(weight + self.weight[top] >= 0) & (own != top)]
                stars.append(np.stack([joined, np.full(len(joined), top)]))
        return links, *np.concatenate(stars, axis=1)


def open_pairs(same: bool, bands: np.ndarray, families: Families, sides: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of pairs (i, j) that agree in a band and are not proven, each pair once; ``sides`` says which texts lie in either block."""
    n, family, weight = len(bands), families.family, families.weight
    left, right = (np.flatnonzero(side) for side in sides)
    reach, offset, ranges = 1 << 41, 1 << 40, []
    for column in bands.T:
        bucket = np.unique(column, return_inverse=True)[1]
        part = bucket * (families.number + 1) + family + 1
        # By bucket, family and weight: what a text's own weight proves is the end of its family's stretch.
        order = right[np.lexsort((weight[right], part[right]))]
        first, last = (np.searchsorted(bucket[order], bucket[left], side) for side in ("left", "right"))
        start, end = (np.searchsorted(part[order], part[left], side) for side in ("left", "right"))
        known, place = np.unique(part[order], return_inverse=True)
        asked = np.searchsorted(known, part[left]) * reach + offset - weight[left]
        proven = np.clip(np.searchsorted(place * reach + offset + weight[order], asked), start, end)
        ranges.append((order, first, np.where(family[left] < 0, end, proven) - first, end, last - end))
    ahead = np.cumsum(np.sum([r[2] + r[4] for r in ranges], axis=0))
    at = 0
    while at < len(left):
        done = ahead[at - 1] if at else 0
        to = max(at + 1, min(int(np.searchsorted(ahead, done + SLICE_PAIRS, "right")), at + SLICE_CELLS // n))
        met = np.zeros((min(to, len(left)) - at, n), bool)
        for order, first, some, end, rest in ranges:
            for starts, lengths in ((first[at:to], some[at:to]), (end[at:to], rest[at:to])):
                ends = np.cumsum(lengths)
                places = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
                met[np.repeat(np.arange(len(lengths)), lengths), order[places]] = True
        i, j = np.nonzero(met)
        i = left[i + at]
        yield (i[i < j], j[i < j]) if same else (i, j)
        at = to


def shared_runs(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of runs that pairs of texts share, with bit sets over bounded ranges of runs."""
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    _, column, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    row, column = row[counts[column] > 1], (np.cumsum(counts > 1) - 1)[column[counts[column] > 1]]
    n_columns, both = int((counts > 1).sum()), np.zeros(len(i), np.int64)
    width = max(64, BIT_SET_BYTES * 8 // len(used) // 64 * 64)
    for low in range(0, n_columns, width):
        inside = (column >= low) & (column < low + width)
        bits = np.zeros((len(used), -(-min(width, n_columns - low) // 64) * 8), np.uint8)
        # Each run is in a set once, so adding sets its bit.
        np.add.at(bits, (row[inside], (column[inside] - low) // 8), np.uint8(1) << ((column[inside] - low) % 8).astype(np.uint8))
        lanes = bits.view(np.uint64)
        step = max(1, (8 << 20) // bits.shape[1])
        for at in range(0, len(i), step):
            own = slice(at, at + step)
            both[own] += np.bitwise_count(lanes[place[i[own]]] & lanes[place[j[own]]]).sum(1, dtype=np.int64)
    return both


def verified(pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs that are linked."""
    sizes = np.array([len(s) for s in sets])
    for i, j in pairs:
        alike = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
        i, j = i[alike], j[alike]
        if len(i):
            both = shared_runs(i, j, sets)
            linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
            yield i[linked], j[linked]


def distinct(runs: np.ndarray) -> np.ndarray:
    """The set of a text's run hashes: 40 bits tell the runs of two texts apart."""
    return np.unique(runs >> np.uint64(24))


def packed(runs: np.ndarray) -> bytes:
    """A set of run hashes in five bytes each."""
    return distinct(runs).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // RUN_BYTES, 8), np.uint8)
    out[:, :RUN_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, RUN_BYTES)
    return out.view("<u8").reshape(-1)


def local_links(table: pa.Table, threshold: float) -> pa.Table:
    """For one pair of blocks: key, links and root (the least key of the local group) of every linked text."""
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    block, keys = table.column("block").to_numpy(), table.column("key").to_pylist()
    bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(keys), -1)
    sets = [unpacked(b) for b in table.column("runs").to_pylist()]
    sides = (block == p, block == q)
    families = Families(bands, sets, threshold)
    links, *stars = families.links(p == q, sides)
    # Texts are joined by the ranks of their keys, so a root is the least of its group.
    ranked = sorted(range(len(keys)), key=keys.__getitem__)
    rank = np.empty(len(keys), np.int64)
    rank[ranked] = np.arange(len(keys))
    root = np.arange(len(keys))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        ends = np.unique(np.stack([root[rank[i]], root[rank[j]]]), axis=1)
        for a, b in ends[:, ends[0] != ends[1]].T.tolist():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root[:] = root[root]

    join(*stars)
    for i, j in verified(open_pairs(p == q, bands, families, sides), sets, threshold):
        links += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
        join(i, j)
    out = np.flatnonzero(links)
    columns = [[keys[k] for k in out], links[out].tolist(), [keys[ranked[k]] for k in root[rank[out]].tolist()]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["key", "links", "root"])


def group_labels(edges: DataFrame) -> DataFrame:
    """key and label (the least key of its group) for edges (key, root): label propagation with pointer jumping.

    Each round takes the least label of the neighbours and then that label's own label, so the distance
    covered doubles; it ends with the round that changes nothing.
    """
    both = edges.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.key).groupBy(F.col("a").alias("key")).agg(F.min("label").alias("least"))
        moved = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("beyond"))
        jumped = moved.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        kept = written(jumped, "labels")
        labels = kept.select("key", "label")
        if kept.where("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc_id, key, class_id, n_links and n_copies for every document with doc_id and text.

    n_links counts the different texts linked to the document's, n_copies the other documents with its text;
    ``leads`` marks the text that stands for the class, and text_doc is the least doc_id with the text.
    """
    bands, rows = bands_for(threshold, recall, most_hashes)
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, width, bands, rows), "signatures")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("text_doc"), F.count("*").alias("n_docs"), F.first("n_runs").alias("n_runs"))
    # 64 bits of the key stand for a text until its set is fetched; texts that share them only meet needlessly.
    texts = written(texts.withColumn("id", F.xxhash64("key")), "texts")
    one = signed.join(texts.select("key", "text_doc", "id"), "key").where(F.col("doc_id").eqNullSafe(F.col("text_doc")))
    entries = one.select("id", "n_runs", F.explode("bands").alias("bucket"))
    members = written(bucket_members(entries, threshold), "members")
    candidates = texts.join(members.select("id").distinct(), "id")
    placed = written(blocks(members, candidates.select("id", "n_runs"), block_runs), "blocks")
    met = members.join(placed, "id").select("bucket", "block").distinct()
    pairs = met.select("bucket", F.col("block").alias("p")).join(met.select("bucket", F.col("block").alias("q")), "bucket").where("p <= q").select("p", "q").distinct()
    pairs = written(pairs, "block-pairs")
    tasks = pairs.select(F.col("p").alias("block"), "p", "q").unionByName(pairs.where("p < q").select(F.col("q").alias("block"), "p", "q"))
    tasks = tasks.groupBy("block").agg(F.collect_list(F.struct("p", "q")).alias("tasks"))
    wanted = candidates.select("id", "key", "text_doc").join(placed, "id").join(tasks, "block").drop("id")
    # Copies have other doc_ids, so the join moves each text once and no text's copies to one task.
    texts_of = docs.withColumn("key", text_key()).alias("d")
    sent = texts_of.join(wanted.hint("shuffle_hash").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.text_doc")) & (F.col("d.key") == F.col("w.key")))
    sent = sent.select("w.key", "w.block", "w.tasks", "d.text")

    def with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                runs = [runs_of(hashes((x or b"").split()), width) for x in blobs_of(batch.column("text").slice(a, b - a))]
                keys = pa.array(band_keys(runs, bands, rows).view(np.int64).tolist(), pa.list_(pa.int64()))
                own = [batch.column(k).slice(a, b - a) for k in ("key", "block", "tasks")]
                yield pa.RecordBatch.from_arrays([*own, keys, pa.array([packed(r) for r in runs], pa.binary())], ["key", "block", "tasks", "bands", "runs"])

    sets = sent.mapInArrow(with_runs, "key binary, block bigint, tasks array<struct<p:bigint,q:bigint>>, bands array<bigint>, runs binary")
    dealt = sets.select("key", "bands", "block", F.explode("tasks").alias("t"), "runs").select("key", "bands", "block", "t.p", "t.q", "runs")
    # A document repeated row by row would be sent twice.
    local = dealt.groupBy("p", "q").applyInArrow(lambda t: local_links(_once(t), threshold), "key binary, links bigint, root binary")
    local = written(local, "links")
    counts = local.groupBy("key").agg(F.sum("links").alias("n_links"))
    known = texts.select("key", "text_doc", "n_docs").join(group_labels(local.select("key", "root")), "key", "left").join(counts, "key", "left")
    known = written(known.select("key", "text_doc", "n_docs", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "groups")
    order = F.struct(F.col("text_doc").isNull(), "text_doc", "key")
    classes = known.groupBy("label").agg(F.min(order).alias("first"))
    named = known.join(classes, "label").select("key", "text_doc", F.col("first.text_doc").alias("class_id"), (F.col("first.key") == F.col("key")).alias("leads"), "n_links", (F.col("n_docs") - 1).alias("n_copies"))
    return signed.select("doc_id", "key").join(named, "key")


def _once(table: pa.Table) -> pa.Table:
    """The first row of each text."""
    seen: dict[bytes, int] = {}
    for at, key in enumerate(table.column("key").to_pylist()):
        seen.setdefault(key, at)
    return table.take(pa.array(list(seen.values()))) if len(seen) < table.num_rows else table


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``row`` (all columns of docs) for one document of each class, the one with the least doc_id.

    Of several rows with that doc_id and text one stays.
    """
    found = written(near_duplicates(docs, **options).where(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("text_doc"))).groupBy("key", "doc_id").agg(F.count("*").alias("n")), "leaders")
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("own")).alias("d")
    led = rows.join(found.hint("shuffle_hash").alias("f"), F.col("row.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("own") == F.col("f.key"))).select("row", "f.key", "n")
    # Repeated rows are rare; only they are shuffled again.
    return led.where("n = 1").select("row").unionByName(led.where("n > 1").groupBy("key").agg(F.first("row").alias("row")).select("row"))
