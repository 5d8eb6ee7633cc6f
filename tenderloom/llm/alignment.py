"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over the corpus.

Both tokenizers read ``space + text``; byte offsets where tokens of both end cut them into groups, and every
token of one is linked with every token of the other in its group. An id pair counts the documents
that hold it linked.

No token of either crosses from a character that is no white space to a space or line feed after it, so a text is
cut there into parts; groups never span parts, and each task aligns once each part that it remembers.

The count is an external one. A task gathers pair-document records up to a bound (a block), sorts them, deals
them by the first id's radix to runs, and spills the runs, compressed with zstandard, as rows of a table in the shared
folder, so that a lost executor costs only its tasks. The heads of runs (pairs and their documents in the block) are
merged by a heap, a bounded number at a time and level by level until one run is left for a radix. Merged runs are in
order of the first id, so its highest count is found in passing. Counts and highest counts then go back down the
levels to the runs, where they are added up by document; packed sums return to the block's documents. What moves
is heads, runs and sums, never a row for each link, and no task or group grows with a hot pair, id or document:
a block holds a bounded number of records, a merge a bounded number of runs over the ids of the vocabularies.

Texts that are null or empty, or whose tokens' bytes are not those of ``space + text`` (a normaliser changed
them), have no tokens: zeros and an empty digest. Repeated rows are documents of their own. A null doc_id is
kept. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, written
from .sentencepieces import BYTE, read_model

#: Runs of a block, and runs that one merge reads.
RADIXES, FAN_IN = 64, 48
#: Records and documents of a block, and parts that a task remembers and aligns at once; they bound its memory.
BLOCK_RECORDS, BLOCK_DOCS, REMEMBERED, AT_ONCE, LONG_PART = 1_000_000, 20_000, 400_000, 8_000, 64
#: Groups with more links than this are counted by distinct ids.
WIDE = 256
CUT = re.compile(r"(?<=\S)(?=[ \n])")
SIMPLE = re.compile(r" \S+")


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of integers as one compressed run; the first is ascending and stored as differences."""
    import zstandard

    columns = [a.astype("<i8") for a in arrays]
    columns[0] = np.diff(columns[0], prepend=0)
    # The bytes of a place together: high ones are mostly zero.
    planes = np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n, 8, -1)
    out = np.ascontiguousarray(cells.transpose(0, 2, 1)).view("<i8").reshape(n, -1)
    return [np.cumsum(out[0]), *out[1:]]


def byte_of() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_table(tokens: dict[int, bytes]) -> tuple[list[bytes], np.ndarray]:
    table = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
    return table, np.array([len(t) for t in table], np.int64)


#: Of one part: numbers of first and second tokens, groups, links, its groups as text, and pairs and their links as longs.
Part = tuple[int, int, int, int, bytes, bytes, bytes]
NONE: Part = (0, 0, 0, 0, b"", b"", b"")


class Aligner:
    """Aligns parts of texts by a byte-level tokenizers file and a sentencepiece model."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        letters = byte_of()
        self.first_bytes, self.first_sizes = token_table({i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.first.get_vocab().items()})
        with open(second, "rb") as file:
            blob = file.read()
        model = read_model(blob)
        self.divisible = model.divisible
        # A later part of a message overrides an earlier one: parts bring their own space.
        self.second = sentencepiece.SentencePieceProcessor(model_proto=blob + b"\x1a\x02\x18\x00")
        self.second_bytes, self.second_sizes = token_table({i: bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace("▁", " ").encode() for i, (p, _, kind) in enumerate(model.pieces)})
        feed = self.first.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.names = [str(i) for i in range(max(len(self.first_bytes), len(self.second_bytes)))]
        self.known: dict[str, Part | None] = {}

    def _first_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts; those of one space and one word are asked for in lines, whose feeds are tokens of their own."""
        out: list[list[int]] = [[]] * len(parts)
        simple = [i for i, p in enumerate(parts) if self.feed is not None and SIMPLE.fullmatch(p)]
        lines = [simple[at : at + 64] for at in range(0, len(simple), 64)]
        for line, found in zip(lines, self.first.encode_batch_fast(["\n".join([parts[i] for i in line]) for line in lines], add_special_tokens=False), strict=True):
            ids, at = found.ids, 0
            for i in line[:-1]:
                end = ids.index(self.feed, at)
                out[i], at = ids[at:end], end + 1
            out[line[-1]] = ids[at:]
        rest = sorted(set(range(len(parts))) - set(simple))
        for i, found in zip(rest, self.first.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def learn(self, parts: list[str]) -> dict[str, Part | None]:
        firsts, seconds = self._first_ids(parts), self.second.encode(parts, num_threads=1)
        raw = [p.encode() for p in parts]
        if self._same(raw, firsts, seconds):
            return dict(zip(parts, self.align(firsts, seconds), strict=True))
        out: dict[str, Part | None] = dict.fromkeys(parts)
        good = [i for i, r in enumerate(raw) if self._same([r], firsts[i : i + 1], seconds[i : i + 1])]
        if good:
            out.update(zip([parts[i] for i in good], self.align([firsts[i] for i in good], [seconds[i] for i in good]), strict=True))
        return out

    def _same(self, raw: list[bytes], firsts: list[list[int]], seconds: list[list[int]]) -> bool:
        """Whether the tokens of both sides have the bytes of each part; sizes are compared where parts are joined."""
        whole = b"".join(raw)
        for lists, table, sizes in ((firsts, self.first_bytes, self.first_sizes), (seconds, self.second_bytes, self.second_sizes)):
            ids = list(chain.from_iterable(lists))
            if b"".join(map(table.__getitem__, ids)) != whole:
                return False
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum([len(x) for x in lists])]
            if (ends != np.cumsum([len(r) for r in raw])).any():
                return False
        return True

    def align(self, firsts: list[list[int]], seconds: list[list[int]]) -> Iterator[Part]:
        """Groups and links of parts whose tokens cover the same bytes."""
        sizes_a, sizes_b = np.array([len(x) for x in firsts]), np.array([len(x) for x in seconds])
        a, b = (np.fromiter(chain.from_iterable(lists), np.int64) for lists in (firsts, seconds))
        ends_a, ends_b = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        part_of = np.searchsorted(ends_a[np.cumsum(sizes_a) - 1], common)
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        links = n_a * n_b
        narrow = np.flatnonzero(links <= WIDE)
        at = np.repeat(narrow, links[narrow])
        k = np.arange(len(at)) - np.repeat(np.cumsum(links[narrow]) - links[narrow], links[narrow])
        owner = [part_of[at]]
        code = [(a[start_a[at] + k // n_b[at]] << 32) | b[start_b[at] + k % n_b[at]]]
        times = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            (x, nx), (y, ny) = (np.unique(t[s : s + n], return_counts=True) for t, s, n in ((a, start_a[g], n_a[g]), (b, start_b[g], n_b[g])))
            code.append(((x << 32)[:, None] | y).reshape(-1))
            times.append((nx[:, None] * ny).reshape(-1))
            owner.append(np.full(len(code[-1]), part_of[g]))
        owner, code, times = map(np.concatenate, (owner, code, times))
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
        code, times, owner = code[new].astype("<i8").tobytes(), np.add.reduceat(times, new).astype("<i8").tobytes(), owner[new]
        cuts = (8 * np.searchsorted(owner, np.arange(len(firsts) + 1))).tolist()
        groups, total = np.bincount(part_of, minlength=len(firsts)).tolist(), np.bincount(part_of, links, len(firsts)).astype(np.int64).tolist()
        texts = self._texts(a, b, group_a, group_b, part_of)
        pairs, links_of = ([x[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (code, times))
        return zip(sizes_a.tolist(), sizes_b.tolist(), groups, total, texts, pairs, links_of, strict=True)

    def _texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, part_of: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each part."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a, b])[order].tolist()
        step = side[1:] - side[:-1]
        mark = np.where(step == 0, 0, np.where(side[1:] % 2 == 1, 1, 2))
        part = part_of[side // 2]
        mark = np.where(part[1:] != part[:-1], 3, mark)
        marks = [*(",|;\n"[m] for m in mark.tolist()), ""]
        names = self.names
        return "".join(chain.from_iterable(zip(map(names.__getitem__, ids), marks, strict=True))).encode().split(b"\n")

    def parts(self, text: str | None) -> list[str]:
        """``space + text`` cut where groups always end."""
        if not text:
            return []
        return CUT.split(" " + text) if self.divisible else [" " + text]

    def look_up(self, wanted: list[str]) -> list[Part | None]:
        known = self.known
        new = [p for p in wanted if p not in known]
        if len(known) + len(new) > REMEMBERED:
            # Parts of this slice stay, and with them the common ones.
            self.known = known = {p: known[p] for p in wanted if p in known}
        at = held = 0
        for i, p in enumerate(new):
            held += 1 + len(p) // LONG_PART
            if held >= AT_ONCE or i == len(new) - 1:
                known.update(self.learn(new[at : i + 1]))
                at, held = i + 1, 0
        found = list(map(known.__getitem__, wanted))
        for p in new:
            if len(p) > LONG_PART:
                del known[p]
        return found


@cache
def aligner_for(first: str, second: str) -> Aligner:
    """One pair of tokenizers for each process; what tasks remember goes with them."""
    return Aligner(first, second)


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, … of each range, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Block:
    """Documents and records of one block until it is spilled."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.records, self.held = number, [], [], 0

    def add(self, aligner: Aligner, doc_ids: list, texts: list[str | None]) -> None:
        parts = [aligner.parts(t) for t in texts]
        wanted = list(set().union(*parts))
        found = aligner.look_up(wanted)
        bad = {p for p, x in zip(wanted, found, strict=True) if x is None}
        if bad:
            parts = [[] if not bad.isdisjoint(own) else own for own in parts]
        place = {p: i for i, p in enumerate(wanted)}
        doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        part = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, len(doc))
        found = [NONE if x is None else x for x in found]
        columns = list(zip(*found, strict=True)) or [()] * 7
        numbers = np.array(columns[:4], np.int64).reshape(4, -1).T
        counted = np.zeros((len(parts), 4), np.int64)
        for k in range(4):
            counted[:, k] = np.bincount(doc, numbers[part, k], len(parts))
        strings = dict(zip(wanted, columns[4], strict=True))
        base = len(self.docs)
        for i, (doc_id, own) in enumerate(zip(doc_ids, parts, strict=True)):
            digest = hashlib.sha256(b";".join(map(strings.__getitem__, own))).hexdigest() if own else ""
            self.docs.append((doc_id, base + i, *counted[i].tolist(), digest))
        if not len(doc):
            return
        pairs, times = (np.frombuffer(b"".join(columns[k]), "<i8") for k in (5, 6))
        sizes = np.fromiter(map(len, columns[5]), np.int64, len(found)) // 8
        starts = np.cumsum(sizes) - sizes
        # Parts of a document once each, then their pairs, then equal pairs of a document added up.
        both, n = np.unique(doc * len(wanted) + part, return_counts=True)
        at_doc, at_part = both // len(wanted), both % len(wanted)
        at = expand(starts[at_part], sizes[at_part])
        distinct, rank = np.unique(pairs, return_inverse=True)
        key = np.repeat(at_doc, sizes[at_part]) * len(distinct) + rank[at]
        weight = times[at].astype(np.int64) * np.repeat(n, sizes[at_part])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.records.append(((base + key[new] // len(distinct)).astype(np.uint32), distinct[key[new] % len(distinct)], np.add.reduceat(weight, new)))
        self.held += len(new)

    @property
    def full(self) -> bool:
        return self.held >= BLOCK_RECORDS or len(self.docs) >= BLOCK_DOCS

    def spilled(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then a row for each run: heads (pair, documents) and records (document, links)."""
        names = ["block", "doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "heads", "records"]
        kinds = [pa.int64(), kind, *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary()]
        n = len(self.docs)
        if n:
            columns = [[self.number] * n, *zip(*self.docs, strict=True), *[[None] * n] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if self.records:
            doc, pair, times = map(np.concatenate, zip(*self.records, strict=True))
            radix = (pair >> 32) % RADIXES
            order = np.lexsort((pair, radix))  # documents stay in order within a pair
            doc, pair, times, radix = doc[order], pair[order], times[order], radix[order]
            cuts = np.searchsorted(radix, np.arange(RADIXES + 1))
            rows = []
            for r in range(RADIXES):
                a, b = int(cuts[r]), int(cuts[r + 1])
                if a < b:
                    codes, held = np.unique(pair[a:b], return_counts=True)
                    rows.append((r, pack(codes, held), pack(np.arange(b - a), doc[a:b], times[a:b])))
            columns = [[self.number] * len(rows), *[[None] * len(rows)] * 7, *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def spill(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Blocks of documents and runs as a table in the shared folder."""
    kind = dict(docs.dtypes)["doc_id"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(first, second)
        at = TaskContext.get().partitionId() << 24
        block, doc_type = Block(at), None
        try:
            for batch in batches:
                names = batch.column("doc_id")
                doc_type, texts = names.type, batch.column("text")
                for a, b in slices(texts, 1 << 20):
                    block.add(aligner, names.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())
                    if block.full:
                        yield from block.spilled(doc_type)
                        block = Block(block.number + 1)
            if doc_type is not None:
                yield from block.spilled(doc_type)
        finally:
            give_back(aligner.known)

    schema = f"block bigint, doc_id {kind}, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, radix int, heads binary, records binary"
    return written(docs.select("doc_id", "text").mapInArrow(blocks, schema), "alignment-blocks")


def merge_heads(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their documents over runs, by a heap of the runs' next pairs."""
    codes: list[int] = []
    counts: list[int] = []
    last = -1
    for code, n in heapq.merge(*(zip(*(x.tolist() for x in unpack(run, 2)), strict=True) for run in runs)):
        if code == last:
            counts[-1] += n
        else:
            codes.append(code)
            counts.append(n)
            last = code
    return np.array(codes, np.int64), np.array(counts, np.int64)


def highest(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pair the highest count of its first id; pairs are in order of it."""
    owner = codes >> 32
    new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.repeat(np.maximum.reduceat(counts, new), np.diff(np.r_[new, len(codes)]))


def looked_up(heads: bytes, answer: list[np.ndarray]) -> list[np.ndarray]:
    """Pairs of a run, their documents in it, and the answers of the merged run for them."""
    codes, held = unpack(heads, 2)
    at = np.searchsorted(answer[0], codes)
    return [codes, held, answer[1][at], answer[2][at]]


def dealt(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions, "radix", "node")


def count_links(spilled: DataFrame) -> DataFrame:
    """(block, sums): for documents of a block (place, links of a highest count, counts over all links), packed, for each radix."""
    runs = spilled.where(F.col("radix").isNotNull())
    least = int(spilled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    current, levels = runs.select("radix", F.col("block").alias("member"), "heads", "records"), []
    n = runs.select("block").distinct().count()
    while True:
        nodes = max(1, -(-n // FAN_IN))
        partitions = max(least, RADIXES * nodes // 8)
        current = current.withColumn("node", F.pmod(F.xxhash64("member"), F.lit(nodes)))

        def merged(rows: pa.Table) -> pa.Table:
            codes, counts = merge_heads(rows.column("heads").to_pylist())
            answer = pack(codes, counts, highest(codes, counts))
            return pa.table([rows.column("radix").slice(0, 1), rows.column("node").slice(0, 1), pa.array([pack(codes, counts)], pa.binary()), pa.array([answer], pa.binary())], ["radix", "member", "heads", "answer"])

        # The answer is meant where one node is left; below it only the heads are read.
        above = written(dealt(current.select("radix", "node", "heads"), partitions).groupBy("radix", "node").applyInArrow(merged, "radix int, member bigint, heads binary, answer binary"), "alignment-heads")
        levels.append((current, partitions))
        if nodes == 1:
            break
        current, n = above.select("radix", "member", "heads"), nodes
    answers = above.select("radix", F.col("member").alias("node"), "answer")

    def passed(children: pa.Table, parents: pa.Table) -> pa.Table:
        out = []
        if children.num_rows:
            answer = unpack(parents.column("answer")[0].as_py(), 3)
            out = [pack(*(x for i, x in enumerate(looked_up(h, answer)) if i != 1)) for h in children.column("heads").to_pylist()]
        return pa.table([children.column("radix"), children.column("member"), pa.array(out, pa.binary())], ["radix", "node", "answer"])

    def summed(children: pa.Table, parents: pa.Table) -> pa.Table:
        blocks, out = [], []
        if children.num_rows:
            answer = unpack(parents.column("answer")[0].as_py(), 3)
            for block, heads, records in zip(*(children.column(k).to_pylist() for k in ("member", "heads", "records")), strict=True):
                _, held, count, most = looked_up(heads, answer)
                _, doc, times = unpack(records, 3)
                count, best = np.repeat(count, held) * times, np.repeat(count == most, held) * times
                order = np.argsort(doc, kind="stable")
                doc = doc[order]
                new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                blocks.append(block)
                out.append(pack(doc[new], np.add.reduceat(best[order], new), np.add.reduceat(count[order], new)))
        return pa.table([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], ["block", "sums"])

    for children, partitions in reversed(levels[1:]):
        pair = dealt(children, partitions).groupBy("radix", "node").cogroup(dealt(answers, partitions).groupBy("radix", "node"))
        answers = written(pair.applyInArrow(passed, "radix int, node bigint, answer binary"), "alignment-answers")
    children, partitions = levels[0]
    pair = dealt(children, partitions).groupBy("radix", "node").cogroup(dealt(answers, partitions).groupBy("radix", "node"))
    return pair.applyInArrow(summed, "block bigint, sums binary")


def align_documents(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document with doc_id and text.

    ``first`` is a byte-level tokenizers file, ``second`` a sentencepiece model that puts a space before texts.
    """
    spilled = spill(docs, first, second)
    kind = dict(docs.dtypes)["doc_id"]
    columns = ["doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def returned(own: pa.Table, sums: pa.Table) -> pa.Table:
        best, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64)
        place = own.column("place").to_numpy()
        rank = np.zeros(own.num_rows, np.int64)
        rank[place] = np.arange(own.num_rows)
        for blob in sums.column("sums").to_pylist():
            doc, b, t = unpack(blob, 3)
            best[rank[doc]] += b
            total[rank[doc]] += t
        out = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return out.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", own.column("groups_sha256"))

    own = spilled.where(F.col("place").isNotNull()).select("block", *columns)
    pair = own.groupBy("block").cogroup(count_links(spilled).groupBy("block"))
    return pair.applyInArrow(returned, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
