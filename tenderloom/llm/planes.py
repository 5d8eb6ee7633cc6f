"""Token-id files: blocks of ids as byte or bit planes, each compressed with zstandard, with a chunk index.

Texts are dealt to ranges of doc_id, sorted, encoded and cut into blocks of ``chunk_ids`` ids; a document may
span blocks. A row of the files is one block: its range, the place of its first id in the range, the number
of ids, the payload, and the documents in it (doc_id, start in the range, all its ids, ids skipped before
this block, ids in this block). The files are Parquet, so Spark's committer makes lost tasks harmless and any
store serves; the columns besides ``payload`` are the chunk index and are read without the planes.

Payload, little-endian: ``TLPL``, version u8, bits in a plane's element u8 (8 or 1), number of planes u8, 0 u8,
number of ids u32, length of each compressed plane u32, then the planes, least significant first.

Encoding goes word by word: the tokenizer's normaliser and splitter never join what ASCII white space
separates, so equal words have equal ids and each task asks the tokenizer once for each word it remembers. Only
added tokens, like ``<|endoftext|>``, are found first; a text that spells one is encoded whole.

A null or empty text has the end id alone. Repeated rows are documents of their own, next to each other.
A null doc_id sorts first. Empty tables give files without rows. Extra columns are not stored. A text of
any length is held whole by one task; only one block waits beside it. Ranges are small, so that a batch of
texts on its way to Python is small too.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blobs_of, range_bounds, range_number, slices

CHUNK_IDS = 65_536
ROWS_A_RANGE = 2_000
MAGIC = b"TLPL"
#: Words that a task remembers, and words encoded at once; they bound its memory.
REMEMBERED, AT_ONCE = 400_000, 16_000
#: Marks that end a word, after a letter.
MARKED = re.compile(rb"[.,;:!?*&%$#|\"'()-](?<=[a-z].)[.,;:!?*&%$#|\"'()-]*(?![^\x20\x09-\x0D])")


class WordEncoder:
    """Ids of texts as little-endian u32, by a tokenizers file whose words are separated by white space.

    Where the file marks ends of words, lower-cases, and splits letters from marks, texts are cut between a
    letter and the marks that end a word as well, and lower-case words of letters are encoded many at a time,
    past the normaliser and splitter that would not change them. ``_short_cut`` tries this on samples.
    """

    def __init__(self, path: str, end_id: int | None = None) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens cross white space and marks: texts that spell one are encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.encode() for a in added for t in {a, a.lower()}]
        self.plain = Tokenizer(self.tokenizer.model)  # one model in memory for both
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.known: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.short = bool(suffix)
        self.short = self.short and self._short_cut()

    def _short_cut(self) -> bool:
        samples = ["Abc", "word.", "été***", "ÜBER!!", "straße,", "don't.", "x", "a'", "naïve)", "e\u0301t", "ab12%%", "ñ&&&", "日本。", "'s'", "A.b.C!"]
        shorter = self([x.encode() for x in samples])
        self.known.clear()
        return shorter == [ids + self.end for ids in self._whole(samples)]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        rest = new
        if self.short:
            letters = [w for w in new if w.isalpha()]
            rest = []
            for word in [w for w in new if not w.isalpha()]:
                text = word.decode("utf-8", "replace")
                (letters if text.isalpha() and text == text.lower() and is_normalized("NFC", text) else rest).append(word)
            lines = [b" ".join(letters[at : at + 64]).decode() for at in range(0, len(letters), 64)]
            found = self.plain.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            ids = ids.tobytes()
            self.known.update(zip(letters, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        self.known.update(zip(rest, self._whole([w.decode("utf-8", "replace") for w in rest]), strict=True))

    def __call__(self, blobs: list[bytes | None]) -> list[bytes]:
        known = self.known
        texts = [(b or b"").lower() if self.short else b or b"" for b in blobs]
        whole = {i for t in self.added for i, b in enumerate(texts) if t in b}
        for i in whole:
            texts[i] = b""
        words = [MARKED.sub(rb" \g<0>", b).split() for b in texts] if self.short else [b.split() for b in texts]
        own_words = set().union(*words)
        new = [w for w in own_words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            # Words of this slice stay, and with them the common ones.
            self.known = known = {w: known[w] for w in own_words if w in known}
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])
        out = [b"".join(map(known.__getitem__, own)) + self.end for own in words]
        for i in whole:
            out[i] = self._whole([blobs[i].decode("utf-8", "replace")])[0] + self.end
        return out


@cache
def encoder_for(path: str, end_id: int | None = None) -> WordEncoder:
    """One encoder for each process: tasks that follow each other in a worker share it and its words."""
    return WordEncoder(path, end_id)


def pack_planes(ids: np.ndarray, bits: int = 8, level: int = 3) -> bytes:
    """One block of unsigned 32-bit ids as compressed planes."""
    import zstandard

    used = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if bits == 8:
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)[: -(-used // 8)]
    else:
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)) for k in range(used)]
    packer = zstandard.ZstdCompressor(level=level)
    packed = [packer.compress(p.tobytes()) for p in planes]
    head = MAGIC + struct.pack("<BBBBI", 1, bits, len(packed), 0, len(ids)) + b"".join(struct.pack("<I", len(p)) for p in packed)
    return head + b"".join(packed)


def unpack_planes(payload: bytes) -> np.ndarray:
    """The ids of a block."""
    import zstandard

    if payload[:4] != MAGIC:
        raise ValueError("not a block of planes")
    _, bits, planes, _, n = struct.unpack_from("<BBBBI", payload, 4)
    lengths = struct.unpack_from(f"<{planes}I", payload, 12)
    at, unpacker, ids = 12 + 4 * planes, zstandard.ZstdDecompressor(), np.zeros(n, "<u4")
    cells = ids.view(np.uint8).reshape(-1, 4)
    for k, length in enumerate(lengths):
        plane = np.frombuffer(unpacker.decompress(payload[at : at + length]), np.uint8)
        if bits == 8:
            cells[:, k] = plane
        else:
            ids |= np.unpackbits(plane, count=n).astype("<u4") << np.uint32(k)
        at += length
    return ids


def write_ids(docs: DataFrame, path: str, encoder: Callable[[], Callable[[list[bytes | None]], list[bytes]]], chunk_ids: int = CHUNK_IDS, bits: int = 8, level: int = 3) -> None:
    """Encode rows (doc_id, text) in ascending doc_id order to block files under ``path``."""
    kind = dict(docs.dtypes)["doc_id"]
    bounds, n_ranges = range_bounds(docs.select("doc_id"), ROWS_A_RANGE)
    dealt = docs.select(range_number(F.col("doc_id"), bounds).alias("range"), "doc_id", "text")
    dealt = dealt.repartitionById(n_ranges, "range").sortWithinPartitions("range", "doc_id", F.xxhash64("text"))
    entry = f"struct<doc_id:{kind},start:bigint,n_tokens:bigint,skip:bigint,n:bigint>"
    schema = f"range int, first bigint, n_ids bigint, payload binary, docs array<{entry}>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        current, first, start, held, waiting, entries = None, 0, 0, 0, [], []
        doc_type = None

        def flush() -> pa.RecordBatch:
            nonlocal first, held, waiting, entries
            ids = np.frombuffer(b"".join(waiting), "<u4")
            of = pa.struct([("doc_id", doc_type), *((k, pa.int64()) for k in ("start", "n_tokens", "skip", "n"))])
            row = pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_planes(ids, bits, level)], pa.binary()), pa.array([entries], pa.list_(of))],
                ["range", "first", "n_ids", "payload", "docs"],
            )
            first, held, waiting, entries = first + held, 0, [], []
            return row

        for batch in batches:
            ranges, names = batch.column("range").to_pylist(), batch.column("doc_id")
            doc_type, names = names.type, names.to_pylist()
            for a, b in slices(batch.column("text")):
                for at, doc_id, ids in zip(ranges[a:b], names[a:b], encode(blobs_of(batch.column("text").slice(a, b - a))), strict=True):
                    if at != current:
                        if held:
                            yield flush()
                        current, first, start = at, 0, 0
                    total, skip = len(ids) // 4, 0
                    while skip < total:
                        n = min(total - skip, chunk_ids - held)
                        waiting.append(ids[4 * skip : 4 * (skip + n)])
                        entries.append({"doc_id": doc_id, "start": start, "n_tokens": total, "skip": skip, "n": n})
                        held, skip = held + n, skip + n
                        if held == chunk_ids:
                            yield flush()
                    start += total
        if held:
            yield flush()

    # The payload is compressed already.
    dealt.mapInArrow(packed, schema).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: all columns but the planes, and ``base``, the ids of all ranges before."""
    chunks = spark.read.parquet(path)
    sums = chunks.groupBy("range").agg(F.sum("n_ids").alias("range_ids"))  # one row per range, MOST_RANGES at most
    bases = sums.select("range", (F.sum("range_ids").over(W.orderBy("range")) - F.col("range_ids")).alias("base"))
    return chunks.join(bases, "range")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian u32) of every document in the files.

    Documents inside one block, all but about one a block, pass without a shuffle.
    """
    chunks = read_index(spark, path)
    kind = chunks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def parts(whole: bool) -> DataFrame:
        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_type = batch.schema.field("docs").type.value_type.field("doc_id").type
                for base, first, payload, docs in zip(*(batch.column(k).to_pylist() for k in ("base", "first", "payload", "docs")), strict=True):
                    ids, out, at = None, [], 0
                    for d in docs:
                        if (d["n"] == d["n_tokens"]) == whole:
                            ids = unpack_planes(payload).tobytes() if ids is None else ids
                            out.append((d["doc_id"], base + d["start"], d["n_tokens"], d["skip"], ids[4 * at : 4 * (at + d["n"])]))
                        at += d["n"]
                    if out:
                        kinds = (doc_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "skip", "ids"])

        return chunks.select("base", "first", "payload", "docs").mapInArrow(decoded, f"doc_id {kind}, start bigint, n_tokens bigint, skip bigint, ids binary")

    @F.pandas_udf("binary")
    def joined(lists):
        return lists.map(b"".join)

    gathered = parts(False).groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("skip", "ids"))).alias("parts"))
    return parts(True).drop("skip").unionByName(gathered.select("doc_id", "start", "n_tokens", joined(F.col("parts.ids")).alias("ids")))
