"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its wire format is read here (``read_model``), and the normaliser, the
white space marker, the unigram scores or the merges of a BPE model, and byte fallback are rebuilt as a
``tokenizers.Tokenizer`` (``build``). Batches are encoded by the library's threads.

No piece joins a mark of white space to what stands before it, so a text falls apart, before each run of marks
and around line feeds, into parts that are encoded alone; each task asks the library once for each part that it
remembers, many to a line, cut again at the ids of line feeds. (``read_model`` checks the pieces; a model that has other
pieces is encoded by whole texts.) Every part that is asked for is also encoded by the sentencepiece
library, and ``part_mismatches`` counts the parts of a document whose ids differ. It does not see the normaliser and the
cuts: those are compared on whole texts in the tests, and by ``round_trip`` for every document.

A null or empty text has no ids. Repeated rows get equal results. Empty tables give no rows. Extra columns
are ignored. Characters outside the vocabulary become bytes, or the unknown id where the model has no
byte fallback. The model may be a path that each executor has, or its bytes.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Parts that a task remembers, and parts encoded at once; they bound its memory.
REMEMBERED, AT_ONCE, LONG_PART = 200_000, 8_000, 64
#: Parts asked for in one line.
LINE = 64
PART = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@dataclass
class Model:
    """What the protobuf says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def divisible(self) -> bool:
        """Whether texts may be cut before marks and around line feeds."""
        return self.kind == BPE and self.escape and not any("\n" in p or MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            out |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return out

    while at < len(blob):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        yield number, blob[at : at + size]
        at += size


def read_model(blob: bytes) -> Model:
    model = Model()
    for number, value in fields(blob):
        if number == 1:
            own = dict(fields(value))
            model.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.remove_extra, model.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs that a BPE model joins, the best score of the joined piece first."""
    known = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in known.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in known and piece[cut:] in known:
                found.append((-model.pieces[i][1], i, known[piece[:cut]], known[piece[cut:]], piece[:cut], piece[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


def normaliser(model: Model):
    """What the model does to a text before it cuts pieces."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps += [normalizers.Replace(" ", MARK)]
    if model.dummy_prefix:
        steps += [normalizers.Prepend(MARK)]
    return normalizers.Sequence(steps)


def build(model: Model, normalise: bool = True):
    """A tokenizer with the model's ids; without ``normalise`` it expects normalised parts."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
        made = Tokenizer(models.BPE(vocabulary, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback))
    defined = [AddedToken(p, normalized=True, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if defined:
        made.add_tokens(defined)
    if normalise:
        made.normalizer = normaliser(model)
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return made


class Codec:
    """Encodes and decodes texts with one model, and counts what sentencepiece encodes otherwise."""

    def __init__(self, model: bytes | str, threads: int = 1, verify: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        if isinstance(model, str):
            with open(model, "rb") as file:
                model = file.read()
        self.model = read_model(model)
        self.normal = normaliser(self.model).normalize_str
        self.tokenizer = build(self.model, normalise=not self.model.divisible)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if self.model.divisible and len(feed) == 1 else None
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.verify = None
        self.threads = threads
        if verify:
            import sentencepiece

            # A later part of a message overrides an earlier one: no dummy prefix, no white space removed.
            plain = b"\x1a\x04\x18\x00\x20\x00" if self.model.divisible else b""
            self.verify = sentencepiece.SentencePieceProcessor(model_proto=model + plain)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts by the library; parts without a line feed are asked for in lines."""
        ask = self.tokenizer.encode_batch_fast
        if self.feed is None:
            return [array("I", e.ids).tobytes() for e in ask(parts, add_special_tokens=False)]
        out: dict[str, bytes] = {"\n": struct.pack("<I", self.feed)}
        rest = [p for p in parts if p != "\n"]
        lines = [rest[at : at + LINE] for at in range(0, len(rest), LINE)]
        for line, e in zip(lines, ask(list(map("\n".join, lines)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            feeds = (4 * np.flatnonzero(ids == self.feed)).tolist()
            ids = ids.tobytes()
            out.update(zip(line, [ids[a:b] for a, b in zip([0, *(f + 4 for f in feeds)], [*feeds, len(ids)], strict=True)], strict=True))
        return list(map(out.__getitem__, parts))

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            found = self._ids(some)
            self.known.update(zip(some, found, strict=True))
            if self.verify is not None:
                checked = self.verify.encode(some, num_threads=self.threads)
                same = [4 * len(x) for x in checked] == list(map(len, found)) and array("I", chain.from_iterable(checked)).tobytes() == b"".join(found)
                if not same:
                    self.odd.update(p for p, ids, x in zip(some, found, checked, strict=True) if array("I", x).tobytes() != ids)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Ids as little-endian u32, and the number of parts that sentencepiece encodes otherwise."""
        if self.model.divisible:
            parts = [PART.findall(self.normal(t)) if t else [] for t in texts]
        else:
            parts = [[t] if t else [] for t in texts]
        wanted = set().union(*parts)
        new = [p for p in wanted if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            # Parts of these texts stay, and with them the common ones.
            self.known = {p: self.known[p] for p in wanted if p in self.known}
            self.odd &= self.known.keys()
        self._learn(new)
        known, odd = self.known, self.odd
        out = [(b"".join(map(known.__getitem__, own)), sum(p in odd for p in own) if odd else 0) for own in parts]
        for p in new:
            if len(p) > LONG_PART:
                del known[p]
                odd.discard(p)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def codec_for(model: bytes | str, threads: int = 1, verify: bool = True) -> Codec:
    """One codec for each process: tasks that follow each other in a worker share it; what they remember goes with them."""
    return Codec(model, threads, verify)


def encode_documents(docs: DataFrame, model: bytes | str, threads: int = 1, verify: bool = True) -> DataFrame:
    """doc_id, ids (little-endian u32), n_tokens, part_mismatches and round_trip of every document with doc_id and text.

    ``round_trip`` says whether decoding the ids gives the text back; models that rewrite characters or white space
    do not always.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model, threads, verify)
        try:
            for batch in batches:
                for a, b in slices(batch.column("text"), 1 << 20):
                    texts = batch.column("text").slice(a, b - a).to_pylist()
                    found = codec.encode(texts)
                    same = [codec.decode(ids) == (t or "") for (ids, _), t in zip(found, texts, strict=True)]
                    columns = [pa.array([i for i, _ in found], pa.binary()), pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(same)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "ids", "n_tokens", "part_mismatches", "round_trip"])
        finally:
            give_back(codec.known, codec.odd)

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, ids binary, n_tokens bigint, part_mismatches bigint, round_trip boolean")


def decode_documents(encoded: DataFrame, model: bytes | str) -> DataFrame:
    """doc_id and text for rows (doc_id, ids)."""
    kind = dict(encoded.dtypes)["doc_id"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model, verify=False)
        for batch in batches:
            texts = pa.array([codec.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, text string")
