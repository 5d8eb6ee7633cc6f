"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Base kinds are patterns with a least length: ``assign``, ``access`` and ``hex``. The kind ``novel`` is measured: a
candidate is a run of 16 or more letters, digits and ``+/_=.~-`` that no base span touches and that a
sensitive word (``SENSITIVE``) precedes on its line, within ``REACH`` code points and after the span or candidate before
it; or one that follows a reported one across white space, like the lines of a key. Its marginal size is what
zstandard needs for the text around it with the candidate less what it needs without it. The compressor is primed
with a dictionary of the identifiers that occur in most documents, the commonest last, so that words of the
corpus and of the lines around cost little. Candidates that cost ``NOVEL`` of their bytes or more are incompressible,
and reported.

The dictionary counts the identifiers of all documents and keeps the commonest ``DICTIONARY_BYTES`` of them; it is all that
reaches the driver. Scanning is row by row and in whole texts; no text meets another.

Spans are in code points, the end exclusive, in order of start, then of kind as listed, then of end. A null or empty
text has none. Repeated rows get equal results. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "novel")
#: Patterns of the base kinds and least lengths (of group 2 for assign, of the match for the others).
ASSIGN, LEAST_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6
ACCESS, LEAST_ACCESS = r"AKIA[A-Z0-9]+", 20
HEX, LEAST_HEX = r"[0-9a-f]+", 24

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|(?<![a-z])(?:pwd|pass|key|auth|sig)(?![a-z])|secret|token|(?:api|access|private|signing|encryption)[ _-]?key|credential|bearer|authorization|private|signature|cookie", re.I | re.A)
REACH, AROUND, NOVEL, LEVEL = 64, 128, 0.75, 12
#: Identifiers stand alone, so that letters inside keys are none.
IDENTIFIER, DICTIONARY_BYTES = r"(?<![A-Za-z0-9+/_=~-])[A-Za-z_]{6,64}(?![A-Za-z0-9+/_=~-])", 65_536
#: Parts of the identifiers that are ranked side by side before the commonest of all are chosen.
BUCKETS = 64
#: Words before which a text cannot have a span of kind assign.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN, _ACCESS = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS)
# Whole runs of the class, so the length can stand in the pattern.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST_HEX)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base kinds, leftmost and not overlapping within a kind, that are long enough."""
    found: list[Span] = []
    small = text.lower()
    if any(w in small for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed bytes of candidates, with a dictionary of identifiers."""

    def __init__(self, identifiers: bytes, level: int = LEVEL) -> None:
        import zstandard

        settings = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if identifiers:
            settings["dict_data"] = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings["dict_data"].precompute_compress(level=level)
        self.packer = zstandard.ZstdCompressor(level=level, **settings)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode("utf-8", "replace")
        return len(self.packer.compress(around + candidate.encode())) - len(self.packer.compress(around))

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates in a sensitive place that do not compress."""
        found: list[Span] = []
        taken = sorted((a, b) for _, a, b in base)
        k = last = 0
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".=":
                end -= 1
            while k < len(taken) and taken[k][1] <= start:
                last = max(last, taken[k][1])
                k += 1
            if k < len(taken) and taken[k][0] < m.end():
                continue
            if end - start >= 16:
                before = text[max(last, start - REACH) : start]
                line = before[before.rfind("\n") + 1 :]
                follows = bool(found) and not text[found[-1][2] : start].strip(" \t\r\n.=\"'")
                if follows or SENSITIVE.search(line) or (before.endswith("\n") and "PRIVATE KEY" in before):
                    own = text[start:end]
                    if self.marginal(text[max(0, start - AROUND) : start], own, text[end : end + AROUND]) >= NOVEL * len(own):
                        found.append(("novel", start, end))
            last = max(last, end)
        return found


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers of most documents, up to ``size`` bytes, the commonest last; ties by name."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # The commonest of each bucket first: what meets for the last choice does not grow with the words or the partitions.
    order = W.partitionBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).orderBy(F.desc("n"), "word")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size // 7).orderBy(F.desc("n"), "word").limit(size // 7)
    chosen, held = [], 0
    for r in top.collect():
        held += len(r.word) + 1
        if held > size:
            break
        chosen.append(r.word)
    return " ".join(reversed(chosen)).encode()


def find_secrets(docs: DataFrame, identifiers: bytes) -> DataFrame:
    """doc_id and spans (kind, start, end) of every document with doc_id and text."""
    kind = dict(docs.dtypes)["doc_id"]
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                out = []
                for text in texts.slice(a, b - a).to_pylist():
                    base = base_spans(text) if text else []
                    spans = base + (novelty.spans(text, base) if text else [])
                    spans.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
                    out.append([{"kind": k, "start": x, "end": y} for k, x, y in spans])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(out, of)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
