"""Line dedup: lines that many documents share go, except in the largest doc_id that has them.

Lines are exploded, normalised and hashed (two 64-bit hashes); the distinct documents of every hash are
counted with partial aggregates, so a line in a third of all documents is no hot key; lines over the
threshold are joined back by hash and the documents reassembled by position. Only hashes and positions
move, and each text once, to meet its positions.

A null or empty text is one empty line. Repeated rows with one doc_id count as one document and lose the
same lines. A null doc_id counts as no document and keeps no shared line. A document may lose all lines;
its text is then empty. Empty tables give no rows. Input columns are nested under ``row``, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def dedupe_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``row`` (all input columns), n_lines, n_dropped and kept_text for every document with doc_id and text."""
    whole = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = (
        whole.select(F.col("row.doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
        .hint("shuffle_hash")
    )
    at = whole.withColumn("text_hash", F.xxhash64(text)).alias("at")
    met = at.join(dropped.alias("d"), F.col("at.row.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("at.text_hash") == F.col("d.text_hash")), "left")
    split = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    return met.select(
        "row",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda p: F.element_at(split, p + 1)), "\n")).alias("kept_text"),
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs
),
keyed AS (
  SELECT doc_id, text, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(s.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN s.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key AND k.doc_id IS DISTINCT FROM s.keeper
GROUP BY k.doc_id, k.text
"""
