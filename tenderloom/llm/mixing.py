"""Mixing sources to target weights: blocks of equal words, given to sources by Sainte-Lague.

Sources, in the order of their code points with null last, weigh ``weights`` in turn and share all words;
no target exceeds ``most`` times its source, the excess goes to the others by weight. The mix has
round(words / block) blocks; highest quotients target / (2 s + 1) give every source its number of blocks.
A source's documents lie in shards by a seeded hash; the same rule gives each shard its blocks. Inside a
shard the documents, in seeded order, form one run of words cut into blocks. A shard takes all its blocks
as often as its quota allows, and the rest of the quota as blocks chosen by a seeded permutation; a
document gives the words of its that lie in them. Rounding is within a few blocks of a source's target.

Reruns agree, whatever the partitioning. Null and empty texts have size 0 and give nothing. Equal rows are
interchangeable. A source without words has target 0. Empty tables give no rows. Input columns are nested
under ``row``, so no name clashes.

A source that holds a third of all rows is spread over its shards. Windows without a key run over one row
per source, windows by source over a few rows per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
SHARD_DOCS = 2_000
SEED = "mix-1"
#: Larger than any number of blocks in a shard, and prime, so multiplying by it permutes block numbers.
STRIDE = 2_147_483_647


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds source_rank, weight and target to rows (source, source_size).

    With sources in the order of cap / weight, capping the first k leaves the level
    (all - caps) / weights left to the rest; the level rises while capping is due and falls after, so
    the largest level is the one where no target is above its cap.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    by_cap = W.orderBy((F.col("cap") / F.col("weight")).asc(), "source_rank")
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        ranked.withColumn("caps_before", F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", F.max((F.col("all_words") - F.col("caps_before")) / F.col("weights_left")).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return levels.withColumn("target", target).drop("cap", "caps_before", "weights_left", "level")


def apportion(rows: DataFrame, key: str, weight: str, seats: str, group: str) -> DataFrame:
    """``group``, ``key`` and quota: the seats of a group dealt by Sainte-Lague to its keys.

    With n keys of total weight W, the common divisor lies between W / (S + n/2) and W / (S - n/2). So a key
    surely has the seats below its lower bound, and only the quotients up to its upper bound, about two for
    each key, have to be ranked.
    """
    whole = W.partitionBy(group)
    bounded = (
        rows.select(group, key, F.col(weight).cast("double").alias("w"), F.col(seats).alias("s"))
        .withColumn("total", F.sum("w").over(whole))
        .withColumn("half", F.count("*").over(whole) / 2)
        .withColumn("low", F.when(F.col("total") > 0, F.greatest(F.lit(0), F.floor(F.col("w") * (F.col("s") - F.col("half")) / F.col("total") - 0.5))).otherwise(0).cast("long"))
        .withColumn("high", F.when(F.col("total") > 0, F.floor(F.col("w") * (F.col("s") + F.col("half")) / F.col("total") + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("left", F.col("s") - F.sum("low").over(whole))
    )
    dealt = (
        bounded.withColumn("seat", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))))
        .withColumn("place", F.row_number().over(whole.orderBy((F.col("w") / (2 * F.col("seat") + 1)).desc_nulls_last(), key, "seat")))
        .withColumn("won", F.col("seat").isNotNull() & (F.col("place") <= F.col("left")))
    )
    return dealt.groupBy(group, key).agg((F.first("low") + F.sum(F.col("won").cast("long"))).alias("quota"))


def _number(text: Column) -> Column:
    """A repeatable number of 32 bits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, size: Column, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``row``, size, source_size, target, passes, excerpts and taken for rows with doc_id and source.

    ``passes`` whole copies of a document and the word ranges ``excerpts`` (start, end) of it are in the mix.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), size.alias("size")).withColumns({"source": F.col("row.source"), "order": order})
    narrow = rows.select("source", "order", "size")
    summed = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aimed = targets(summed, weights, most).withColumns(
        {"n_shards": F.ceil(F.col("n_docs") / shard_docs), "seats": F.floor(F.col("all_words") / block + 0.5).cast("long"), "everything": F.lit(0)}
    )
    aimed = written(aimed, "mix-targets")
    quotas = apportion(aimed, "source_rank", "target", "seats", "everything").select("source_rank", F.col("quota").alias("source_quota"))
    sources = written(aimed.join(quotas, "source_rank").select("source", "source_rank", "source_size", "target", "n_shards", "source_quota"), "mix-sources")

    def sharded(df: DataFrame) -> DataFrame:
        met = df.alias("d").join(sources.withColumnRenamed("source", "own"), F.col("d.source").eqNullSafe(F.col("own"))).drop("own")
        return met.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("n_shards"))

    sums = sharded(narrow).groupBy("source_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    sums = written(sums, "mix-sums")
    dealt = apportion(sums, "shard", "shard_size", "source_quota", "source_rank")
    n = F.ceil(F.col("shard_size") / block)
    shards = dealt.join(sums, ["source_rank", "shard"]).select(
        "source_rank", "shard", n.alias("n_blocks"), F.least(F.col("quota"), most * n).alias("quota"),
        _number(F.concat_ws(":", F.lit(seed), F.col("source_rank").cast("string"), F.col("shard").cast("string"))).alias("shift"),
    )
    shards = written(shards, "mix-shards")
    # Rows of one doc_id and size are told apart by what they hold.
    hashed = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    ahead = W.partitionBy("source_rank", "shard").orderBy("order", "row.doc_id", "size", F.xxhash64(*hashed)).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sharded(rows).withColumn("end", F.sum("size").over(ahead)).join(shards, ["source_rank", "shard"])
    start, end, blocks = F.col("end") - F.col("size"), F.col("end"), F.col("n_blocks")
    chosen = lambda b: (b * STRIDE + F.col("shift")) % blocks < F.col("quota") % blocks
    own = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    cut = lambda b: F.struct((F.greatest(start, b * block) - start).alias("start"), (F.least(end, (b + 1) * block) - start).alias("end"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return placed.select(
        "row", "size", "source_size", "target",
        F.when(blocks > 0, F.floor(F.col("quota") / blocks)).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("size") > 0, F.transform(F.filter(own, chosen), cut)).otherwise(none).alias("excerpts"),
    ).withColumn("taken", F.col("passes") * F.col("size") + F.aggregate("excerpts", F.lit(0).cast("long"), lambda t, e: t + e["end"] - e["start"]))


def mixed_texts(mixed: DataFrame, name: str = "mixed_text") -> DataFrame:
    """``row`` and a text for every copy and every non-empty excerpt of a document that the mix takes."""
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = F.flatten(F.transform("excerpts", lambda e: F.slice(pieces, (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int"))))
    excerpt = F.when(F.size("excerpts") > 0, F.array(F.array_join(cut, ""))).otherwise(F.array().cast("array<string>"))
    copies = F.array_repeat(F.col("row.text"), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("int"))
    return mixed.select("row", F.explode(F.concat(copies, excerpt)).alias(name))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents
),
summed AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, ceil(count(*) / {SHARD_DOCS})::BIGINT AS n_shards FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank, {MOST} * source_size AS cap FROM summed),
weighed AS (SELECT *, list_extract([{', '.join(map(str, WEIGHTS))}], (source_rank - 1) % {len(WEIGHTS)} + 1) AS weight FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER () AS all_words,
    (sum(source_size) OVER () - (sum(cap) OVER up - cap))::DOUBLE / (sum(weight) OVER down)::DOUBLE AS level
  FROM weighed
  WINDOW up AS (ORDER BY cap::DOUBLE / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    down AS (ORDER BY cap::DOUBLE / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
aimed AS (
  SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target, floor(all_words::DOUBLE / {BLOCK} + 0.5)::BIGINT AS seats FROM levels
),
source_quotients AS (
  SELECT source_rank, seats, target / (2 * s + 1) AS quotient, s
  FROM aimed, LATERAL (SELECT unnest(range(CASE WHEN target > 0 THEN ceil(target / {BLOCK})::BIGINT + 2 + (SELECT count(*) FROM aimed) ELSE 0 END)) AS s)
),
source_quotas AS (
  SELECT source_rank, count(*) AS source_quota
  FROM (SELECT source_rank, seats, row_number() OVER (ORDER BY quotient DESC, source_rank, s) AS place FROM source_quotients) WHERE place <= seats GROUP BY source_rank
),
sharded AS (
  SELECT d.*, a.source_rank, a.source_size, a.target, coalesce(q.source_quota, 0) AS source_quota, ('0x' || substr(ord, 1, 8))::BIGINT % n_shards AS shard
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN source_quotas q USING (source_rank)
),
sums AS (
  SELECT source_rank, shard, any_value(source_quota) AS source_quota, sum(size)::BIGINT AS shard_size, ceil(sum(size)::DOUBLE / {BLOCK})::BIGINT AS n_blocks,
    ('0x' || substr(md5('{SEED}:' || source_rank::VARCHAR || ':' || shard::VARCHAR), 1, 8))::BIGINT AS shift
  FROM sharded GROUP BY source_rank, shard
),
shares AS (SELECT *, source_quota * shard_size::DOUBLE / sum(shard_size) OVER (PARTITION BY source_rank) AS share, count(*) OVER (PARTITION BY source_rank) AS n FROM sums),
shard_quotients AS (
  SELECT source_rank, shard, source_quota, shard_size::DOUBLE / (2 * s + 1) AS quotient, s
  FROM shares, LATERAL (SELECT unnest(range(CASE WHEN shard_size > 0 THEN ceil(share)::BIGINT + 2 + n ELSE 0 END)) AS s)
),
shard_quotas AS (
  SELECT source_rank, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY quotient DESC, shard, s) AS place FROM shard_quotients) WHERE place <= source_quota
  GROUP BY source_rank, shard
),
placed AS (
  SELECT d.*, s.n_blocks, s.shift, least(coalesce(q.quota, 0), {MOST} * s.n_blocks) AS quota,
    sum(size) OVER (PARTITION BY source_rank, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
  FROM sharded d JOIN sums s USING (source_rank, shard) LEFT JOIN shard_quotas q USING (source_rank, shard)
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN (quota // n_blocks) * size + coalesce(list_sum([
    greatest(0, least(stop, (b + 1) * {BLOCK}) - greatest(stop - size, b * {BLOCK}))
    FOR b IN range((stop - size) // {BLOCK}, (stop - 1) // {BLOCK} + 1) IF (b * {STRIDE} + shift) % n_blocks < quota % n_blocks
  ]), 0) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
