"""Company names: normalising, similarity, debarment screening.

The similarity ratio is a Python function over Arrow batches.  It only ever sees
candidate pairs; candidates come from blocks of names that meet on rare letter pairs,
which provably keeps every pair above the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.bidtext import normalise_company
from ..functions.common import let


def similarity_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff/Obershelp ratio of two text columns; null when either is null."""

    # A local function travels with the job, so executors need not have this package.
    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left.tolist(), right.tolist())
        scores = [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs]
        return pd.Series(scores, dtype="float64")

    return ratio(a, b)


def match_entity(rows: DataFrame, registered: str, extracted: str, threshold: float = P.NAME_MATCH_THRESHOLD) -> DataFrame:
    """Add similarity_score, is_match, mismatch_type and requires_review for two name columns."""
    a, b = F.col("_na"), F.col("_nb")
    named = rows.withColumn("_na", normalise_company(F.col(registered))).withColumn("_nb", normalise_company(F.col(extracted)))
    # Equal names send nulls to Python, which returns at once.
    scored = named.withColumn("_s", similarity_ratio(F.when(a != b, a), F.when(a != b, b)))
    score = F.coalesce(F.col("_s"), F.lit(1.0))
    scored = scored.withColumn("similarity_score", score)
    hit = F.col("similarity_score") >= threshold
    kind = (
        F.when(a == b, F.lit(None).cast("string"))
        .when(hit, "abbreviation")
        .when(F.contains(a, b) | F.contains(b, a), "parent_company")
        .otherwise("different_entity")
    )
    return (
        scored.withColumn("is_match", hit).withColumn("mismatch_type", kind).withColumn("requires_review", ~hit).drop("_na", "_nb", "_s")
    )


def needs_disambiguation(registered: Column, extracted: Column, score: Column) -> Column:
    return (score < 1.0) & (F.length(extracted) > 0) & (F.lower(extracted) != F.lower(registered))


#: Shared pairs that two names must have among their rare ones before their letters are compared.
SHARED_RARE = 4
#: Names of a block on either side, at most; the left side is cut further, so that every task has a share, but not below ``LEFT_SHARE`` names.
LEFT_BLOCK, RIGHT_BLOCK, LEFT_SHARE = 65536, 65536, 16384


def _spelling(names: DataFrame) -> DataFrame:
    """Distinct names of two letters or more."""
    return names.select("name").distinct().where(F.length("name") >= 2)


def similar_name_candidates(left: DataFrame, right: DataFrame, threshold: float = P.NAME_MATCH_THRESHOLD, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Pairs (a, b) of different names that may reach the threshold; none that does is missing.

    With S = len(a) + len(b), a ratio >= t needs M = t*S/2 matched letters or more, in the same order in both names.
    Matched blocks are separated by at most S - 2M unmatched letters, so there are at most S - 2M + 1 blocks, and
    T = 3M - S - 1 letter pairs lie inside blocks, at places that differ by the unmatched letters of one name at most. Sort
    the pairs of a name by one order, rare ones first: the first c of the T common ones are among the first (all - T + c)
    of either name. So names meet on their rare pairs near the same place only, and of those that meet c times the longest
    common subsequence decides; the common pairs of trade words are not looked at.

    Both sides are cut into blocks of bounded size, and a task counts the meetings of two blocks, names of two
    lengths at a time, so that names which meet once are never written. ``keep`` may write the names, which are read several times.
    """
    if 1.5 * threshold - 1.0 <= 0.0:
        raise ValueError("below two thirds two names of any length may match without a common letter pair")
    shared_rare = SHARED_RARE
    SET_BITS, KEYS_AT_ONCE, NAMES_IN_SET = 1 << 19, 1 << 17, 1 << 13
    a, b = keep(_spelling(left)), keep(_spelling(right))
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda rows, most: rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("bigint").alias("n"))
    whole, fine = cut(a, LEFT_BLOCK), cut(a, LEFT_SHARE)
    counts = whole.select(F.greatest("n", F.least(fine.scalar(), F.lit(partitions))).cast("bigint").alias("_ls")).crossJoin(cut(b, RIGHT_BLOCK).withColumnRenamed("n", "_rs"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("name"), F.col(f"{own}s"))
        return rows.crossJoin(counts).select("name", block.alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)).alias(other))

    # A local function travels with the job, so executors need not have this package.
    def meet(l: pa.Table, r: pa.Table) -> pa.Table:
        names_l, names_r = (np.array(x["name"].to_pylist(), dtype=object) for x in (l, r))
        found_a, found_b = [], []
        done = lambda: pa.table({"a": pa.array(found_a, pa.string()), "b": pa.array(found_b, pa.string())})
        if not len(names_l) or not len(names_r):
            return done()

        def by_length(names: np.ndarray) -> dict:
            """Names of each length and a matrix of their letters."""
            sizes = np.array([len(x) for x in names])
            out = {}
            for n in np.unique(sizes).tolist():
                own = names[sizes == n]
                out[n] = own, np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(own), n)
            return out

        left, right = by_length(names_l), by_length(names_r)
        # Pairs are numbered from 1 by how often the right side has them, rare ones first; 0 is a pair that it has not.
        pair_codes = lambda letters: letters[:, :-1] << 21 | letters[:, 1:]
        known, times = np.unique(np.concatenate([pair_codes(m).ravel() for _, m in right.values()]), return_counts=True)
        number = np.empty(len(known), np.int64)
        number[np.argsort(times, kind="stable")] = np.arange(1, len(known) + 1)
        longest = max(max(left), max(right))
        width = 4 * longest  # places stand in the second quarter, so that a reach beyond an end meets nothing

        def ranked(letters: np.ndarray) -> np.ndarray:
            """Pairs with their places in one number, rare ones first."""
            codes = pair_codes(letters)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            return np.sort(np.where(known[at] == codes, number[at], 0) * width + longest + np.arange(codes.shape[1]), axis=1)

        def near(keys: np.ndarray, others: np.ndarray, back: int, ahead: int, least: int):
            """Rows of keys and of the other side's that share pairs within reach, ``least`` times or more.

            A pair and place of the left side becomes a set of names, one bit each; sets are added in binary, up to four.
            """
            order = np.argsort(others, axis=None, kind="stable")
            owners, placed = order // others.shape[1], others.ravel()[order]
            words = -(-len(others) // 64)
            rows_at_once = max(1, SET_BITS // (64 * words))
            step = max(1, KEYS_AT_ONCE // keys.shape[1])
            for start in range(0, len(keys), step):
                asked, row_sets = np.unique(keys[start : start + step], return_inverse=True)
                row_sets = row_sets.reshape(-1, keys.shape[1]).T
                lo = np.searchsorted(placed, asked - back, "left")
                met = np.where(asked >= width, np.searchsorted(placed, asked + ahead, "right") - lo, 0)
                sets = np.empty((len(asked), words), np.uint64)
                for at in range(0, len(asked), 512):
                    n = met[at : at + 512]
                    ends = np.cumsum(n)
                    members = owners[np.repeat(lo[at : at + 512] - (ends - n), n) + np.arange(ends[-1])]
                    marks = np.zeros((len(n), 64 * words), np.uint8)
                    marks.ravel()[members + np.repeat(np.arange(len(n)) * (64 * words), n)] = 1
                    sets[at : at + 512] = np.packbits(marks, axis=1, bitorder="little").view(np.uint64)
                for at in range(0, row_sets.shape[1], rows_at_once):
                    chosen = row_sets[:, at : at + rows_at_once]
                    ones, twos, fours = (np.zeros((chosen.shape[1], words), np.uint64) for _ in range(3))
                    one, carry = np.empty_like(ones), np.empty_like(ones)
                    for column in chosen:
                        np.take(sets, column, axis=0, out=one, mode="clip")
                        np.bitwise_and(ones, one, out=carry)
                        ones ^= one
                        np.bitwise_and(twos, carry, out=one)
                        twos ^= carry
                        fours |= one
                    enough = (fours | twos | ones, fours | twos, fours | twos & ones, fours)[least - 1].ravel()
                    hit = np.flatnonzero(enough)
                    if len(hit):
                        bit = np.flatnonzero(np.unpackbits(enough[hit].view(np.uint8), bitorder="little").view(bool))
                        word = hit[bit >> 6]
                        yield start + at + word // words, word % words * 64 + (bit & 63)

        def every(rows: int, many: int):
            step = max(1, 500_000 // many)
            for start in range(0, rows, step):
                size = min(step, rows - start)
                yield np.repeat(np.arange(start, start + size), many), np.tile(np.arange(many), size)

        def gathered(parts):
            """Pairs of rows in parts that are worth a call and stay in a core's cache."""
            size = 1 << 15
            waiting = [np.zeros(0, np.int64)] * 2
            for part in parts:
                waiting = [np.concatenate(x) for x in zip(waiting, part)]
                while len(waiting[0]) > size:
                    yield tuple(x[:size] for x in waiting)
                    waiting = [x[size:] for x in waiting]
            if len(waiting[0]):
                yield tuple(waiting)

        def letter_bits(letters: np.ndarray) -> np.ndarray:
            """The places of each letter in a name as bits; letters that share a remainder count as equal."""
            bits = np.zeros((len(letters), 64), np.uint64)
            for at in range(letters.shape[1]):
                bits[np.arange(len(letters)), letters[:, at] % 64] |= np.uint64(1 << at)
            return bits.ravel()

        def alike(bits: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, la: int, matched: int) -> tuple[np.ndarray, np.ndarray]:
            """Those of the pairs whose names have a common subsequence of so many letters, within reach of each other."""
            lb, full = len(columns), (1 << la) - 1
            back, ahead = lb - matched, la - matched
            free, base = np.full(len(i), 2**64 - 1, np.uint64), i * 64
            for at in range(lb):
                reach = (((1 << (ahead + at + 1)) - 1) & ~((1 << max(0, at - back)) - 1)) & full
                hit = np.take(bits, base + np.take(columns[at], j))
                hit &= np.uint64(reach)
                hit &= free
                rest = free - hit
                free += hit
                free |= rest
                if at % 4 == 3 or at == lb - 1:
                    still = np.flatnonzero(np.bitwise_count(~free & np.uint64(full)) >= matched - (lb - 1 - at))
                    if at == lb - 1 or len(still) < 0.7 * len(i):
                        i, j, free, base = i[still], j[still], free[still], base[still]
                    if not len(i):
                        break
            return i, j

        def alike_long(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray, matched: int) -> tuple[np.ndarray, np.ndarray]:
            """The same for names of 64 letters or more."""
            n, kept_rows = one.shape[1], []
            for x, y in zip(one[i].tolist(), two[j].tolist()):
                bits: dict = {}
                for at, letter in enumerate(x):
                    bits[letter] = bits.get(letter, 0) | 1 << at
                free = full = (1 << n) - 1
                for letter in y:
                    hit = free & bits.get(letter, 0)
                    free = (free + hit | free - hit) & full
                kept_rows.append(n - free.bit_count() >= matched)
            return i[kept_rows], j[kept_rows]

        pairs_r = {n: ranked(m) for n, (_, m) in right.items()}
        columns_r = {n: np.ascontiguousarray((m.T % 64).astype(np.uint8)) for n, (_, m) in right.items()}
        for la, (own, letters) in left.items():
            pairs, bits = ranked(letters), letter_bits(letters) if la < 64 else None
            for lb, (others, other_letters) in right.items():
                total = la + lb
                matched = math.ceil(total * threshold / 2.0 - 1e-9)
                # Names of which every letter is matched are equal.
                if matched > min(la, lb) or matched == la == lb:
                    continue
                inside = 3 * matched - total - 1
                least = min(shared_rare, inside)
                for start in range(0, len(others), NAMES_IN_SET):
                    names, some = others[start : start + NAMES_IN_SET], other_letters[start : start + NAMES_IN_SET]
                    if inside < 1:
                        chosen = every(len(own), len(names))
                    else:
                        keys, theirs = pairs[:, : la - 1 - inside + least], pairs_r[lb][start : start + NAMES_IN_SET, : lb - 1 - inside + least]
                        chosen = near(keys, theirs, la - matched, lb - matched, least)
                    for i, j in gathered(chosen):
                        if bits is None:
                            i, j = alike_long(letters, some, i, j, matched)
                        else:
                            i, j = alike(bits, columns_r[lb][:, start : start + NAMES_IN_SET], i, j, la, matched)
                        differ = [(x, y) for x, y in zip(own[i].tolist(), names[j].tolist()) if x != y]
                        found_a.extend(x for x, _ in differ)
                        found_b.extend(y for _, y in differ)
        return done()

    l, r = dealt(a, "_l", "_r"), dealt(b, "_r", "_l")
    return l.groupBy("_l", "_r").cogroup(r.groupBy("_l", "_r")).applyInArrow(meet, "a string, b string")


def similar_names(left: DataFrame, right: DataFrame, threshold: float = P.NAME_MATCH_THRESHOLD, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """All pairs of different names with a ratio of at least the threshold."""
    pairs = similar_name_candidates(left, right, threshold, keep)
    return pairs.withColumn("score", similarity_ratio("a", "b")).where(F.col("score") >= threshold)


def debarment_matches(bidders: DataFrame, debarred: DataFrame, threshold: float = P.NAME_MATCH_THRESHOLD, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(bidder, entry, method) rows.  A PAN hit ends the search; else equal or similar names.

    Names are compared once per distinct spelling, whatever the number of bidders behind it.
    """
    bids = bidders.select("bidder_id", "pan_number", normalise_company(F.col("company_name")).alias("name"))
    entries = debarred.select("entry_id", "pan_number", normalise_company(F.col("entity_name")).alias("name"))
    pan = bids.join(entries.select("entry_id", "pan_number"), "pan_number").select("bidder_id", "entry_id", F.lit("pan_match").alias("check_method"))
    rest = bids.join(pan.select("bidder_id").distinct(), "bidder_id", "left_anti")
    same = rest.select(F.col("name").alias("a")).distinct().withColumn("b", F.col("a"))
    links = similar_names(rest, entries, threshold, keep).select("a", "b").unionByName(same)
    by_name = (
        links.join(entries.select("entry_id", F.col("name").alias("b")), "b")
        .join(rest.select("bidder_id", F.col("name").alias("a")), "a")
        .select("bidder_id", "entry_id", F.lit("name_match").alias("check_method"))
    )
    return pan.unionByName(by_name)


def debarment_check(bidders: DataFrame, matches: DataFrame) -> DataFrame:
    """Every bidder with is_debarred, method, number of matches and the first entry."""
    found = matches.groupBy("bidder_id").agg(
        F.min("check_method").alias("check_method"), F.count(F.lit(1)).alias("match_count"), F.min("entry_id").alias("first_entry")
    )
    out = bidders.select("tender_id", "bidder_id", "company_name").join(found, "bidder_id", "left").na.fill(0, ["match_count"])
    return out.withColumn("is_debarred", F.col("match_count") > 0).withColumn("check_method", F.coalesce("check_method", F.lit("clear")))


def debarment_report(checked: DataFrame) -> DataFrame:
    """Bidders checked, flagged and clear per tender; the names stay in the checked rows."""
    return checked.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("is_debarred").alias("flagged"), F.count_if(~F.col("is_debarred")).alias("clear")
    )


def bidder_debarment(bidders: DataFrame, checked: DataFrame, debarred: DataFrame) -> DataFrame:
    """Stored status of a bidder with its first matching entry when flagged."""
    first = checked.select("bidder_id", F.col("first_entry").alias("entry_id"), "match_count")
    entries = debarred.select("entry_id", F.col("entity_name").alias("matched_entity"), "reason")
    out = bidders.select("bidder_id", "company_name", F.col("debarment_status").alias("status")).join(first, "bidder_id", "left").join(entries, "entry_id", "left")
    flagged = F.col("status") == "flagged"
    return out.select(
        "bidder_id", "company_name", "status", F.when(flagged, F.col("matched_entity")).alias("matched_entity"),
        F.when(flagged, F.col("reason")).alias("reason"), F.when(flagged, F.coalesce("match_count", F.lit(0))).alias("match_count"),
    )


def mark_bidders(bidders: DataFrame, checked: DataFrame) -> DataFrame:
    """New bidder states after screening and evaluation."""
    rows = bidders.drop("debarment_status").join(checked.select("bidder_id", "is_debarred"), "bidder_id")
    return rows.withColumn("debarment_status", F.when(F.col("is_debarred"), "flagged").otherwise("clear")).withColumn(
        "status", F.when((F.col("status") == "excluded") | F.col("is_debarred"), "excluded").otherwise("evaluated")
    ).drop("is_debarred")


def entity_consensus(rows: DataFrame) -> DataFrame:
    """Combine the name comparison with a recorded model opinion (classification, fraud_risk, model_confidence)."""
    from .branches import consensus_confidence

    kind = F.coalesce(F.col("classification"), F.lit("unknown"))
    fraud = F.coalesce(F.col("fraud_risk"), F.lit(False))
    apart = kind.isin("parent_company", "subsidiary", "unrelated")
    agreement = F.when(F.col("is_match") & apart, "disagree").otherwise("agree")
    model = F.coalesce(F.col("model_confidence"), F.lit(0.0))
    return rows.select(
        "*",
        (F.col("requires_review") | fraud | apart).alias("consensus_review"),
        (F.col("is_match") & ~fraud).alias("consensus_match"),
        F.when(kind.isin("same_entity", "abbreviation"), F.col("mismatch_type")).otherwise(kind).alias("consensus_type"),
        agreement.alias("agreement"),
        consensus_confidence(F.col("similarity_score"), model, agreement).alias("consensus_confidence"),
    )
