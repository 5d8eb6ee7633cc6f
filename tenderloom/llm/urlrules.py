"""URL filters: a sort-merge range join of urls with host and path rules.

Host labels are reversed and joined by dots with a dot at the end, so ``www.example.com`` becomes
``com.example.www.`` and a rule's host with all its subdomains is the interval of keys with one prefix.
Urls are sorted by reversed host and path inside ranges of that order; each rule goes to the ranges that its
interval meets. A sweep over a range keeps the active rules on a stack, nested hosts above wider ones, and
a url asks the levels of the stack for the longest rule whose path its own path starts with.

Longest means most characters of host and path together, then the longer host. Urls that no rule fits get
``otherwise`` and a null rule; so do a null url and one without ``://``, whose host and path are empty.
A repeated rule is the same as one; of opposite verdicts for one rule, block holds. Repeated urls and
a host with a third of all rows are no hot key: range bounds are taken within hosts, and rows
equal to several bounds are spread over the ranges between. The bounds come from a sample of keys; they
balance the ranges and do not touch results. Empty tables give no rows. Columns that are
not asked for by ``keep`` are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import range_bounds

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ROWS_A_RANGE = 200_000


def host_of(url: Column) -> Column:
    """The host after the first ``://``, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


@dataclass
class Level:
    """The rules of one host: verdicts by path, and the lengths that occur."""

    prefix: str
    host: str
    verdicts: dict[str, str] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    def add(self, path: str, verdict: str) -> None:
        if self.verdicts.get(path) != "block":
            self.verdicts[path] = verdict
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.verdicts), None)


def judge(stack: list[Level], path: str, otherwise: str) -> tuple[str | None, str]:
    """Rule and verdict for a path under the active hosts."""
    best: tuple[int, int, str, str] | None = None
    for level in stack:
        rule = level.longest(path)
        if rule is not None:
            found = (len(level.host) + len(rule), len(level.host), level.host + rule, level.verdicts[rule])
            best = max(best, found) if best else found
    return (best[2], best[3]) if best else (None, otherwise)


def filter_urls(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """The columns ``keep``, host, path, rule and verdict for every row with a url.

    ``rules`` has host, path and verdict (allow or block).
    """
    urls = pages.select(F.struct(*keep).alias("kept"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    key = F.concat(reversed_host(F.col("host")), F.col("path"))
    bounds, n = range_bounds(urls.select(key.alias("key")), ROWS_A_RANGE)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, salts: pd.Series) -> pd.Series:
        spans = ((bisect_left(bounds, k), bisect_right(bounds, k)) for k in keys)
        return pd.Series([a + s % (b - a + 1) for (a, b), s in zip(spans, salts, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(prefixes: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, p), bisect_right(bounds, f"{p[:-1]}/") + 1)) for p in prefixes])

    salt = F.shiftrightunsigned(F.xxhash64(*(F.col(f"kept.{c}") for c in keep)), 1)
    located = urls.select(range_of(key, salt).alias("range"), F.lit(1).alias("kind"), "host", "path", "kept", F.lit(None).cast("string").alias("verdict"))
    usable = rules.where("host != '' and path is not null and verdict in ('allow', 'block')").select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict").distinct()
    sent = usable.select(
        F.explode(ranges_of(reversed_host(F.col("host")))).alias("range"), F.lit(0).alias("kind"), "host", "path",
        F.lit(None).cast(located.schema["kept"].dataType).alias("kept"), "verdict",
    )
    order = [F.col("range"), F.when(F.col("kind") == 0, reversed_host(F.col("host"))).otherwise(key), F.col("kind")]
    events = located.unionByName(sent).repartitionById(n, "range").sortWithinPartitions(*order)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[Level] = []
        current = None
        for batch in batches:
            rules, verdicts = [], []
            for at, kind, host, path, verdict in zip(batch["range"], batch["kind"], batch["host"], batch["path"], batch["verdict"], strict=True):
                if at != current:
                    current = at
                    stack.clear()
                prefix = ".".join(reversed(host.split("."))) + "."
                while stack and not prefix.startswith(stack[-1].prefix):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].prefix != prefix:
                        stack.append(Level(prefix, host))
                    stack[-1].add(path, verdict)
                else:
                    rule, said = judge(stack, path, otherwise)
                    rules.append(rule)
                    verdicts.append(said)
            rows = batch[batch["kind"] == 1]
            yield pd.DataFrame({"kept": rows["kept"], "host": rows["host"], "path": rows["path"]}).assign(rule=pd.Series(rules, index=rows.index, dtype=object), verdict=pd.Series(verdicts, index=rows.index, dtype=object))

    kept = located.schema["kept"].dataType.simpleString()
    judged = events.mapInPandas(sweep, f"kept {kept}, host string, path string, rule string, verdict string")
    return judged.select(*(F.col(f"kept.{c}").alias(c) for c in keep), "host", "path", "rule", "verdict")


ORACLE = """
WITH rules(rhost, rpath, said) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
fitting AS (
  SELECT n, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(said, length(rhost) + length(rpath)) AS said
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM numbered LEFT JOIN fitting USING (n)
"""
