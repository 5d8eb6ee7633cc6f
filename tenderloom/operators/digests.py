"""SHA-256 over ordered groups in constant memory.

The digest of a group is defined over its rows in order, so the rows of one group
pass one task in turn; they are never held together.  Rows are shuffled by group,
sorted on disk when needed, and folded batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_digest(
    rows: DataFrame, key: str, order: list[str], text: str, prefix: str = "", separator: str = "", suffix: str = ""
) -> DataFrame:
    """(key, n, digest) where the digest covers prefix + texts joined by separator + suffix."""
    schema = T.StructType([rows.schema[key], T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    name = schema[0].name
    head, sep, tail = prefix.encode(), separator.encode(), suffix.encode()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, state = None, 0, None
        for pdf in batches:
            done: list[tuple] = []
            for k, t in zip(pdf[name].tolist(), pdf["_text"].tolist()):
                if state is None or k != current:
                    if state is not None:
                        state.update(tail)
                        done.append((current, count, state.hexdigest()))
                    current, count, state = k, 0, hashlib.sha256(head)
                if count:
                    state.update(sep)
                state.update(t.encode())
                count += 1
            if done:
                yield pd.DataFrame(done, columns=[name, "n", "digest"])
        if state is not None:
            state.update(tail)
            yield pd.DataFrame([(current, count, state.hexdigest())], columns=[name, "n", "digest"])

    ordered = rows.select(F.col(key), *[F.col(c) for c in order if c != key], F.col(text).alias("_text"))
    ordered = ordered.repartition(key).sortWithinPartitions(key, *[c if c != text else "_text" for c in order])
    return ordered.select(key, "_text").mapInPandas(fold, schema)
