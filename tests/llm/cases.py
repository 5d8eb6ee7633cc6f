"""Small documents and pages with the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "row long, size long, key string, pos int, line string, range int, kind int, label string, score double, order string, shard int, tie int"


def text(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in words).strip()


def documents(n=60, seed=3):
    """Rows of documents: plain ones, copies, near copies, shared lines, and the awkward ones."""
    rng = random.Random(seed)
    shared = "This line stands in many documents and is long enough to be a key"
    rows = []
    for i in range(n):
        body = text(rng, rng.randrange(30, 160))
        if i % 4 == 0:
            body = f"{body}\n  {shared.upper() if i % 8 else shared}\t\n{text(rng, 20)}"
        rows.append((i, body, "en", f"s{i % 5}" if i % 7 else None, len(body)))
    base = rows[5][1].split(" ")
    rows.append((1000, rows[5][1], "en", "s0", None))
    rows.append((1001, " ".join(base[:-3] + ["changed"] + base[-2:]), None, "s1", 1))
    rows += [rows[7], rows[7]]  # repeated rows
    rows.append((7, "another text under an id that is taken " * 3, "en", "s1", 5))
    rows += [(2000, None, None, None, None), (2001, "", "de", "s2", 0), (2002, " \t\n ", "de", "s2", 4), (2003, "one", "de", "s2", 3), (None, "no id but words enough " * 5, "fr", "s3", 9)]
    long = text(rng, 30_000, 5_000)
    rows.append((2004, long, "en", "s4", len(long)))
    rows.append((2005, "ünïcödé   ☃ 😀  zwei\r\nÄÖ", "de", "s4", 20))
    return rows


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        names = [c.split() for c in CLASHING.split(", ")]
        df = df.select("*", *(F.lit("7").cast(kind).alias(name) for name, kind in names))
    return df.repartition(3)
