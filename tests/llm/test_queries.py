"""The registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tenderloom.llm import catalog
from tenderloom.llm.common import table

from .cases import documents, frame
from .test_documents import brute_classes, near_rows, words


def test_registry():
    queries = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in (*catalog.QUERIES, *corpus_pipeline.QUERIES)}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(queries) and set(catalog.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(map(tuple, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, sf, name):
    rows = table(spark, sf, "pages" if name.startswith("op1_") else "documents").count()
    assert catalog.QUERIES[name](spark, sf).count() == rows


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stage_on_awkward_rows(spark, sf, name, stage, empty):
    docs = frame(spark, clash=True)
    docs = docs.limit(0) if empty else docs
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert bool(rows) != empty
    if name != "pieces":
        assert out.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in rows if r.text and name in ("lines", "mixture"))


def test_stages_do_their_work(spark, sf):
    rows = near_rows()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, frame(spark, rows), sf).collect()
    assert {r.doc_id for r in kept} == {c for _, c, _, _ in brute_classes(rows)}
    mixed = stages["mixture"](spark, frame(spark), sf).collect()
    size = sum(len(words(r[1])) for r in documents())
    assert abs(sum(len(words(r.text)) for r in mixed) - size) < 0.02 * size


def test_pipeline(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and {r.doc_id for r in got} <= set(docs)
    assert all(r.part_mismatches == 0 and r.n_tokens > 0 for r in got)
    kept = Counter(labels.get(r.doc_id) for r in got)
    assert kept[0] <= 0.05 * kept[1]
