"""Wording cases from vectors and logged answers, and reruns with a log as it stood at a version."""

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from tenderloom.catalog import bids
from tenderloom.functions import patterns as P
from tenderloom.operators import branches, qualitative
from tenderloom.plans import evaluation as plans
from tenderloom.sources import files


@pytest.mark.parametrize("block", [2, 1024])
def test_document_similarity(spark, block):
    """The nearest chunk of a bidder counts, in whatever blocks the vectors meet; bids without chunks have 0."""
    rng = random.Random(3)
    unit = lambda: [round(rng.uniform(-0.5, 0.5), 3) for _ in range(4)]
    criteria = {c: unit() for c in range(8)}
    chunks = [(b, n, unit()) for b in range(9) for n in range(b % 4 * 3)]
    cases = [(b % 2, b, c) for b in range(9) for c in range(8) if c % 2 == b % 2]
    got = qualitative.document_similarity(
        spark.createDataFrame(cases, "tender_id long, bidder_id long, criterion_id long"), spark.createDataFrame(list(criteria.items()), "criterion_id long, embedding array<double>"),
        spark.createDataFrame(chunks, "bidder_id long, chunk_no int, embedding array<double>"), block,
    ).collect()
    want = {(b, c): max([round(sum(x * y for x, y in zip(v, criteria[c])), 6) for owner, _, v in chunks if owner == b], default=0.0) for _, b, c in cases}
    assert {(r.bidder_id, r.criterion_id): r.document_similarity for r in got} == pytest.approx(want)


def test_answers_of_a_log(spark):
    """The last entry of a prompt counts; text that holds no verdict counts as no answer."""
    cases = spark.createDataFrame([(i, f"need {i}", "Alpha") for i in range(5)], "bidder_id long, criterion_text string, company_name string")
    key = branches.prompt_hash(F.lit(qualitative.PROMPT_TYPE), qualitative.prompt_of(F.col("criterion_text"), F.col("company_name"), F.col("bidder_id")))
    keys = {r.bidder_id: r.h for r in cases.select("bidder_id", key.alias("h")).collect()}
    rows = [
        (keys[0], '{"verdict": "FAIL", "confidence": 0.2}', "m", "2024-01-01", 1), (keys[0], '```json\n{"verdict": "PASS", "confidence": 0.8, "factors": ["a", "b"]}\n```', "m", "2024-01-02", 1),
        (keys[1], "sorry", "m", "2024-01-01", 1), (keys[2], '{"verdict": "MAYBE", "confidence": 1.0}', "m", "2024-01-01", 1), (keys[3], 'Well: {"verdict": "REVIEW"} I think', "m", "2024-01-01", 2),
    ]
    log = spark.createDataFrame(rows, "prompt_hash string, response string, model_version string, logged_at string, version int")
    read = lambda version: {r.bidder_id: (r.model_verdict, r.model_confidence, r.model_factors) for r in qualitative.answered(cases, qualitative.log_at(log, version)).collect()}
    none = (None, None, None)
    assert read(1) == {0: ("PASS", 0.8, ["a", "b"]), 1: none, 2: none, 3: none, 4: none}
    assert read(2)[3] == ("REVIEW", None, None)


def test_rerun_changes_exactly_the_cases_of_new_answers(spark, sf):
    """The same log gives every case and equal hashes; new answers change their cases and no other."""
    cases = {}

    def run(version):
        rows = bids.assessments(spark, sf, version)
        rows = rows.withColumns({"evaluation_id": F.concat_ws("|", "bidder_id", "criterion_id"), "route": F.col("agreement")})
        cases[version] = files.kept(rows.withColumns({c: F.lit(None).cast("string") for c in ("source_document_id", "source_page_number", "source_bbox")}))
        return cases[version]

    changed = plans.reproduce_run(run, 1, 2, keep=files.kept).collect()
    read = lambda version: {(r.tender_id, r.bidder_id, r.criterion_id): (r.verdict, round(r.confidence, 6), r.agreement) for r in cases[version].collect()}
    first, second = read(1), read(2)
    differ = {k for k in first if first[k] != second[k]}
    assert differ and differ == {k for k in first if k[1] % 100 == 12}
    hit = {k[0] for k in differ}
    assert {r.tender_id for r in changed if not r.identical} == hit and all((r.original_hash == r.reproduced_hash) == (r.tender_id not in hit) for r in changed)
    assert sum(r.total - r.matches for r in changed) == len(differ)


def test_rerun_screens_names_in_full(spark, sf, monkeypatch):
    """Both runs compare names at the usual threshold, and the SQL finds the same similar names as the ratio."""
    asked = []

    def run(*tables, **options):
        asked.append(options.get("name_threshold", P.NAME_MATCH_THRESHOLD))
        return SimpleNamespace(cases=None)

    monkeypatch.setattr(bids.plans, "evaluate_all", run)
    monkeypatch.setattr(bids.plans, "reproduce_run", lambda run, then, now, keep: [run(then), run(now)])
    bids.rerun(spark, sf, 1, 1)
    assert asked == [P.NAME_MATCH_THRESHOLD] * 2
    bidders = ["Alpha Beta Works", "Alpha Beta Infra Pvt. Ltd.", "Gamma Delta Traders", "abcabcabd", None]
    listed = ["Alpha Betta Works", "Alpha Bta Infrastructure", "Gama Dlta Traders", "abcabdabc", "xyz"]
    con = duckdb.connect()
    con.execute("CREATE TABLE bidders AS SELECT unnest(?::VARCHAR[]) AS company_name", [bidders])
    con.execute("CREATE TABLE debarment_list AS SELECT unnest(?::VARCHAR[]) AS entity_name", [listed])
    got = set(con.execute(f"WITH RECURSIVE {bids._ALIKE} SELECT a, b FROM alike").fetchall())
    name = lambda n: n.lower().replace(".", "").replace(" pvt ltd", "").replace(" infra", " infrastructure").replace("infrastructurestructure", "infrastructure")
    pairs = {(name(a), name(b)) for a in bidders if a for b in listed}
    assert got == {(a, b) for a, b in pairs if a != b and SequenceMatcher(None, a, b).ratio() >= P.NAME_MATCH_THRESHOLD} and len(got) >= 3
