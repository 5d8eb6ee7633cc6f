"""The ledger stream over several micro-batches and a restart, against the chain of all events."""

import os
import random
from pathlib import Path

from test_rules import chain_model

from tenderloom.catalog.search import ingest_stream
from tenderloom.streaming import streams

SCHEMA = "event_id bigint, tender_id bigint, event_type string, event_data string, actor string, ts_text string"


def arrive(spark, folder, number, rows):
    """One file of events, younger than the files before it."""
    staged = folder.parent / f"staged-{number}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(staged))
    target = folder / f"{number:03d}.parquet"
    target.write_bytes(next(staged.glob("*.parquet")).read_bytes())
    os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def test_runs_of_tails():
    assert streams.tail_runs(0) == []
    assert streams.tail_runs(6) == [(0, 3), (4, 5)]
    for n in range(70):
        runs = streams.tail_runs(n)
        assert [b for a, z in runs for b in range(a, z + 1)] == list(range(n))
        assert len(runs) == bin(n).count("1")
        # The newest run of the next count takes in whole runs of this one.
        first = streams.tail_runs(n + 1)[-1][0]
        assert first == n or first in [a for a, _ in runs]


def test_ledger_stream_restarts(spark, tmp_path):
    """Seven batches in two runs of the query equal one chain; a tender that rests for some batches is found again."""
    rng = random.Random(5)
    batches, n = [], 0
    for number in range(7):
        tenders = [0, 100 + number] if number in (2, 3, 4) else [0, 1, 2]
        rows = []
        for _ in range(rng.randint(1, 9)):
            rows.append((n, rng.choice(tenders), "case_routed", f'{{"n":{n}}}', "officer", f"2024-01-01T00:00:{n % 60:02d}.000Z"))
            n += 1
        batches.append(rows)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def drain():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        streams.ledger_stream(events, out, f"{out}/state").awaitTermination()

    for number, rows in enumerate(batches[:3]):
        arrive(spark, source, number, rows)
    drain()
    for number, rows in enumerate(batches[3:], 3):
        arrive(spark, source, number, rows)
    drain()
    got = {r.event_id: r.entry_hash for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert got == chain_model([r for rows in batches for r in rows])
    assert len(list(Path(out, "ledger").glob("batch=*"))) == 7
    # The runs before batch 6 and the one it wrote; those are all that is left.
    assert {p.name for p in Path(out, "tails").iterdir()} == {f"{a}-{z}" for a, z in [*streams.tail_runs(6), *streams.tail_runs(7)]}


def test_ingest_stream_reads_a_file_or_a_folder(spark, tmp_path):
    """A table may be one file or a folder of part files; both give the same uploads."""
    rows = [(i, f"text {i % 12}", "en", f"s{i % 2}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    table.coalesce(1).write.parquet(str(tmp_path / "staged"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "documents.parquet").write_bytes(next((tmp_path / "staged").glob("*.parquet")).read_bytes())
    table.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    found = [sorted(map(tuple, ingest_stream(spark, str(tmp_path / place)).collect())) for place in ("one", "many")]
    assert found[0] == found[1] and found[0]
