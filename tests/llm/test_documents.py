"""Operators on documents against brute force on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import boosting, isolation, jaccard, linededup, mixing, planes, sentencepieces, simhash
from tenderloom.llm.common import WordHashes, shared_folder, table, word_count

from .cases import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
tokenizer_files = pytest.importorskip("public_tokenizers")


def words(text):
    return WORD.findall(text or "")


# --- statistics, rules and classifier


def base_statistics(text):
    text = text or ""
    w = words(text)
    lines, seen, twice = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            twice += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), twice, len(inside)


def test_rules(spark):
    rows = documents() + [(3000, "spam words come again and again and again now " * 12, "en", "s1", 1), (3001, "a# b* <c>\n\nx y\nx y\n x y" * 9, "en", "s1", 1)]
    docs = frame(spark, rows, clash=True)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(3001, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = isolation.apply_rules(docs, isolation.fit_rules(docs, labels)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *base_statistics(r[1])) for r in rows)
    assert sorted((str(g.doc_id), g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert not (g.base_failed and g.kept)
    assert sum(g.kept for g in got if g.doc_id is not None and g.doc_id < 60) >= 58


def test_rules_without_rows(spark):
    docs, labels = frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = isolation.fit_rules(docs, labels)
    assert all(r.kept != r.base_failed for r in isolation.apply_rules(docs, forest).collect())
    assert isolation.apply_rules(docs.limit(0), forest).count() == 0


def test_rules_learn_from_all_labelled(spark):
    """Limits and threshold are those of all good labelled texts, whatever number of rows the trees draw from."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "be", "Gamma,", "d1", "epsilon!"], int(rng.integers(20, 60)))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, counts int")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(400)], "doc_id long, quality int")
    forest = isolation.fit_rules(docs, labels, tree_rows=60)
    counts = isolation.statistics([t.encode() for t in texts], isolation.WordHashes())
    good = isolation.ratios(counts[(np.arange(400) % 7 > 0) & ~isolation.base_failed(counts)])[:, : isolation.N_RULES]
    assert np.array_equal([forest.low, forest.high], np.quantile(good, [isolation.LIMIT, 1 - isolation.LIMIT], axis=0))
    assert np.allclose(forest.scale, good.std(0) + isolation.SPREAD)
    assert forest.threshold == np.quantile(forest.score(good), 1 - isolation.GOOD_LOSS)


def test_values_at_ranks(spark):
    values = sorted([0.0, -0.0, 1.5, -2.25, 1e-300, -1e300, 7.0, 7.0, 1e300, 0.1])
    rows = spark.createDataFrame([([v, float(i % 2)],) for i, v in enumerate(values)], "x array<double>")
    assert isolation.values_at(rows, [(0, k) for k in range(10)] + [(1, 4), (1, 5)], 2) == [*values, 0.0, 1.0]


def test_forest_prefers_rare_rows():
    rng = np.random.default_rng(1)
    x = np.zeros((500, isolation.N_RULES))
    x[:, 0] = rng.normal(5, 1, 500)
    x[490:, 1] = 3.0
    forest = isolation.fit_forest(x, np.arange(500) < 490)
    score = forest.score(x)
    assert score[490:].min() > forest.threshold and (score[:490] > forest.threshold).mean() <= 0.01


def test_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    trees = boosting.fit_quality(docs, labels)
    got = boosting.score_quality(docs, trees).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    # A held-out label is never learnt from.
    turned = labels.withColumn("quality", F.when(boosting.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(boosting.fit_quality(docs, turned).leaf, trees.leaf)


def test_classifier_cases(spark):
    docs = frame(spark, clash=True)
    none = boosting.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in boosting.score_quality(docs, none).collect()} == {0.5}
    assert boosting.score_quality(docs.limit(0), none).count() == 0
    kept = boosting.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_trees_learn_a_step():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    p = boosting.fit_trees(x[:400], y[:400]).score(x[400:])
    assert ((p >= 0.5) == y[400:]).mean() > 0.9


# --- token files


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (7, 2**32 - 1), (1000, 300), (65536, 49408)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert np.array_equal(planes.unpack_planes(planes.pack_planes(ids, bits)), ids)


@pytest.mark.parametrize(("bits", "chunk"), [(8, 64), (1, 65_536)])
def test_token_files(spark, tmp_path, bits, chunk):
    from tokenizers import Tokenizer

    name = tokenizer_files.path("word_bpe_49k.json")
    path = str(tmp_path / "ids")
    docs = frame(spark, clash=True)
    planes.write_ids(docs, path, lambda: planes.WordEncoder(name, end_id=2), chunk_ids=chunk, bits=bits)
    got = sorted(planes.read_ids(spark, path).collect(), key=lambda r: r.start)
    tokenizer, ids_of = Tokenizer.from_file(name), defaultdict(list)
    for doc_id, text, *_ in documents():
        ids_of[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    names = [r.doc_id for r in got]
    assert names == [None] + sorted(n for n in names if n is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        ids_of[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
        at += r.n_tokens
    assert not any(ids_of.values())
    index = planes.read_index(spark, path)
    assert index.agg(F.sum("n_ids")).first()[0] == at and index.where(F.col("n_ids") > chunk).isEmpty()


def test_texts_that_spell_added_tokens():
    """The library reads them as tokens; so does the encoder, at any place in a text."""
    from tokenizers import Tokenizer

    name = tokenizer_files.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(name), planes.WordEncoder(name, end_id=2)
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "plain words.", "x <|endoftext|><|endoftext|>\n\ny !"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encode([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert got[0] == [3306, 49407, 1002, 2]


def test_texts_word_by_word(spark, sf):
    from tokenizers import Tokenizer

    name = tokenizer_files.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(name), planes.WordEncoder(name)
    texts = [r.text or "" for r in table(spark, sf, "documents").collect()] + ["a.. b,c. d!!e f?! .g h\"' i'd", "x.\x1cy z.\xa0w", "Ä. ß! é, e\u0301. ab.\n\ncd"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_without_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    planes.write_ids(frame(spark).limit(0), path, lambda: planes.WordEncoder(tokenizer_files.path("word_bpe_49k.json"), end_id=2))
    assert planes.read_ids(spark, path).count() == 0


# --- mixing


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportion(spark):
    cases = {"a": ([7, 5, 0, 1], 20), "b": ([1], 5), "c": ([0, 0], 0), "d": ([1000, 1, 1, 1, 3], 37), "e": ([3, 3, 3], 7), "f": ([5, 5], 0)}
    rows = [(g, i, w, s) for g, (ws, s) in cases.items() for i, w in enumerate(ws)]
    got = mixing.apportion(spark.createDataFrame(rows, "g string, k int, w long, s long"), "k", "w", "s", "g").collect()
    for g, (ws, s) in cases.items():
        assert [r.quota for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == highest_quotients(ws, s), g


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix_of_rows_with_one_id(spark):
    """Rows that differ in the text alone give the same mix in every partitioning."""
    rows = [(7, " ".join(f"w{i}x{k}" for k in range(40)), "en", "a", i % 2) for i in range(10)] + [(8, "other words " * 30, "en", "b", 0)]
    mixes = {tuple(sorted(r.mixed_text for r in mixing.mixed_texts(mixing.mix(frame(spark, rows).repartition(n, F.rand(n)), word_count(F.col("text")), block=16, weights=(1, 5))).collect())) for n in range(1, 6)}
    assert len(mixes) == 1


@pytest.mark.parametrize("shard_docs", [10, 2000])
def test_mix(spark, shard_docs):
    rows = [r for r in documents() if r[0] != 2004] + [(4000 + i, "tiny source", "en", "b", 1) for i in range(3)] + [(5000, "", "en", "empty source", 0)]
    docs = frame(spark, rows, clash=True)
    mixed = mixing.mix(docs, word_count(F.col("text")), block=4, shard_docs=shard_docs)
    got = mixed.select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "taken", "passes", "excerpts").collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, shards = Counter(), max(1, math.ceil(len(rows) / shard_docs))
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + sum(e.end - e.start for e in r.excerpts)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 4 * (2 + 3 * shards) for s in sizes)
    again = mixing.mix(docs.repartition(7), word_count(F.col("text")), block=4, shard_docs=shard_docs).select("row.doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    texts = defaultdict(list)
    for r in mixing.mixed_texts(mixed).select("row.doc_id", "mixed_text").collect():
        texts[r.doc_id].append(r.mixed_text)
    assert sum(len(words(t)) for own in texts.values() for t in own) == sum(taken.values())


def test_mix_without_rows(spark):
    assert mixing.mix(frame(spark).limit(0), word_count(F.col("text"))).count() == 0


# --- line dedup


def test_line_dedup(spark):
    rows, least = documents() + [(8000 + i, "x" * 40 + "\r\n" + "y" * 39, "en", "s", 1) for i in range(6)], 5
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and doc_id is not None:
                holders[key(line)].add(doc_id)
    want = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= least and max(holders[key(x)]) != doc_id)]
        want[doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = linededup.dedupe_lines(frame(spark, rows, clash=True)).select("row.doc_id", "n_lines", "n_dropped", "kept_text", "row.pos").collect()
    assert Counter(tuple(r)[:4] for r in got) == want and {r.pos for r in got} == {7}
    assert any(r.n_dropped for r in got)
    assert linededup.dedupe_lines(frame(spark).limit(0)).count() == 0


# --- SentencePiece


def test_sentencepiece(spark):
    import sentencepiece

    name = tokenizer_files.path("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=name)
    rows = documents() + [(9000 + i, t, "en", "s", 1) for i, t in enumerate(["  two  spaces ", "▁mark▁ s", "\n\n", "<s> <0x0A> \x00", "é̂ﬁ①　\t x\r\n"])]
    encoded = sentencepieces.encode_documents(frame(spark, rows, clash=True), name)
    got = encoded.collect()
    want = Counter((r[0], tuple(reference.encode(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.part_mismatches == 0 and r.n_tokens == len(r.ids) // 4 for r in got)
    texts = Counter((r[0], reference.decode(reference.encode(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.text) for r in sentencepieces.decode_documents(encoded, name).collect()) == texts
    assert sentencepieces.encode_documents(frame(spark).limit(0), name).count() == 0
    whole = sentencepieces.build(sentencepieces.Codec(name).model)
    for text in ("whole texts too", "a  b\nc", "☃ é"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert ids == reference.encode(text) and whole.decode(ids) == text


@pytest.mark.parametrize("remembered", [10, 200_000])
def test_sentencepiece_of_given_texts(spark, sf, monkeypatch, remembered):
    """Whole texts by the unchanged library, with a memory of parts that is always full and one that never is."""
    import sentencepiece

    name = tokenizer_files.path("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=name)
    monkeypatch.setattr(sentencepieces, "REMEMBERED", remembered)
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    codec = sentencepieces.Codec(name)
    got = [ids for at in range(0, len(texts), 20) for ids, odd in codec.encode(texts[at : at + 20]) if not odd]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [reference.encode(t or "") for t in texts]


def test_unigram_model():
    """A unigram model written by hand: pieces by their scores, bytes for the rest."""

    def field(number, blob):
        return bytes([number << 3 | 2, len(blob)]) + blob

    def piece(text, score, kind):
        import struct

        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    pieces = [("<unk>", 0, 2), ("▁a", -1, 1), ("b", -2, 1), ("▁", -3, 1), ("ab", -2.5, 1), ("a", -4, 1)] + [(f"<0x{i:02X}>", -9, 6) for i in range(256)]
    blob = b"".join(piece(*p) for p in pieces) + field(2, b"\x18\x01" + b"\x98\x02\x01")
    model = sentencepieces.read_model(blob)
    assert model.kind == sentencepieces.UNIGRAM and model.byte_fallback and not model.divisible
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_proto=blob)
    codec = sentencepieces.Codec(blob)
    for text in ("ab", "a b", "b  ab", "c", "", " aab "):
        assert np.frombuffer(codec.encode([text])[0][0], "<u4").tolist() == reference.encode(text), text


# --- near duplicates


def brute_classes(rows, threshold=0.8):
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[text or ""].append(doc_id)
    texts, sets = list(ids), []
    for t in texts:
        w = words(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    group, links = list(range(len(texts))), Counter()

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, t in enumerate(texts):
        least[find(i)] += [x for x in ids[t] if x is not None]
    return Counter((x, min(least[find(i)], default=None), links[i], len(ids[t]) - 1) for i, t in enumerate(texts) for x in ids[t])


def near_rows():
    import random

    rng = random.Random(8)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    rows = documents()
    for i in range(120):
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9)}"
        rows.append((10_000 + i, " ".join(own), "en", "s0", 1))
    return rows + [(20_000, " ".join(base[:4]), "en", "s", 1), (20_001, "  " + " ".join(base[:4]), "en", "s", 1)]


@pytest.mark.parametrize("block_runs", [2_000, 250_000])
def test_near_duplicates(spark, block_runs):
    rows = near_rows()
    got = jaccard.near_duplicates(frame(spark, rows, clash=True), block_runs=block_runs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_classes(rows)
    assert sum(r.n_links for r in got) > 1000


def repeated_rows():
    """Texts with nearly the same set of runs, which repeat them more or less often."""
    once = " ".join(f"once{k}" for k in range(200))
    line = " ".join(f"line{k}" for k in range(12))
    rows = [(30_000 + n, " ".join([once] * n), "en", "s", 1) for n in (1, 2, 3)]
    return rows + [(31_000 + n, "\n".join([line] * n), "en", "s", 1) for n in (10, 30, 90)]


def test_near_duplicates_of_repeated_text(spark):
    rows = repeated_rows()
    want = brute_classes(rows)
    assert sorted(want) == [(30_000 + n, 30_001, 2, 0) for n in (1, 2, 3)] + [(31_000 + n, 31_010, 2, 0) for n in (10, 30, 90)]
    # Among other texts, so that the neighbours in a bucket are seen.
    rows += near_rows()
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_classes(rows)


def templated(k):
    """Texts of three templates that differ in the last word."""
    return [b"%d-%d" % (k // 2 % 3, i) for i in range(30)] + [b"id%d" % k]


def edited(k):
    """Texts of one template with up to three changed words."""
    import random

    rng, own = random.Random(k), [b"e%d" % i for i in range(60)]
    for _ in range(k % 4):
        own[rng.randrange(60)] = b"new%d" % rng.randrange(9)
    return own[: rng.randrange(52, 61)]


def block_table(texts, same):
    runs = [jaccard.runs_of(WordHashes()(t), 5) for t in texts]
    bands = jaccard.band_keys(runs, *jaccard.bands_for(0.8, 0.9999, 128)).view(np.int64)
    names = [0 if same else k % 2 for k in range(len(texts))]
    import pyarrow as pa

    kinds = {"p": pa.int64(), "q": pa.int64(), "block": pa.int64(), "key": pa.binary(), "bands": pa.list_(pa.int64()), "runs": pa.binary()}
    columns = [[0] * len(texts), [max(names)] * len(texts), names, [k.to_bytes(4, "big") for k in range(len(texts))], bands.tolist(), [jaccard.packed(r) for r in runs]]
    return pa.table({k: pa.array(c, kinds[k]) for k, c in zip(kinds, columns, strict=True)})


@pytest.mark.parametrize("bounds", [None, (3000, 20_000, 4000)])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("text", [templated, edited])
def test_links_of_dense_blocks(monkeypatch, text, same, bounds):
    for name, bound in zip(("SLICE_PAIRS", "SLICE_CELLS", "BIT_SET_BYTES"), bounds or (), strict=False):
        monkeypatch.setattr(jaccard, name, bound)
    texts = [text(k) for k in range(400)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (same or i % 2 != j % 2) and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = jaccard.local_links(block_table(texts, same), 0.8).to_pylist()
    assert {int.from_bytes(r["key"], "big"): (r["links"], int.from_bytes(r["root"], "big")) for r in got} == {k: (n, find(k)) for k, n in links.items()}
    assert len(got) > 200


def test_a_hot_group_makes_no_pairs(monkeypatch):
    import tracemalloc

    n = 6000
    table_ = block_table([templated(k) for k in range(n)], True)
    tracemalloc.start()
    got = jaccard.local_links(table_, 0.8).column("links").to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [n // 3 - 1] * n and most < 200e6


def test_representatives(spark):
    rows = near_rows()
    kept = jaccard.representatives(frame(spark, rows, clash=True)).select("row.*")
    classes = {c for _, c, _, _ in brute_classes(rows)}
    got = Counter(r.doc_id for r in kept.collect())
    # The id 7 is borne by two texts of different classes.
    assert set(got) == classes and {k for k, n in got.items() if n > 1} <= {7}
    assert jaccard.near_duplicates(frame(spark).limit(0)).count() == 0 and jaccard.representatives(frame(spark).limit(0)).count() == 0


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_long_chain_of_edges(spark):
    n = 40
    edges = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(n)] + [(b"\xf0", b"\xf0"), (b"\xf2", b"\xf1")], "key binary, root binary")
    got = {bytes(r.key): bytes(r.label) for r in jaccard.group_labels(edges).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(n + 1)) and got[b"\xf2"] == b"\xf1"


# --- fingerprints


def hexed(text):
    return tuple(x & (2**64 - 1) for x in simhash.fingerprint(WordHashes()((text or "").encode().split())))


def test_edited_texts(spark):
    rows = documents()
    got = simhash.edited(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
    unique = [r for r in rows if r[0] is not None and len(found[r[0]]) == 1]
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    after = {r[0]: ordered[(k + 1)] for k, r in enumerate(ordered[:-1])}
    for doc_id, text, *_ in unique:
        if doc_id not in after or len(found[after[doc_id][0]]) > 1:
            continue
        text, follows = text or "", after[doc_id][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + follows[:half]
        r = found[doc_id][0]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        pairs = [(r[f"{p}_high"] & (2**64 - 1), r[f"{p}_low"] & (2**64 - 1)) for p in ("own", "edited", "next")]
        assert pairs == [hexed(text), hexed(edit), hexed(follows)]
    last, first = found[None][0], max(r[0] for r in rows if r[0] is not None)
    assert (last.next_high & (2**64 - 1), last.next_low & (2**64 - 1)) == hexed(next(r[1] for r in rows if r[0] == first))


def test_edited_few_rows(spark):
    assert simhash.edited(frame(spark).limit(0)).count() == 0
    lone = simhash.edited(spark.createDataFrame([(1, "a b c d", "en", "s", 7)], SCHEMA)).first()
    assert lone.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest() and lone.own_high == lone.next_high


def test_find_near(spark):
    rng = np.random.default_rng(6)
    prints = [tuple(map(int, rng.integers(-(2**63), 2**63, 2))) for _ in range(60)]
    for high, low in prints[:40]:
        flips = rng.choice(128, rng.integers(1, 9), replace=False)
        for f in flips:
            high, low = (high ^ (1 << int(f)), low) if f < 64 else (high, low ^ (1 << int(f - 64)))
        wrap = lambda x: (x + 2**63) % 2**64 - 2**63
        prints.append((wrap(high), wrap(low)))
    prints.append(prints[0])
    df = spark.createDataFrame(prints, "high long, low long")
    for radius in (3, 5):
        apart = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
        want = Counter((a, b, apart(a, b)) for a in set(prints) for b in set(prints) if a != b and apart(a, b) <= radius)
        got = Counter(((r.high, r.low), (r.other_high, r.other_low), r.distance) for r in simhash.find_near(df, df, radius).collect())
        assert got == want and want


def test_shared_folder_is_read_from_the_session():
    class Session:
        """What a session on a cluster says."""

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": "spark://host"})


    assert shared_folder(Session("store://bucket/x/"), "a").startswith("store://bucket/x/llm-a-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(None), "a")
