"""Text functions against hand-computed values and small Python models."""

import json
import random
import re

from pyspark.sql import functions as F

from tenderloom.functions import bidtext as B
from tenderloom.functions import clauses as C
from tenderloom.functions import common as M
from tenderloom.functions import patterns as P
from tenderloom.operators import criteria as X
from tenderloom.operators import ingest as A

NIT = """4.1 The bidder shall have annual turnover of not less than Rs. 5 Crore in the last 3 financial years.
4.2 Valid GST registration certificate is mandatory.
4.3 At least 3 similar supply orders in the last 5 years.
4.4 Annual turnover of Rs. 10 Crore and ISO 9001:2015 certification.
4.5 The bidder shall demonstrate adequate manufacturing capacity."""


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def many(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_amount_of_a_sentence(spark):
    got = one(spark, "Annual turnover of Rs. 12.45 Crore", B.numeric_value)
    assert (got["amount"], got["unit"], got["raw_value"], got["confidence"]) == (124_500_000, "crore", 12.45, 0.9)
    got = one(spark, "Fee Rs. 500 and 12 lakh, then INR 3 Lakh in FY 23-24", B.numeric_value)
    assert (got["amount"], got["fiscal_year"], got["confidence"]) == (300_000, "2023-24", 0.95)
    assert one(spark, "about 7.5 lakh", B.numeric_value)["confidence"] == 0.75
    assert one(spark, "no figure here", B.numeric_value) is None
    assert one(spark, "Rs. , only", B.numeric_value) is None


def test_rupees_round_half_to_even(spark):
    rows = spark.createDataFrame([(2.5, ""), (3.5, "each"), (12.45, "crore"), (1.0, "L.")], "v double, u string")
    assert [r[0] for r in rows.select(M.to_rupees(F.col("v"), F.col("u"))).collect()] == [2, 4, 124_500_000, 100_000]


def test_dates_and_validity(spark):
    texts = ["31-12-2026", "2024/2/9", "on 5 September 2023", "June 2025", "31-02-2024 or 1 May 2024", "none", "0000-01-01"]
    want = ["2026-12-31", "2024-02-09", "2023-09-05", "2025-06-01", "2024-05-01", None, None]
    assert many(spark, texts, B.first_iso_date) == want
    got = one(spark, "issued 01-01-2020, valid up to 31-12-2026.", lambda t: B.validity(t, "2025-06-01"))
    assert (got["date"], got["is_valid"], got["confidence"]) == ("2026-12-31", True, 0.85)
    got = one(spark, "issued 01-01-2020", lambda t: B.validity(t, "2025-06-01"))
    assert (got["date"], got["is_valid"], got["confidence"]) == ("2020-01-01", False, 0.7)


def test_identifiers(spark):
    text = "GSTIN 27ABCDE1234F1Z5 only"
    assert one(spark, text, lambda t: B.registration_number(t, F.lit("gstin"))) == "27ABCDE1234F1Z5"
    assert one(spark, text, lambda t: B.registration_number(t, F.lit("pan"))) is None  # the PAN inside does not count
    assert one(spark, text + " PAN ABCDE1234F", lambda t: B.registration_number(t, F.lit("pan"))) == "ABCDE1234F"
    assert one(spark, text, lambda t: B.registration_number(t, F.lit("visa"))) is None


def test_company_names(spark):
    texts = ["M/s Alpha Beta Pvt. Ltd.\nx", "Submitted by Gamma Works Limited here", "M/s Delta House dated today", "nothing"]
    assert many(spark, texts, B.company_name) == ["Alpha Beta Pvt. Ltd", "Gamma Works Limited", "Delta House", None]
    assert one(spark, "ABC Engg. & Const. (India) Pvt. Ltd.", B.normalise_company) == "abc engineering construction"


def test_clauses_and_criteria(spark):
    clauses = one(spark, NIT, C.split_clauses)
    assert [c["clause_ref"] for c in clauses] == ["4.1", "4.2", "4.3", "4.4", "4.5"]
    assert [c["body"] for c in one(spark, "One. Two here. three", C.split_clauses)] == ["One.", "Two here. three"]
    docs = spark.createDataFrame([("d1", 1, NIT)], "document_id string, tender_id int, text string")
    rows = X.extract_criteria(docs).orderBy("ord", "match_no").collect()
    assert [(r["clause_ref"], r["criterion_type"]) for r in rows] == [
        ("4.1", "numeric_threshold"), ("4.2", "categorical_presence"), ("4.3", "temporal_recency"),
        ("4.4", "numeric_threshold"), ("4.4", "categorical_presence"), ("4.5", "qualitative_assessment"),
    ]
    assert rows[0]["rupees"] == 50_000_000 and rows[0]["measurement_period"] == "3 financial years" and rows[0]["gfr_rule_number"] == "GFR Rule 173(i)"
    assert (rows[2]["count"], rows[2]["period"], rows[2]["is_mandatory"]) == (3, 5, False)
    assert rows[1]["is_mandatory"] and not rows[1]["gfr_override_permitted"]


def test_json_text_matches_python(spark):
    texts = ["plain", 'q"uote\\', "tab\tline\nfeed\r\b\f", "\x01\x1f\x7f", "é € 😀 mixed", ""]
    assert many(spark, texts, M.json_string) == [json.dumps(t) for t in texts]
    loose = ['{ "b" : [1, 2], "a": {"d": "é", "c": null} }', "broken", "[3, 1]"]
    assert many(spark, loose, M.canonical_json) == ['{"a":{"c":null,"d":"\\u00e9"},"b":[1,2]}', None, "[3,1]"]


def test_numbers_print_as_in_python(spark):
    random.seed(3)
    values = [0.0, -0.0, 1.0, 1e-05, 0.0001, 1.5, 1e15, 1e16, 123456789012345680.0, 1e22, 2e-44, 9.999999999999999e22, 5e-324, 1.7976931348623157e308, 2.0**-44, 0.1 + 0.2]
    values += [random.uniform(-1, 1) * 10.0 ** random.randint(-30, 30) for _ in range(4000)] + [round(random.uniform(-1e6, 1e6), random.randint(0, 6)) for _ in range(1000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", M.json_float(F.col("v")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [repr(v) for v in values]
    loose = [
        '{"b": 1.0, "a": [1e-05, 1.50, -0, -0.0, 1E5], "c": {"z": 2, "y": 0.0001}}', '{"n 1.0": "a, 1.50, b", "q\\"1.0": "\\\\", "s": "\\u0007 2.50"}', "1.0", "[1.0", '"1.0"',
        '{"big": 123456789012345678901234567890, "far": 123456789012345678901234567890123456789012345678901234567890, "e": ""}', '["é 1.0", 12345678901234567890.0, true, null, 3e0]',
    ]
    want = []
    for t in loose:
        try:
            want.append(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))
        except ValueError:
            want.append(None)
    assert many(spark, loose, M.canonical_json) == want


def test_prose_projects_equal_the_one_piece_pattern(spark):
    random.seed(7)
    bits = ["Supply order", "works - Rs. 5 lakh", " on 12-03-2021", "\n", ": 31-12-2027", "–", "Rs 7,50,000", "bridge at site", "2024-01-05", " | 9 cr May 2020", "x" * 70, "-3.5"]
    texts = ["".join(random.choice(bits) + random.choice([" ", ""]) for _ in range(random.randint(1, 14))) for _ in range(300)]
    got = many(spark, texts, B.prose_projects)
    for text, projects in zip(texts, got):
        want = [" ".join(m.group(1).split()).strip(" -:–|") for m in re.finditer(P.PROJECT_IN_PROSE, text)]
        assert [p["description"] for p in projects] == [w for w in want if w], text


def test_prose_projects_of_a_file_of_many_pages(spark):
    """The tails of a file are cut out once; each with the rest of the file behind it would be gigabytes here."""
    page = "Supply order {} to depot - Rs. {}.5 Lakh completed 1997-0{}-11, 12,{}\n"
    text = "".join(page.format(i, i % 50, i % 9 + 1, i % 10) for i in range(10_000))
    (projects,) = many(spark, [text], B.prose_projects)
    assert len(projects) == 10_000
    assert [(p["amount"], p["completion_date"]) for p in projects[:3]] == [(50_000, "1997-01-11"), (150_000, "1997-02-11"), (250_000, "1997-03-11")]


def test_project_tails_with_less_trial_are_the_same(spark):
    """Tails whose date starts among the digits of the amount, and those without a date."""
    texts = ["bridge at site - 12,10-05-2024", "bridge at site - 12.45-03-2024", "bridge at site: 2024-05-1", "supply of pipes | rs. 3 l. octopus, Sept  2021", "supply of pipes - 1.2.2020", "supply of pipes: 4 lac no date",
             "supply of pipes - 5 crore" + " " * 61 + "May 2020", None, ""]
    got = many(spark, texts, B.prose_projects)
    for text, projects in zip(texts, got):
        if text is None:
            assert projects is None
            continue
        want = [(m.group(1).strip(" -:–|"), m.group(2)) for m in re.finditer(P.PROJECT_IN_PROSE, text)]
        assert [p["description"] for p in projects] == [w for w, _ in want], text
    assert len(got[0]) == len(got[1]) == 1 and got[5] == []


def test_prose_projects_are_read_by_one_function(spark):
    """A file is read once, without a pattern over it for each part of a tail; units do not carry over from a place that is no tail."""
    text = "Turnover: Rs. 7.00 Crore." + " " * 70 + "\nSupply order 1 to depot: 45 completed 2001-07-17\nBridge at the site | 1,250.5 lakh in Sept 2019, 31-02-2020"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(B.prose_projects(F.col("text")).alias("p"))
    want = [("Supply order 1 to depot", 45, "2001-07-17", 0.85), ("Bridge at the site", 125_050_000, "2019-09-01", 0.85)]
    assert [r.p and [tuple(p) for p in r.p] for r in rows.collect()] == [want, None, []]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    assert rows.select(F.explode("p")).count() == 2


def test_layout_equals_a_running_cursor(spark):
    random.seed(3)
    texts = [" ".join("w" * random.choice([1, 3, 9, 40, 150, 310]) for _ in range(random.randint(0, 60))) for _ in range(40)]
    pages = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "page_id string, raw_text string")
    got = {}
    for r in A.layout_words(pages).collect():
        got.setdefault(r["page_id"], {})[r["word_no"]] = (r["x_min"], r["y_min"], r["x_max"], r["y_max"])
    for i, text in enumerate(texts):
        x, y, want = 50.0, 50.0, {}
        for n, token in enumerate(text.split()):
            w = 8.0 * len(token)
            if x + w > 2430:
                x, y = 50.0, y + 20.0
            want[n] = (x, y, x + w, y + 14.0)
            x += w + 10.0
        assert got.get(str(i), {}) == want


def test_unicode_spaces_are_read_as_blanks(spark):
    pages = spark.createDataFrame([("d", 1, "Turnover: Rs.\u00a05\u00a0Crore\u2003only", 0.9), ("d", 2, "FY\u202f2023-24", 0.9)], "document_id string, page_number int, raw_text string, ocr_confidence double")
    text = A.assemble_text(pages, "document_id").first()["text"]
    assert text == "Turnover: Rs. 5 Crore only\nFY 2023-24"
    amount = spark.createDataFrame([(text,)], "t string").select(B.numeric_value(F.col("t")).alias("n")).first()["n"]
    assert amount["amount"] == 50_000_000


def test_preferred_amount_is_the_first_match_with_a_unit(spark):
    # Python's (?i) also folds the long s and the like, which these texts have not.
    currency, bare = re.compile(P.CURRENCY_AMOUNT), re.compile(P.UNIT_AMOUNT)
    rng = random.Random(25)
    parts = ["Rs.", "rs", "INR ", "\u20b9", " ", "\n", "12", "5,00", ",", ".5", "3.25", "crore", " lakh", "cr.", "l", "k", "mn", "FY 2023-24", "2022/23", "x", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", B.numeric_value(F.col("t")).alias("n")).collect()
    got = {r["i"]: r["n"] for r in rows}
    for i, t in enumerate(texts):
        matches = list(currency.finditer(t))
        m = next((m for m in matches if m.group(2)), matches[0] if matches else bare.search(t))
        raw = m.group(1).replace(",", "") if m else ""
        if not raw:
            assert got[i] is None, t
            continue
        quality = (2 if m.group(2) else 1) if matches else 0
        assert (got[i]["raw_value"], got[i]["unit"], got[i]["quality"]) == (float(raw), (m.group(2) or "rupees").lower(), quality), t
        year = year_of(t[max(0, m.start() - 40) : m.end() + 40])
        assert got[i]["fiscal_year"] == year, t


def year_of(window):
    for pattern in P.FISCAL_YEAR_PATTERNS:
        if found := re.search(pattern, window):
            years = re.split("[-–/]", re.sub(r"\s+", "", found.group(1)))
            start, end = years[0], years[-1]
            return f"{'20' + start if len(start) == 2 else start}-{end[2:] if len(end) == 4 else end}"
    return None


def test_chunks_and_blanks_as_cut_step_by_step(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice([".", "!", "?", " ", "\n", "\t", "\r", "\x01", "\x1c", "\xa0", "\u2003", "a", "7"]) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    steps = F.split(F.regexp_replace(F.regexp_replace("t", r"([.!?])\s+", "$1\x01"), r"\n+", "\x01"), "\x01", -1)
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = rows.select(B.scope_chunks(F.col("t")).alias("a"), steps.alias("b"), M.plain_spaces(F.col("t")).alias("c"), F.translate("t", P.UNICODE_SPACES, " " * len(P.UNICODE_SPACES)).alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows.collect())
