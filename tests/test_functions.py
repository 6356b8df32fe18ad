"""Column functions against plain Python and fixed expectations."""

import datetime as dt
import random

from pyspark.sql import functions as F

from veritrace.functions import labels, text as tx, values, vectors
from veritrace.functions.trigrams import similarity
from veritrace.operators import extraction, ingest

SPACES = [" ", "\t", "\n", " ", " ", "　", "\x85", "\x1c", " "]


def column(spark, values_, fn, type_="string"):
    rows = [(i, v) for i, v in enumerate(values_)]
    df = spark.createDataFrame(rows, f"i int, v {type_}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def random_texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcé₹漢😀" + "".join(SPACES)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_token_estimate_follows_python(spark):
    texts = [*random_texts(1), "", "  ", *[("w " * n) for n in (1, 5, 15, 25, 35, 45, 105)]]
    want = [max(1, round(len(t.split()) * 1.3)) for t in texts]
    assert column(spark, texts, tx.token_estimate) == want


def test_normalized_key(spark):
    texts = random_texts(2)
    assert column(spark, texts, tx.normalized_key) == [" ".join(t.split()).lower() for t in texts]


def test_snippet_cuts_on_character_boundaries(spark):
    texts = ["a" * 499 + "é" + "b", "a" * 500, "a" * 501, "a" * 498 + "₹₹", "a" * 497 + "😀x", "é" * 400, "😀" * 200]

    def model(t):
        raw = t.encode()
        if len(raw) <= 500:
            return t
        return raw[:500].decode("utf-8", "ignore") + "…"

    assert column(spark, texts, tx.snippet) == [model(t) for t in texts]


def test_repair_encoding(spark):
    damaged = ["â‚¹ 840 crore", "Itâ€™s", "cafÃ©", "café", "plain", "₹ 5", "naïve â", None]
    want = ["₹ 840 crore", "It’s", "café", "café", "plain", "₹ 5", "naïve â", None]
    assert column(spark, damaged, tx.repair_encoding) == want


def test_search_is_literal(spark):
    got = column(spark, ["Up 14% now", "Up 14 now", None], lambda c: tx.contains_literal(c, "14%"))
    assert got == [True, False, False]


def test_values(spark):
    got = column(
        spark,
        ["Rs. 840 crore", "INR 8.4 billion", "₹84,000 lakh", "14.1%", "$1.5 bn", "98,135 employees", "nothing", "-3 mn", None],
        values.normalize_value,
    )
    flat = [r and (float(r.amount), r.unit, r.currency) for r in got]
    assert flat == [
        (8.4e9, "crore", "INR"), (8.4e9, "billion", "INR"), (8.4e9, "lakh", "INR"), (14.1, "%", None),
        (1.5e9, "billion", "USD"), (98135.0, "employees", None), None, (-3e6, "million", None), None,
    ]


def test_periods(spark):
    got = column(
        spark,
        ["FY2025", "FY25", "financial year 2025", "FY2024-25", "Q1 FY26", "Q2 2024", "2024-03-31", "2024-04-01 to 2024-09-30",
         "2024", "CY2024", "someday", "2024-02-31", None],
        values.normalize_period,
    )
    d = dt.date
    fy25 = ("fiscal_year", d(2024, 4, 1), d(2025, 3, 31))
    assert [tuple(r) for r in got] == [
        fy25, fy25, fy25, fy25, ("quarter", d(2025, 4, 1), d(2025, 6, 30)), ("quarter", d(2024, 4, 1), d(2024, 6, 30)),
        ("date", d(2024, 3, 31), d(2024, 3, 31)), ("range", d(2024, 4, 1), d(2024, 9, 30)),
        ("calendar_year", d(2024, 1, 1), d(2024, 12, 31)), ("calendar_year", d(2024, 1, 1), d(2024, 12, 31)),
        ("unspecified", None, None), ("unspecified", None, None), ("unspecified", None, None),
    ]
    january = column(spark, ["FY2025"], lambda c: values.normalize_period(c, 1))[0]
    assert (january.start, january.end) == (d(2025, 1, 1), d(2025, 12, 31))


def test_trigram_similarity(spark):
    pairs = spark.createDataFrame([("word", "two words"), ("abc", "abc"), ("", ""), ("A-b", "a b")], "a string, b string")
    got = [round(r[0], 4) for r in pairs.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.3636, 1.0, 0.0, 1.0]


def test_labels(spark):
    assert column(spark, ["contradicts", "nonsense", None], labels.guard_label) == ["CONTRADICTS", "UNCERTAIN", "UNCERTAIN"]
    assert column(spark, [0.8, 0.6, 0.59], labels.confidence_band, "float") == ["high", "medium", "low"]
    assert column(spark, [0.125, 0.5], labels.confidence_percent, "float") == [13, 50]
    assert column(spark, ["uploaded", "odd"], labels.status_label) == ["Queued", "odd"]


def test_embed_hash(spark):
    rows = column(spark, ["same words here", "same words here", "other", ""], lambda c: vectors.embed_hash(c, 32))
    lengths = [sum(x * x for x in r) ** 0.5 for r in rows]
    assert rows[0] == rows[1] and rows[0] != rows[2]
    assert [round(n, 5) for n in lengths] == [1.0, 1.0, 1.0, 0.0]


def test_embed_with_loads_model_once_per_task_and_not_for_nothing(spark):
    def load():
        return lambda texts: [[float(len(t)), 0.0] for t in texts]

    embed = vectors.embed_with(load)
    assert column(spark, ["abc"], embed) == [[1.0, 0.0]]
    assert spark.createDataFrame([], "v string").select(embed(F.col("v"))).collect() == []


def find_span(text, quote):
    """One-pass model of grounding by collapsed whitespace."""
    if not quote.strip():
        return None
    if quote in text:
        return text.index(quote), text.index(quote) + len(quote)
    out, at = [], []
    for i, ch in enumerate(text):
        if not ch.isspace():
            out.append(ch), at.append(i)
        elif out and out[-1] != " ":
            out.append(" "), at.append(i)
    flat = "".join(out).rstrip(" ")
    wanted = " ".join(quote.split())
    i = flat.find(wanted)
    return None if i < 0 else (at[i], at[i + len(wanted) - 1] + 1)


def test_grounding_follows_model(spark):
    rng = random.Random(5)
    cases = [("a  b", "a b"), ("x a\n\nb.c y", "a b.c"), ("x", "y"), ("x", "  "), (r"p \E q", r"p  \E"), ("ab ab\tc", "ab c"), ("a😀 　b", "😀 b")]
    for text in random_texts(6, 200):
        i = rng.randrange(len(text) + 1)
        piece = text[i:i + rng.randrange(8)]
        cases.append((text, " ".join(piece.split()) if rng.random() < 0.7 else piece))
    df = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(cases)], "i int, text string, quote string")
    got = {r.i: (r.char_start, r.char_end) for r in extraction.ground(df).collect()}
    for i, (t, q) in enumerate(cases):
        assert got[i] == (find_span(t, q) or (None, None)), (t, q)


def test_page_methods(spark):
    rows = [
        (1, 1, "many words here to read", 100.0, None, None),
        (1, 2, "few", 1e6, "scanned text", [90.0, -1.0, 70.0]),
        (1, 3, "few", 1e6, " ", []),
        (1, 4, " ", 1e6, None, None),
        (1, 5, "few", 1e6, "scanned", [-1.0]),
    ]
    df = spark.createDataFrame(
        rows, "document_id int, page_number int, native_text string, area double, ocr_text string, ocr_words array<double>"
    )
    got = [(r.extraction_method, r.text, r.confidence and round(r.confidence, 4)) for r in ingest.extract_pages(df).orderBy("page_number").collect()]
    assert got == [
        ("native", "many words here to read", None), ("ocr", "scanned text", 0.8), ("native", "few", None),
        ("failed", "", None), ("ocr", "scanned", None),
    ]


def test_every_embedding_of_the_table(spark):
    """The registered query against hashes from another library, word by word."""
    import re

    import xxhash
    from veritrace.plans.all_queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for row in QUERIES["embed_hash"](spark, sf_dir).collect():
        words = [w.encode() for w in re.findall(r"\S+", texts[row.doc_id].lower())]
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in words]
        hashes += [xxhash.xxh64_intdigest(b, h) for b, h in zip(words[1:], hashes[: len(words)])]
        want = [0.0] * 64
        for h in map(signed, hashes):
            want[abs(h % 64)] += -1.0 if h < 0 else 1.0
        size = sum(x * x for x in want) ** 0.5
        assert max(abs(x - (y / size if size else 0.0)) for x, y in zip(row.embedding, want, strict=True)) < 1e-6
