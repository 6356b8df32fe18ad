"""Chats, vectors, urls, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tests.harness import compare, oracle_connection
from veritrace.llm import chat, hamming, urls
from veritrace.llm.base import ready
from veritrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES, ORACLES, SF) is None


def test_chat_round_trip(spark):
    ready(spark)
    rng = random.Random(5)
    bits = ["<|", "|>", "\\", "<", "|", "<|end|>", "<|next|>", "\\|", "a", "é", "\n", "", "</s>[INST]", "<|role|>assistant<|body|>"]
    rows, turn = [], 0
    for conv in (*range(30), None):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", None, "<|role|>"])
            rows.append((conv, turn, role, None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), "x"))
    rows += [(77, None, "user", "first", "x"), (77, 0, "user", "same", "x"), (77, 0, "user", "same", "x"), (78, 0, "assistant", "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.filter("false")).count() == 0


@pytest.mark.parametrize("dim,block", [(64, 1 << 16), (64, 50), (20, 40), (7, 1000)])
def test_hamming_top_k(spark, dim, block):
    ready(spark)
    rng = np.random.default_rng(dim)
    vectors = [(i, [float(x) for x in rng.normal(size=dim)], "x") for i in range(300)]
    vectors += [(1000 + i, vectors[0][1], "x") for i in range(60)] + [(5, vectors[5][1], "x")]
    vectors += [(2000, None, "x"), (None, vectors[1][1], "x"), (2001, [], "x"), (2002, [1.0, float("nan"), None], "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string").repartition(4)
    asked = df.filter("vec_id in (0, 3, 5, 1003, 2000, 2002)")
    got = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in hamming.top_k(df, asked, k=10, block=block, query_block=2).collect())
    codes = {i: np.array(v) > 0 for i, v, _ in vectors if i is not None and v and i != 2002}
    want = []
    for q in (0, 3, 5, 1003):
        near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:10]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == want
    assert hamming.top_k(df.filter("false"), asked).count() == 0


def test_url_parts_and_rules(spark):
    ready(spark)
    cases = [
        (None, "", "", None), ("no scheme/a", "", "", None), ("http://A.Example.ORG/ES/x", "a.example.org", "/ES/x", ("org/", "allow")),
        ("http://example.org/es/1", "example.org", "/es/1", ("example.org/es/", "block")), ("x://notexample.org/en/1", "notexample.org", "/en/1", ("org/", "allow")),
        ("x://b.example.org/en/17?q#f", "b.example.org", "/en/17", ("example.org/en/1", "block")), ("x://a.com/fr/", "a.com", "/fr/", ("com/fr/", "allow")),
        ("x://a.com/de/1", "a.com", "/de/1", ("com/de/", "block")), ("x://a.org", "a.org", "", None), ("x://a.net?u=/fr/", "a.net", "", None),
        ("x://a.com#/fr/", "a.com", "", None), ("://", "", "", None), ("", "", "", None), ("x://h/a\nb://c", "h", "/a\nb://c", None), ("x://É.COM/fr/é", "É.com", "/fr/é", ("com/fr/", "allow")),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 0)], "page_id long, quality int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        r = got[i]
        assert (r.host, r.path) == (host, path), cases[i]
        assert (r.rule, r.verdict) == rule if rule else (r.rule is None and r.verdict == "allow"), cases[i]
    assert urls.judge_urls(pages.filter("false"), labels).count() == 0
    assert urls.judge_urls(pages, labels.filter("false")).filter("verdict is null").count() == 0


def test_templates_reject_impure_branches(spark):
    ready(spark)
    rows = [(i, f"http://h.net/spam/{i}.html") for i in range(40)] + [(100 + i, f"http://h.net/{w}/{i}") for i in range(40) for w in ("a", "b")]
    rows += [(500 + i, f"http://h.net/word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(p, 0 if "spam" in u else 1) for p, u in rows], "page_id long, quality int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels).collect()}
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[i].template for i in range(40)} == {"/spam/*//"}
    assert all(r.verdict == "allow" for p, r in got.items() if p >= 100)
    assert {got[500 + i].template for i in range(60)} == {"/*///"}
