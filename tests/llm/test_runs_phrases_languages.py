"""Periodic runs, phrases and languages against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import edge
from veritrace.llm import languages, phrases, runs
from veritrace.llm.base import ready, table

SF = "/root/testdata/sf0.001"


def test_runs_of_random_strings():
    rng = random.Random(9)
    for _ in range(1500):
        symbols = [rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            symbols = symbols[:8] + symbols[8 : 8 + rng.randint(1, 9)] * rng.randint(1, 9) + symbols[20:28]
        for least, times in ((3, 3), (9, 3), (24, 3), (12, 4)):
            assert [tuple(r) for r in runs.find_runs(symbols, least, times).tolist()] == edge.runs(symbols, least, times)


def test_runs_reach_across_the_whole_text_and_overlap():
    one = [1] * 5000
    assert runs.find_runs(one).tolist() == [[0, 5000, 1]]
    nested = ([1] * 30 + [2] * 3) * 4 + [1]
    assert [tuple(r) for r in runs.find_runs(nested).tolist()] == edge.runs(nested)
    fibonacci, before = [1, 2], [1]
    while len(fibonacci) < 2000:
        fibonacci, before = fibonacci + before, fibonacci
    assert [tuple(r) for r in runs.find_runs(fibonacci, 9, 3).tolist()] == edge.runs(fibonacci, 9, 3)


def _planted(i, text):
    w = edge.WORD.findall(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
    return w


def test_runs_query_on_the_awkward_table(spark):
    ready(spark)
    df, rows = edge.documents(spark)
    text = runs.planted(runs.F.col("doc_id"), runs.F.col("text")).alias("text")
    docs = df.select("doc_id", runs.text_or_empty().alias("text"), "size", "bucket").select("doc_id", text, "size")
    found = runs.periodic_runs(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, runs.digest(found).collect()), key=repr)
    want = []
    for i, t in rows:
        w = _planted(i, t)
        own = edge.runs(w)
        gone = {x for s, n, p in own for x in range(s + p, s + n)}
        best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2])) if own else None
        want.append((
            i, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in own)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)),
        ))
    assert got == sorted(want, key=repr)
    assert sum(w[1] for w in want) >= 2
    assert runs.periodic_runs(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, 5, 3)


@pytest.mark.parametrize("least,longest,block", [(2, 4, 1 << 22), (3, 4, 50), (2, 3, 700), (5, 2, 1)])
def test_phrases_on_the_awkward_table(spark, least, longest, block):
    ready(spark)
    df, _ = edge.documents(spark)
    more = [(1, "a b, a b; A B\x0bA b\r\na  b\tc. a b c! a b c? x\u00a0y x\u00a0y", lang, *(["z"] * 12)) for lang in ("und", None, "de")]
    df = df.union(spark.createDataFrame([r[: len(df.columns)] for r in [(m[0], m[1], m[2], "s", 0, *m[3:]) for m in more]], df.schema))
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    got = sorted(map(tuple, phrases.collocations(df, longest, least, 40, block=block).collect()))
    assert got == sorted(edge.collocations(rows, longest, least, 40))
    assert len(got) > 20
    assert phrases.collocations(df.filter("false")).count() == 0


def test_frequent_pairs_are_no_row_per_pair_and_block(spark):
    ready(spark)
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 30, 3000) for _ in range(12)]
    relation = spark.createDataFrame(
        [(b << phrases.CODE_BITS, phrases._pack([np.arange(3000)], [x])) for b, x in enumerate(ids)], "key long, data binary"
    )
    rows = phrases._frequent_pairs(relation, 20, 4).collect()
    told = Counter(pair for x in ids for pair in zip(x[:-1].tolist(), x[1:].tolist()))
    want = {pair: n for pair, n in told.items() if n >= 20}
    found = [r for r in rows if r.left is not None]
    assert {(r.left, r.right): r.f for r in found} == want and len(found) == len(want) == len({r.id for r in found})
    # Each of some 900 pairs is in most of the 12 blocks, which take no more than a row per bucket.
    assert len(want) > 800 and len(rows) <= len(want) + 12 * 4


def test_languages_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    rows = {r.doc_id: r for r in docs.select("doc_id", "lang", "text").collect()}
    assert set(got) == set(rows)
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if r.held_out) == sorted(held)
    assert np.mean([got[i].lang_pred == rows[i].lang for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(x.share for x in r.languages) - 1) < 1e-6 for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = table(spark, SF, "documents")
    other = docs.withColumns({"lang": languages.F.when(languages.held_out(), "zz").otherwise(languages.F.col("lang")), "source": languages.F.lit("s")})
    assert sorted(map(tuple, languages.identify(docs).collect())) == sorted(map(tuple, languages.identify(other).collect()))


def test_mixtures_reach_the_best_proportions():
    rng = np.random.default_rng(4)
    size = 1 << languages.BITS
    own = [rng.dirichlet(np.full(400, 0.3)) for _ in range(3)]
    counts = {}
    for name, p in zip("abc", own):
        counts[name] = np.zeros(size, dtype=np.int64)
        counts[name][:400] = (p * 1e7).astype(np.int64)
    model = languages.Model(counts)
    for share in ([1, 0, 0], [0, 0.3, 0.7], [0.2, 0.3, 0.5]):
        drawn = rng.multinomial(6000, sum(s * p for s, p in zip(share, own)))
        bucket = np.flatnonzero(drawn)
        got = model.mixtures(np.zeros(len(bucket), dtype=np.int64), bucket, drawn[bucket], 1)[0]
        assert np.abs(got - share).max() < 0.05 and ((got > 0) == (np.array(share) > 0)).all()
        # No mixture on a fine grid is likelier than what was found, beyond the penalty for its languages.
        like = model.likelihood[bucket].astype(float)
        best = max(
            float((drawn[bucket] * np.log(like @ np.array([x, y, 1 - x - y]) + 1e-300)).sum())
            for x in np.linspace(0, 1, 41) for y in np.linspace(0, 1 - x, 41)
        )
        assert best - float((drawn[bucket] * np.log(like @ got)).sum()) < languages.GRAM * np.log(6000) + 1


def test_languages_of_awkward_rows(spark):
    ready(spark)
    df, rows = edge.documents(spark)
    got = languages.identify(df).collect()
    assert len(got) == len(rows)
    learned = {"en", "de", "fr"}
    for r in got:
        assert r.lang_pred in learned | {"und"} and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not r.languages) and (r.languages or r.score == 0)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[15] in learned
    assert {r.lang_pred for r in languages.identify(df.withColumn("lang", languages.F.lit(None).cast("string"))).collect()} == {"und"}
    assert languages.identify(df.filter("false")).count() == 0
