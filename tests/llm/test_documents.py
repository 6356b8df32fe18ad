"""Operators on documents against brute force, on an awkward table and an empty one."""

from __future__ import annotations

import collections
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm import edge
from veritrace.llm import components, exact_dedup, jaccard, mixing, packing, quality, sharding, sketch, substrings, words
from veritrace.llm.base import ready

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    ready(spark)
    df, rows = edge.documents(spark)
    return df.cache(), rows


@pytest.fixture(scope="module")
def empty(table):
    return table[0].filter("false")


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_exact_dedup(table, empty):
    df, rows = table
    got = exact_dedup.exact_dedup(df).collect()
    want, groups = edge.exact(rows)
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(want)
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("bits", [8, 22, 24])
def test_substrings(table, empty, bits):
    """A sketch that is full, one slice wide, or several slices wide gives the same."""
    df, rows = table
    got = substrings.substring_dedup(df, bits=bits).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == order(edge.substrings(rows))
    for r in got:
        assert r.n_removed == sum(s.end - s.first for s in r.spans)
    assert substrings.substring_dedup(empty, bits=8).count() == 0


@pytest.mark.parametrize("bits", [8, 22])
def test_jaccard(table, empty, bits):
    df, rows = table
    got = jaccard.jaccard_components(df, bits=bits).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(edge.jaccard(rows))
    assert jaccard.jaccard_components(empty, bits=8).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_chains(spark, seed):
    """Near copies of near copies: links form chains whose ends do not link."""
    ready(spark)
    rng = random.Random(seed)
    rows = []
    for family in range(4):
        own = [f"f{family}w{i}" for i in range(rng.randint(30, 90))]
        for step in range(25):
            own = list(own)
            own[rng.randrange(len(own))] = f"n{family}-{step}"
            rows.append((len(rows) * 3 % 101, " ".join(own + ["common line of several words here"] * (family % 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(df, bits=16).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(edge.jaccard(rows))


def test_jaccard_with_a_full_sketch(spark):
    """A sketch that takes all n-grams for common: only those in several prefixes are posted, and only texts of pairs that may link are read again."""
    from unittest import mock

    rng = np.random.default_rng(12)
    line = " ".join(f"line{j}" for j in range(8))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 60)) + " " + line) for i in range(150)]
    rows += [(500 + i, " ".join(f"v{x}" for x in rng.integers(0, 100_000, 80))) for i in range(50)]
    rows += [(200 + i, rows[i][1] + f" more{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read, posted, verified, postings = [], [], jaccard.verified, jaccard.shared_postings

    def seen(pairs, entries, percent):
        read.append(entries.count())
        return verified(pairs, entries, percent)

    def told(entries):
        found = postings(entries)
        posted.append({r.token for r in found.groupBy("token").count().filter("count = 1").collect()})
        return found

    with mock.patch.object(jaccard, "verified", seen), mock.patch.object(jaccard, "shared_postings", told):
        got = jaccard.jaccard_components(df, bits=3).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(edge.jaccard(rows))
    assert posted == [set()] and read[0] == 10 and sum(read) <= 20


def test_signatures_bound_the_difference():
    """Never more than the n-grams in one set only, whatever the sizes; and all of them if there are few."""
    rng = np.random.default_rng(13)
    for n, m, shared in ((1, 1, 0), (50, 70, 40), (300, 200, 200), (5000, 700, 650), (100, 100, 100)):
        grams = np.unique(rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64))
        a, b = grams[:n], grams[n - shared :]
        told = jaccard.least_difference(jaccard.signature(a), jaccard.signature(b))
        assert told <= n + m - 2 * shared and (told > 0 or n == m == shared)


def test_jaccard_deals_a_common_gram(spark):
    """An n-gram with one large component and stragglers: no task's group holds
    it, the component does not meet itself, and no pair of two components is lost."""
    ready(spark)
    rng, block = random.Random(1), 32
    rows = [(5, i, n := rng.randint(80, 130), n - rng.randint(0, 10), 0) for i in range(1500)]
    rows += [(5, 2000 + i, n := rng.randint(60, 130), n - rng.randint(0, 20), 2000 + i % 40) for i in range(60)]
    rows += [(6, i, 100, 90, 0) for i in range(50)] + [(7, 1, 100, 90, 0), (7, 2000, 100, 90, 2000), (7, 3000, 20, 20, 3000)]
    df = spark.createDataFrame(rows, "token long, r long, n int, most int, comp long").repartition(4)
    groups = collections.defaultdict(list)
    for r in jaccard.dealt(df, 85, block).collect():
        groups[r.token, r.x, r.y].append(r)
    assert max(map(len, groups.values())) <= 4 * block and 6 not in {key[0] for key in groups}
    assert all(len({r.comp for r in own}) > 1 for own in groups.values())
    assert sum(map(len, groups.values())) < 20 * len(rows)
    want = {
        (min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows
        if a[0] == b[0] and a[4] != b[4] and 100 * min(a[2], b[2]) >= 85 * max(a[2], b[2]) and 185 * min(a[3], b[3]) >= 85 * (a[2] + b[2])
    }
    got = [(r.a, r.b) for r in jaccard.crossing(df, 85, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1500


def test_jaccard_in_small_blocks(spark):
    """A family of chains whose n-grams all span several blocks."""
    ready(spark)
    rng, rows = random.Random(9), []
    own = [f"w{i}" for i in range(60)]
    for step in range(120):
        own = list(own)
        own[rng.randrange(len(own))] = f"n{step}"
        rows.append((step * 7 % 121, " ".join(own)))
        if step % 5 == 0:
            rows.append((200 + step, " ".join(own + [f"x{step}-{i}" for i in range(rng.randint(0, 14))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(df, bits=16, block=3).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(edge.jaccard(rows))


def test_components_of_a_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}
    assert components.components(links.filter("false")).count() == 0


def test_packing(table, empty):
    df, rows = table
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        total += len(ids)
        for p, start in enumerate(range(0, len(ids), 64)):
            want[(i, p, start, len(ids[start : start + 64]), edge.crc(ids[start : start + 64]))] += 1
    got = packing.pack(df, PATH, capacity=64).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-total // 64) * 1.03 + 1
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(3, 1, 3000).astype(int) + 1, 1, 100)
    hist = dict(collections.Counter(sizes.tolist()))
    runs = packing.plan(hist, 100)
    fill, used = collections.Counter(), collections.Counter()
    for size, first, n, sequence, each, offset in runs:
        assert first == used[size]
        used[size] += n
        for i in range(n):
            assert offset + (i % each) * size == fill[sequence + i // each]
            fill[sequence + i // each] += size
    assert used == hist and max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= max(-(-int(sizes.sum()) // 100), int((sizes > 50).sum())) * 1.02 + 1


def test_sharding(table, empty):
    df, rows = table
    got = sharding.lpt_shards(df, 4).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert order((r.doc_id, r.size) for r in got) == order((i, len(t.encode()) + 1) for i, t in rows)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    assert sharding.lpt_shards(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_deal_is_like_the_heap(seed):
    """Bulk dealing is as even as one group at a time."""
    rng = random.Random(seed)
    classes = [(s, n := rng.randint(1, 400), s * n) for s in rng.sample(range(1, 500), 60)] + [(9999, 1, 9999 * 20)]
    dealt = sharding.deal(classes, 8)
    load, plain = [0] * 8, [0] * 8
    size = {k: t // n for k, n, t in classes}
    for key, given in dealt:
        assert sum(given) == next(n for k, n, _ in classes if k == key)
        load = [a + size[key] * g for a, g in zip(load, given)]
    for key, n, _ in sorted(classes, key=lambda c: -size[c[0]]):
        for _ in range(n):
            i = plain.index(min(plain))
            plain[i] += size[key]
    assert max(load) == max(plain)
    assert max(load[:]) - min(load) <= max(max(plain) - min(plain), 500)


def test_quality(table, empty, spark):
    df, rows = table
    none = spark.createDataFrame([], "doc_id long")
    got = quality.quality_scores(df, none).collect()
    assert len(got) == len(rows)
    some = quality.quality_scores(df, df.select("doc_id")).collect()
    assert len(some) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in some)
    assert {r.score for r in some if r.doc_id in (1, 2)} and len({r.score for r in some if r.doc_id in (1, 2)}) == 1
    assert quality.quality_scores(empty, none).count() == 0


def test_prior_and_held_out_accuracy(spark):
    """On the labelled sample: the prior is near the share, and held-out texts are told apart."""
    ready(spark)
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in quality.query(spark, d).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in got if labels[r.doc_id] == q] for q in (1, 0))
    better = np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])
    assert better > 0.97
    assert np.mean(np.array(good) >= 0.3) > 0.97 and np.mean(np.array(bad) < 0.3) > 0.8


def test_mixing(table, empty):
    df, rows = table
    weights = {name: mixing.weighted(name, {"de": 3}) for name in mixing.LEVELS}
    got = mixing.mix(df, mixing.sample_domain(), weights, epochs=3).collect()
    leaves = collections.defaultdict(collections.Counter)
    for r in got:
        leaves[r.domain, r.lang, r.source][r.epoch] += 1
    for own in leaves.values():
        counts = [own[e] for e in range(max(own) + 1)]
        assert max(own) < 3 or own[3] == 0
        assert all(a >= b for a, b in zip(counts, counts[1:]))
    assert mixing.mix(empty, mixing.sample_domain(), weights).count() == 0
    longest = max(len(edge.WORD.findall(t)) for _, t in rows)
    total = sum(len(edge.WORD.findall(t)) for _, t in rows)
    assert total - len(leaves) - 20 <= sum(r.n_tokens for r in got) <= total + longest * len(leaves)


def test_shortage_goes_to_siblings_first(spark):
    ready(spark)
    leaves = spark.createDataFrame(
        [("a", "en", "x", 10), ("a", "en", "y", 1000), ("a", "de", "z", 1000), ("b", "en", "v", 1000)],
        "domain string, lang string, source string, tokens long",
    )
    from pyspark.sql import functions as F

    weights = {name: mixing.weighted(name, {}) for name in mixing.LEVELS}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, weights, F.lit(400), 1).collect()}
    # a and b get 200 each; a's languages 100 each; x holds 10, its sibling y takes the 40 it lacks.
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 90, ("a", "de", "z"): 100, ("b", "en", "v"): 200}


def test_weight_zero_is_no_capacity(spark):
    """What a domain holds in a language of weight 0 does not draw budget from its siblings."""
    ready(spark)
    leaves = spark.createDataFrame(
        [("a", "en", "x", 10), ("a", "de", "z", 1000), ("b", "en", "v", 1000), ("b", "en", "off", 1000)],
        "domain string, lang string, source string, tokens long",
    )
    from pyspark.sql import functions as F

    zero = {"lang": {"de": 0}, "source": {"off": 0}}
    weights = {name: mixing.weighted(name, zero.get(name, {})) for name in mixing.LEVELS}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, weights, F.lit(400), 1).collect()}
    assert got == {("a", "en", "x"): 10, ("b", "en", "v"): 390}


def test_sketch_never_underestimates(spark):
    ready(spark)
    values = np.random.default_rng(1).integers(0, 400, 3000).astype(np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)

    def hashes(batches):
        for batch in batches:
            yield words.mix(batch["v"].to_numpy().astype(np.uint64))

    counts = collections.Counter(values.tolist())
    for bits in (6, 20):
        seen = sketch.build(df, hashes, bits, (2, 9))
        levels = seen.level(words.mix(np.arange(400, dtype=np.uint64)))
        true = np.array([(counts[v] >= 2) + (counts[v] >= 9) for v in range(400)])
        assert (levels >= true).all()
        assert bits == 6 or (levels == true).mean() > 0.99
