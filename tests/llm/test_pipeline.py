"""Stages of the pipeline against brute force."""

from __future__ import annotations

import collections

import corpus_pipeline
import public_tokenizers
from tests.llm import edge
from veritrace.llm import mixing, quality
from veritrace.llm.base import ready, table

SF = "/root/testdata/sf0.001"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_are_told_by_five_words(spark):
    """A copy with new words at its end, of 5-word similarity 0.82."""
    ready(spark)
    own = [f"w{i}" for i in range(86)]
    rows = [(1, " ".join(own)), (2, " ".join(own + [f"n{i}" for i in range(18)])), (3, " ".join(f"o{i}" for i in range(86)))]
    a, b = (edge.shingles(t, 5) for _, t in rows[:2])
    assert len(a & b) / len(a | b) == 0.82
    got = corpus_pipeline.without_near_copies(spark, corpus(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def texts(df):
    return collections.Counter((r.doc_id, r.text or "") for r in df.collect())


def test_dedup_stages_on_the_awkward_table(spark):
    """Nulls, repeated rows and empty texts: one row for each group, and all its rows' groups are there."""
    ready(spark)
    df, rows = edge.documents(spark)
    df = df.cache()
    got = texts(corpus_pipeline.without_copies(spark, df, ""))
    squeezed = collections.Counter(edge.SPACE.sub("", t) for _, t in rows)
    assert collections.Counter(edge.SPACE.sub("", t) for _, t in got.elements()) == dict.fromkeys(squeezed, 1)
    assert not got - collections.Counter(rows)
    got = texts(corpus_pipeline.without_near_copies(spark, df, ""))
    empty = {r for r in rows if not edge.shingles(r[1])}
    groups = {c for r, (_, _, c) in zip(rows, edge.jaccard(rows, 80, 5)) if r not in empty and r[0] is not None}
    assert {r for r in got if r in empty} == empty and max(got.values()) == 1
    assert {i for i, t in got if (i, t) not in empty and i is not None} == groups - {None}


def test_mixture_takes_the_picks(spark):
    """Each pick of the mixture is a row, as often as its epochs say."""
    ready(spark)
    rows = [(i, f"text {i} " + "word " * (i % 9)) for i in range(60)]
    df = corpus(spark, rows)
    picks = collections.Counter(r.doc_id for r in mixing.mix(df, mixing.sample_domain(), mixing.sample_weights()).collect())
    assert collections.Counter(r.doc_id for r in corpus_pipeline.mixture(spark, df, "").collect()) == picks


def test_stages_on_an_empty_table(spark):
    ready(spark)
    df = corpus(spark, [(1, "a")]).filter("false")
    for stage in (corpus_pipeline.without_copies, corpus_pipeline.without_near_copies, corpus_pipeline.mixture, corpus_pipeline.packed):
        assert stage(spark, df, "").count() == 0


def test_quality_stage_and_run(spark):
    """The first stage keeps what the classifier accepts; the run has the pieces of what all stages keep."""
    from tokenizers import Tokenizer

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, quality.positives(labels)).collect()}
    good = corpus_pipeline.good_quality(spark, docs, SF).cache()
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD} and good.columns == list(corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    once = {keep for _, keep, _, _ in edge.exact(rows)[0]}
    rows = [r for r in rows if r[0] in once]
    least = {i for (i, t), (_, n, c) in zip(rows, edge.jaccard(rows, 80, 5)) if c == i or not n}
    left = good.filter(good.doc_id.isin(sorted(least)))
    picks = collections.Counter(r.doc_id for r in mixing.mix(left, mixing.sample_domain(), mixing.sample_weights()).collect())
    encode, text = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode, dict(rows)
    want = collections.Counter()
    for i, times in picks.items():
        length = len(encode(text[i], add_special_tokens=False).ids) + 1
        want.update({(i, piece): times for piece in range(-(-length // 4096))})
    assert collections.Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()) == want
