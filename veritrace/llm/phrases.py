"""Phrases of words that belong together, mined level by level on stored relations.

The occurrence relation of length ``k`` has one entry for each place where a
frequent phrase of ``k`` words starts, sorted by piece and position. It is
stored in blocks, each of the pieces of some documents. One level:

1. merge join: occurrences of length ``k`` at adjacent positions of one piece meet, which gives
   the occurrences of length ``k + 1`` whose both parts of ``k`` words are frequent;
2. group count: each block sends an entry per distinct phrase with its count, and
   the entries of a phrase are summed. A phrase has no more of them than there are blocks,
   however often it occurs. The entries of phrases longer than a word travel packed, a row per block
   and bucket of phrases, and there are buckets enough for one to hold the phrases of a few blocks;
3. semi-join: the frequent ones go back to the blocks that have them, packed likewise, and each block
   keeps the occurrences of those, as the stored relation of the next level.

Positions leave a gap between pieces, so adjacent ones are of one piece. A word is named by the least of its
rows' keys and a longer phrase by its place in its bucket. It is told by its two parts, down to words compared as strings: no
hash stands for a phrase. Counts of all lengths are exact, since every part of a frequent phrase is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritrace.llm import words
from veritrace.llm.base import keep, partitions, table, text_or_empty

LONGEST, LEAST, TOP = 4, 30, 2000
#: A shorter phrase goes where a longer one around it has so many per cent of its count.
COVERED = 80
SCALE = 2_000_000
#: Words of a block, about; a text is never cut.
BLOCK = 1 << 20
#: A bucket holds as many entries as the distinct phrases of so many blocks.
BUCKET_BLOCKS = 1
#: A key is a block and the number of a phrase in it; a block is the turn of a task and the task.
CODE_BITS, TASK_BITS = 28, 20
SENT_ROWS = 1 << 16
COUNTED = "key long, lang string, word string, n long, data binary"
PAIRED = "bucket long, key long, data binary"
#: A phrase, or the phrases of a bucket that a block has, packed.
FREQUENT = "id long, left long, right long, f long, key long, bucket long, data binary"

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SPLIT.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pack(rising: list[np.ndarray], other: list[np.ndarray]) -> bytes:
    """Columns of numbers, the rising ones as gaps, byte by byte."""
    both = np.concatenate([*(np.diff(c, prepend=0) for c in rising), *other]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes, rising: int = 1, other: int = 1) -> list[np.ndarray]:
    wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    columns = np.split(np.ascontiguousarray(wide.reshape(8, -1).T).view("<i8").ravel(), rising + other)
    return [np.cumsum(c) for c in columns[:rising]] + columns[rising:]


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words, their rows, and how far each is from the one before: 1 in a piece, else 2."""
    starts, ends, counts = words.spans(buf, offsets, _GAP)
    row = np.repeat(np.arange(len(counts)), counts)
    piece = np.cumsum(_SPLIT[buf])[starts] if len(starts) else starts
    gaps = np.full(len(starts), 2, dtype=np.int64)
    gaps[1:] -= (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    solid = _LOWER[buf[~_GAP[buf]]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at.tobytes()), pa.py_buffer(solid.tobytes())), row, gaps


def _counted(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Per block: the distinct words of each language with their counts, and the relation of all words."""
    from pyspark import TaskContext

    task, turn, held, size = TaskContext.get().partitionId(), 0, [], 0
    langs: dict[str, int] = {}
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("data", pa.binary())])

    def flush() -> Iterator[pa.RecordBatch]:
        block = (turn << TASK_BITS | task) << CODE_BITS
        word = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
        own = len(word.dictionary)
        lang = pa.array(list(langs), pa.string())
        told, code, n = np.unique(np.concatenate([h[1] for h in held]) * own + word.indices.to_numpy(), return_inverse=True, return_counts=True)
        for a in range(0, len(told), SENT_ROWS):
            part = told[a : a + SENT_ROWS]
            columns = [
                pa.array(block + np.arange(a, a + len(part))), lang.take(pa.array(part // own)),
                word.dictionary.take(pa.array(part % own)).cast(pa.string()), pa.array(n[a : a + SENT_ROWS]), pa.nulls(len(part), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        data = _pack([np.cumsum(np.concatenate([h[2] for h in held]))], [code])
        yield pa.RecordBatch.from_pylist([{"key": block, "data": data}], schema=schema)

    for batch in batches:
        of = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"].to_pylist()], dtype=np.int64)
        for at, end, buf, offsets in words.pieces(batch["text"]):
            word, row, gaps = _tokens(buf, offsets)
            if len(word):
                held.append((word, of[at + row], gaps))
                size += len(word)
            if size >= block_words:
                yield from flush()
                held, size, turn = [], 0, turn + 1
    if held:
        yield from flush()


def _adjacent(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a relation with itself at the next position: where the left of each pair is, the
    distinct ids of the relation, and each pair as one number of their places there."""
    at = np.flatnonzero(np.diff(places) == 1)
    known, local = np.unique(ids, return_inverse=True)
    return at, known, local[at] * len(known) + local[at + 1]


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ right.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _paired(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per block and bucket: number in the block, left, right and count of each distinct pair."""
    for batch in batches:
        for key, data in zip(batch["key"].to_pylist(), batch["data"].to_pylist()):
            _, known, pair = _adjacent(*_unpack(data))
            told, n = np.unique(pair, return_counts=True)
            if not len(told):
                continue
            left, right = known[told // len(known)], known[told % len(known)]
            del pair, told
            bucket = _bucket(left, right, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for part in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:])):
                row = {"bucket": int(bucket[part[0]]), "key": key, "data": _pack([part, left[part]], [right[part], n[part]])}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("data", pa.binary())]))


def _summed(batches: Iterator[pa.RecordBatch], least: int, buckets: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The frequent pairs, bucket by bucket, and unless these are the ``last``, per block and bucket
    the numbers in the block of those it has with their places in the bucket, as ``_kept`` takes them."""
    at, held = None, []
    schema = pa.schema([(c, pa.binary() if c == "data" else pa.int64()) for c in ("id", "left", "right", "f", "key", "bucket", "data")])

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        order = np.lexsort(columns[:3])
        for c in range(4):
            columns[c] = columns[c][order]
        del order
        key, right, left, n = columns
        first = np.ones(len(key), dtype=bool)
        first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        starts = np.flatnonzero(first)
        f = np.add.reduceat(n, starts)
        often = f >= least
        place = np.cumsum(often) - 1
        sizes = np.diff(np.append(starts, len(key)))
        told = [place[often] * buckets + at, left[starts[often]], right[starts[often]], f[often]]
        for a in range(0, len(told[0]), SENT_ROWS):
            some = [pa.array(c[a : a + SENT_ROWS]) for c in told]
            none = [pa.nulls(len(some[0]), schema.field(c).type) for c in ("key", "bucket", "data")]
            yield pa.RecordBatch.from_arrays([*some, *none], schema=schema)
        if last:
            return
        some = np.repeat(often, sizes)
        key, place = key[some], np.repeat(place, sizes)[some]
        # In a block, both its numbers and the places in the bucket rise with the pair.
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        cuts = np.flatnonzero(np.diff(key >> CODE_BITS, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            block = int(key[a]) >> CODE_BITS << CODE_BITS
            row = {"key": block, "bucket": at, "data": _pack([key[a:b] - block, place[a:b]], [])}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for bucket, key, data in zip(*(batch[c].to_pylist() for c in ("bucket", "key", "data"))):
            if bucket != at and held:
                yield from flush()
            code, left, right, n = _unpack(data, 2, 2)
            at = bucket
            held.append((key + code, right, left, n))
    if held:
        yield from flush()


def _kept(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The relation of each block with only what is frequent, under its name. A block's names come before it:
    of pairs packed by bucket, of words, if there are no ``buckets``, one by one."""
    at, codes, ids = None, [], []
    for batch in batches:
        keys, names = batch["key"].to_numpy(), batch["id"]
        block = keys >> CODE_BITS
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if block[a] != at:
                at, codes, ids = block[a], [], []
            named, data = names.slice(a, b - a), batch["data"].slice(a, b - a)
            told = b - a - named.null_count
            if buckets:
                for bucket, packed in zip(named[:told].to_pylist(), data[:told].to_pylist()):
                    code, place = _unpack(packed, 2, 0)
                    codes.append(code)
                    ids.append(place * buckets + bucket)
            elif told:
                codes.append(keys[a : a + told] & ((1 << CODE_BITS) - 1))
                ids.append(named[:told].to_numpy())
            # At most one relation, the last row of its block.
            if named.null_count and codes:
                places, held = _unpack(data[told].as_py())
                code = held
                if buckets:
                    spot, _, pair = _adjacent(places, held)
                    places, code = places[spot], np.unique(pair, return_inverse=True)[1]
                every = np.concatenate(codes)
                name = np.full(max(int(code.max(initial=0)), int(every.max())) + 1, -1, dtype=np.int64)
                name[every] = np.concatenate(ids)
                name = name[code]
                left = name >= 0
                yield pa.RecordBatch.from_arrays([pa.array([int(at) << CODE_BITS]), pa.array([_pack([places[left]], [name[left]])], pa.binary())], names=["key", "data"])


def _frequent(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """The rows of frequent words, with their sum ``f`` and the name ``id``. A window is no wider than there are blocks."""
    own = Window.partitionBy(*by)
    told = rows.withColumns({"f": F.sum("n").over(own), "id": F.min("key").over(own)}).filter(F.col("f") >= least)
    return keep(told.select("key", "id", *(F.when(F.col("key") == F.col("id"), F.col(c)).alias(c) for c in (*by, "f"))), "frequent")


def _frequent_pairs(relation: DataFrame, least: int, buckets: int, last: bool = False) -> DataFrame:
    """The same for the pairs of a relation: each bucket holds all entries of its pairs."""
    packed = relation.mapInArrow(lambda it: _paired(it, buckets), PAIRED)
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return keep(dealt.mapInArrow(lambda it: _summed(it, least, buckets, last), FREQUENT), "frequent")


def _advance(relation: DataFrame, names: DataFrame, buckets: int, parts: int) -> DataFrame:
    """The relation of the ``names`` (key, id, data) of words, or of pairs in so many ``buckets``."""
    met = names.union(relation.select("key", F.lit(None).cast("long").alias("id"), "data")).withColumn("block", F.shiftright("key", CODE_BITS))
    met = met.repartition(parts, "block").sortWithinPartitions("block", F.col("id").isNull()).select("key", "id", "data")
    return keep(met.mapInArrow(lambda it: _kept(it, buckets), "key long, data binary"), "relation")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times or more in a language: (lang,
    phrase, k, f), and the number of all words of each language: (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    stored = keep(rows.mapInArrow(lambda it: _counted(it, block), COUNTED), "words")
    counted, relation = stored.filter("data is null"), stored.filter("data is not null").select("key", "data")
    # As many tasks as blocks would be one each; a few blocks follow each other in one.
    blocks = relation.count()
    parts, buckets = max(partitions(spark), blocks // 4), max(partitions(spark), blocks // BUCKET_BLOCKS)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = _frequent(counted.select("key", "lang", "word", "n"), ["lang", "word"], least)
    named = frequent.filter("key = id").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    found = [named.withColumn("k", F.lit(1))]
    names, packed = frequent.select("key", "id", F.lit(None).cast("binary").alias("data")), 0
    for k in range(2, longest + 1):
        relation = _advance(relation, names, packed, parts)
        frequent = _frequent_pairs(relation, least, buckets, k == longest)
        names, packed = frequent.filter("key is not null").select("key", F.col("bucket").alias("id"), "data"), buckets
        a, b = (named.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("lang", "phrase", "last"))) for side in ("left", "right"))
        named = keep(
            frequent.filter("key is null").select("id", "left", "right", "f").join(a, "left").join(b, "right").select(
                "id", F.col("lang_left").alias("lang"), F.concat_ws(" ", "phrase_left", "last_right").alias("phrase"), F.col("last_right").alias("last"), "f"
            ), "phrases",
        )
        found.append(named.withColumn("k", F.lit(k)))
    return keep(reduce(DataFrame.union, found).select("lang", "phrase", "k", "f"), "frequent"), totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, block: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text. Letters A to Z are lower-cased; ``. , ; : ! ?`` and line ends part
    pieces, and space and tab part words. ``a`` is how often the phrase occurs, overlaps included; ``l`` and ``r`` are those of
    its two parts at the cut of least score, ``floor(2000000 * a / (l + r))``, the earliest of equal ones. A
    phrase within a longer one that occurs at least ``covered`` per cent as often is left out. Null languages are
    ``und``, null and empty texts have no words, repeated rows count each, and ties go to more occurrences, then
    to the phrase in byte order. Texts of any length are taken whole. An empty table gives no rows.
    """
    frequent, totals = frequent_phrases(docs, longest, least, block)
    candidates = frequent.filter("k > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest")
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn(
        "score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    inner = candidates.filter("k > 2").select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p
), o AS (
    SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(ws) >= k
), f AS (
    SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM o GROUP BY ALL
), c AS (
    SELECT * FROM f WHERE k > 1 AND f >= 30
), u AS (
    SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM c
), s AS (
    SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
    FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), b AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), g AS (
    SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k
        AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 80 * x.f
), z AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b ANTI JOIN g USING (lang, phrase)
), n AS (
    SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
