"""Exact n-gram Jaccard join with vertical partitioning.

Texts are sets of word n-grams (64-bit hashes). All n-grams have one global
order: by how often a count-min sketch has seen them, rare first, then by hash. Equal sets are
joined at once and go on as one representative, the row of least id.

Candidates. Two sets with ``100 * |A & B| >= percent * |A | B|`` share one of
the first ``n - ceil(percent * n / 100) + 1`` n-grams of each. N-grams seen
once match nothing, and the place of the first shared one bounds the overlap
from above. Rows of one such n-gram are not paired with each other: they are
first compared with the one among them that has it earliest in its order, the
least altered of a group of near copies, which joins the bulk of the group in
one round. Only pairs that are then still in different components, and pass
the bounds on size and overlap, are compared in a second round. So the
components are exact. A group of m near copies that the first round joins costs
about m comparisons; a row that it leaves apart is compared with all that pass the
bounds. An n-gram's rows are dealt to blocks of near size, and to pairs of blocks of
different components, so no task holds an n-gram.

Comparison. A row's signature has a bit for the parity of its n-grams in each of about as many cells as it has n-grams.
Two sets differ by as many n-grams at least as their signatures by bits, which rules out most pairs that do not link.
For the rows of the others the n-grams are taken from the texts again. The order is cut into fragments, those of its rarer n-grams first. A pair's overlap is
counted in each fragment on its own and summed per pair. N-grams seen once are in no
fragment, as no other set has them. The prefixes choose which pairs are compared.

Size. A full sketch takes all n-grams for repeated. What is sent and stored is the prefixes, of which those in one prefix only
are dropped at once by an exact count, and the n-grams of rows in pairs; never the n-grams of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritrace.llm import sketch, words
from veritrace.llm.base import id_or_null, identified, keep, partitions, table
from veritrace.llm.components import components

GRAM, PERCENT = 4, 85
#: Counters per sketch row, as a power of two, and the two counts that part the order.
SKETCH_BITS, OFTEN = 27, (2, 64)
FRAGMENTS = 8
#: Rows of one n-gram that the second round holds at once, about.
BLOCK = 2048
SET = "_id long, _h long, n int, k1 long, k2 long"
ENTRY = "_id long, _h long, n int, single int, rare int, prefix array<long>, sign binary"
GRAMS = "_id long, _h long, n int, grams array<binary>"
#: Cells of the bits that tell which texts to read again, as a power of two; texts that share a cell are read, too, and left out by a join.
CELL_BITS = 26


def gram_sets(column: pa.Array, k: int, hasher: words.Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text that has words."""
    for row, end, buf, offsets in words.pieces(column):
        starts, ends, counts = words.spans(buf, offsets)
        h = hasher.words(buf, starts, ends)
        at, _, _ = words.window_places(counts, k)
        grams = words.join_hashes(h, k)[at]
        cuts = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))])
        first = np.concatenate([[0], np.cumsum(counts)])
        for i, n in enumerate(counts):
            if n >= k:
                yield row + i, np.unique(grams[cuts[i] : cuts[i + 1]])
            elif n:
                yield row + i, words.join_hashes(h[first[i] : first[i + 1]], int(n))


def _set_keys(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hasher = words.Hasher(21, lower=True)
    salt = np.uint64(0xA0761D6478BD642F)
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int32)
        keys = np.zeros((2, batch.num_rows), dtype=np.uint64)
        for row, grams in gram_sets(batch["text"], k, hasher):
            n[row] = len(grams)
            keys[:, row] = words.mix(grams + salt).sum(), words.mix(grams ^ salt).sum()
        yield pa.RecordBatch.from_arrays(
            [batch["_id"], batch["_h"], pa.array(n), *(pa.array(x.view(np.int64)) for x in keys)], names=["_id", "_h", "n", "k1", "k2"]
        )


def _gram_batches(k: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher = words.Hasher(21, lower=True)
        for batch in batches:
            # Equal sets of one batch count once.
            seen, held = set(), []
            for _, grams in gram_sets(batch["text"], k, hasher):
                key = (len(grams), int(words.mix(grams).sum()))
                if key not in seen:
                    seen.add(key)
                    held.append(grams)
            if held:
                yield np.concatenate(held)

    return hashes


def signature(grams: np.ndarray) -> bytes:
    """The parity of the number of n-grams in each cell; as many cells as n-grams or up to twice that, 64 at least."""
    cells = max(64, 1 << (len(grams) - 1).bit_length())
    counts = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """N-grams at least that are in one of two sets of these signatures only."""
    x, y = (np.frombuffer(s, dtype=np.uint8) for s in (a, b))
    # The larger one is folded to the cells of the smaller.
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _entries(batches: Iterator[pa.RecordBatch], k: int, percent: int, seen) -> Iterator[pa.RecordBatch]:
    """Sets that may have a partner, with their prefix and their signature. The first ``rare`` of a
    prefix are in less sets than the last count of the sketch."""
    hasher = words.Hasher(21, lower=True)
    types = {"n": pa.int32(), "single": pa.int32(), "rare": pa.int32(), "prefix": pa.list_(pa.int64()), "sign": pa.binary()}
    for batch in batches:
        ids, text_h = batch["_id"].to_numpy(), batch["_h"].to_numpy()
        out = {c: [] for c in ("_id", "_h", "n", "single", "rare", "prefix", "sign")}
        for row, grams in gram_sets(batch["text"], k, hasher):
            level, n = seen.value.level(grams), len(grams)
            need = n - (-(-percent * n // 100)) + 1
            single = int((level == 0).sum())
            if single >= need:
                continue
            order = np.lexsort((grams, level))[single:need]
            rare = int((level[order] < len(OFTEN)).sum())
            for c, v in zip(out, (ids[row], text_h[row], n, single, rare, grams[order].view(np.int64), signature(grams))):
                out[c].append(v)
        if out["_id"]:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def _fragments(batches: Iterator[pa.RecordBatch], k: int, seen, wanted) -> Iterator[pa.RecordBatch]:
    """The n-grams of the texts whose cell is wanted, in fragments."""
    hasher = words.Hasher(21, lower=True)
    # Each level of the order that can be shared is cut into as many fragments.
    each = FRAGMENTS // len(OFTEN)
    cuts = np.arange(1, each, dtype=np.uint64) * np.uint64((1 << 64) // each)
    types = {"n": pa.int32(), "grams": pa.list_(pa.binary())}
    for batch in batches:
        cell = batch["cell"].to_numpy()
        batch = batch.filter(pa.array((wanted.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
        ids, text_h = batch["_id"].to_numpy(), batch["_h"].to_numpy()
        out = {c: [] for c in ("_id", "_h", "n", "grams")}
        for row, grams in gram_sets(batch["text"], k, hasher):
            level = seen.value.level(grams)
            parts = [p for at in range(1, len(OFTEN) + 1) for own in (grams[level == at],) for p in np.split(own, np.searchsorted(own, cuts))]
            for c, v in zip(out, (ids[row], text_h[row], len(grams), [p.tobytes() for p in parts])):
                out[c].append(v)
        if out["_id"]:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def _possible(a: str, b: str, percent: int):
    """Whether sizes and places leave room for enough overlap. At the first
    n-gram that two sets share, none before it is shared, so no more than
    what follows in either can be (``most``). At later ones less is left, so
    a pair that fails here at its first fails at all."""
    most = F.least(F.col(f"{a}.most"), F.col(f"{b}.most"))
    return most * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _hopeful(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch["sizes"].to_numpy()
        apart = np.array([least_difference(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())], dtype=np.int64)
        keep_ = (sizes - apart) // 2 * (100 + percent) >= sizes * percent
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep_))


def hopeful(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for enough overlap."""
    signs = entries.select("r", F.col("n").cast("long").alias("n"), "sign")
    sides = pairs.join(signs.select(F.col("r").alias("a"), F.col("n").alias("na"), F.col("sign").alias("x")), "a").join(
        signs.select(F.col("r").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("y")), "b"
    )
    return sides.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "x", "y").mapInArrow(lambda it: _hopeful(it, percent), "a long, b long")


def _cells(cells: DataFrame, bits: int = CELL_BITS) -> np.ndarray:
    """A bit for each cell that occurs, eight to a byte."""
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    # Spark's bitmaps count from 1.
    place = F.col("cell") + 1
    told = cells.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for row in told.collect():
        piece = np.frombuffer(row["bits"], dtype=np.uint8)[: len(out)]
        at = (row["at"] - 1) * len(piece)
        out[at : at + len(piece)] = piece
    return out


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [
            len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["sizes"], pa.array(shared, pa.int64())], names=["a", "b", "sizes", "shared"])


def verified(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps per fragment, summed per pair."""
    cut = entries.select("r", "n", F.posexplode("grams").alias("f", "g"))
    sides = pairs.join(cut.select(F.col("r").alias("a"), F.col("n").alias("na"), "f", F.col("g").alias("x")), "a").join(
        cut.select(F.col("r").alias("b"), F.col("n").alias("nb"), "f", F.col("g").alias("y")), ["b", "f"]
    )
    counted = sides.select("a", "b", (F.col("na") + F.col("nb")).cast("long").alias("sizes"), "x", "y").mapInArrow(
        _overlaps, "a long, b long, sizes long, shared long"
    )
    summed = counted.groupBy("a", "b", "sizes").agg(F.sum("shared").alias("shared"))
    return summed.filter(F.col("shared") * (100 + percent) >= F.col("sizes") * percent).select("a", "b")


def _crossing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one n-gram's rows that are in different components and pass the
    bounds. Rows come sorted by n-gram and pair of blocks (x, y), ``own`` first
    the rows of x, then of y; those of x meet those of y as arrays, and each
    other if x is y."""
    at, held = None, []
    done: set[tuple[int, int]] = set()

    def finish() -> Iterator[pa.RecordBatch]:
        rows = np.array(held, dtype=np.int64)
        held.clear()
        one = at[1] == at[2]
        mine, theirs = (rows, rows) if one else (rows[rows[:, 0] == 0], rows[rows[:, 0] == 1])
        theirs = theirs[np.argsort(theirs[:, 2], kind="stable")]
        _, r, n, most, comp = theirs.T
        left, right = [], []
        for _, r0, n0, most0, comp0 in mine:
            # Sizes of which neither is less than so many per cent of the other.
            j = slice(np.searchsorted(n * 100, n0 * percent), np.searchsorted(n * percent, n0 * 100, side="right"))
            fits = (comp[j] != comp0) & (np.minimum(most[j], most0) * (100 + percent) >= percent * (n[j] + n0))
            for other in r[j][fits]:
                pair = (int(min(r0, other)), int(max(r0, other)))
                if pair not in done:
                    done.add(pair)
                    left.append(pair[0])
                    right.append(pair[1])
                    if len(left) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                        left, right = [], []
            if len(done) > 1 << 20:
                done.clear()
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("token", "x", "y", "own", "r", "n", "most", "comp")]
        for token, x, y, *row in zip(*columns):
            if (token, x, y) != at and held:
                yield from finish()
            at = (token, x, y)
            held.append(row)
    if held:
        yield from finish()


def dealt(labelled: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The rows (token, r, n, most, comp) of n-grams that span components, once for
    each pair of blocks (x, y) in which they may meet a row of another component.

    A block has about ``block`` rows of one n-gram and of near size: of one component if that
    has as many, else of several. Blocks of the same single component do
    not meet, nor blocks whose bounds on size and overlap let no pair through."""
    band = F.floor(F.log("n") / F.log(F.lit(max(100 / percent, 1.01)))).alias("band")
    parts = labelled.groupBy("token", "comp", band).agg(F.count(F.lit(1)).alias("m"))
    spans = parts.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("m").alias("all")).filter("c0 != c1")
    # An n-gram of few rows is one block; in others, what is small of one band goes together.
    home = F.when(F.col("all") <= block, F.lit(0)).when(F.col("m") >= block, F.xxhash64("comp", "band")).otherwise(F.xxhash64("band"))
    parts = parts.join(spans.select("token", "all"), "token").withColumn("home", home)
    deals = parts.groupBy("token", "home").agg(F.ceil(F.sum("m") / block).alias("deal"))
    places = parts.select("token", "comp", "band", "home").join(deals, ["token", "home"])
    rows = labelled.select("*", band).join(places, ["token", "comp", "band"])
    rows = rows.withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("r"), "deal")))
    rows = keep(rows.select("token", "r", "n", "most", "comp", "block"), "far")
    told = rows.groupBy("token", "block").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("most").alias("most")
    )
    x, y = (told.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("block", "c0", "c1", "n0", "n1", "most"))) for s in "xy")
    near = (F.col("n1x") * 100 >= F.col("n0y") * percent) & (F.col("n1y") * 100 >= F.col("n0x") * percent)
    room = F.least("mostx", "mosty") * (100 + percent) >= percent * (F.col("n0x") + F.col("n0y"))
    apart = F.least("c0x", "c0y") != F.greatest("c1x", "c1y")
    pairs = x.join(y, "token").filter(F.col("blockx") <= F.col("blocky")).filter(apart & near & room).select("token", F.col("blockx").alias("x"), F.col("blocky").alias("y"))
    sides = pairs.select("token", "x", "y", F.explode(F.expr("if(x = y, array(0), array(0, 1))")).alias("own"))
    sides = sides.withColumn("block", F.when(F.col("own") == 0, F.col("x")).otherwise(F.col("y")))
    return rows.join(sides, ["token", "block"]).select("token", "x", "y", "own", "r", "n", "most", "comp")


def crossing(labelled: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) of rows that share an n-gram, are in different components and pass the bounds."""
    keys = ["token", "x", "y"]
    far = dealt(labelled, percent, block).repartition(partitions(labelled.sparkSession), *keys).sortWithinPartitions(*keys)
    return far.mapInArrow(lambda it: _crossing(it, percent), "a long, b long").distinct()


def shared_postings(entries: DataFrame) -> DataFrame:
    """(r, n, most, token) of the n-grams that are in several prefixes. Those that the sketch does not take for common
    are in less sets than its last count, so their rows may meet; the others are counted before they meet."""
    each = entries.select("r", "rare", (F.col("n") - F.col("single")).alias("left"), F.posexplode("prefix").alias("i", "token"))
    each = each.select("r", (F.col("left") - F.col("i")).alias("most"), "token", (F.col("i") < F.col("rare")).alias("rare"))
    alike = F.count(F.lit(1)).over(Window.partitionBy("token"))
    several = each.filter("rare").select("r", "most", "token").withColumn("df", alike).filter("df > 1").select("r", "most", "token")
    common = each.filter("not rare").select("r", "most", "token")
    found = several.unionByName(common.join(common.groupBy("token").count().filter("count > 1"), "token", "left_semi"))
    return found.join(entries.select("r", "n"), "r").select("r", "n", "most", "token")


def jaccard_components(docs: DataFrame, k: int = GRAM, percent: int = PERCENT, bits: int = SKETCH_BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, ``_h``, and ``_c``,
    the least row of the component.

    Words are lower-cased in A-Z. A text with fewer than ``k`` words is one
    n-gram of all its words; without words, or null, it is empty and linked
    with nothing, not even with another empty text. Rows with equal sets are
    linked, repeated rows too. Null ids count as the largest; the component of a
    row without id that is linked with nothing is null. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = identified(docs)
    keyed = keep(rows.mapInArrow(lambda it: _set_keys(it, k), SET), "sets")
    classes = keep(keyed.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("_id", "_h")).alias("rep")), "classes")
    seen = spark.sparkContext.broadcast(sketch.build(rows.select("text"), _gram_batches(k), bits, OFTEN))
    open_sets = rows.mapInArrow(lambda it: _entries(it, k, percent, seen), ENTRY)
    reps = classes.select("rep._id", "rep._h")
    # A class is named by the place of its representative, so that ids may repeat.
    entries = keep(open_sets.dropDuplicates(["_id", "_h"]).join(reps, ["_id", "_h"]).withColumn("r", F.monotonically_increasing_id()), "entries")
    names = entries.select("r", "_id", "_h")
    postings = keep(shared_postings(entries), "postings")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the n-grams of the texts of those that may."""
        likely = keep(hopeful(pairs, entries, percent), "pairs")
        asked = names.join(likely.select(F.explode(F.array("a", "b")).alias("r")).distinct(), "r", "left_semi")
        cell = F.pmod(F.xxhash64("_id", "_h"), F.lit(1 << CELL_BITS)).alias("cell")
        wanted = spark.sparkContext.broadcast(_cells(asked.select(cell)))
        again = rows.select("*", cell).mapInArrow(lambda it: _fragments(it, k, seen, wanted), GRAMS)
        cut = keep(again.dropDuplicates(["_id", "_h"]).join(asked, ["_id", "_h"]).select("r", "n", "grams"), "grams")
        wanted.destroy()
        return verified(likely, cut, percent)

    # First round: every row against the least altered row of its n-gram.
    best = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.max(F.struct((F.col("most") / F.col("n")).alias("u"), "r", "n", "most")).alias("p")
    ).filter("df > 1").drop("df")
    star = postings.select("token", F.struct("r", "n", "most").alias("q")).join(best, "token").filter("q.r != p.r")
    sizes = F.least("q.n", "p.n") * 100 >= F.greatest("q.n", "p.n") * percent
    star = star.filter(sizes & _possible("q", "p", percent)).select(F.least("q.r", "p.r").alias("a"), F.greatest("q.r", "p.r").alias("b"))
    near = keep(linked(star.distinct()), "links")
    label = components(near)
    # Second round: what is still apart.
    labelled = postings.join(label, F.col("r") == F.col("node"), "left").select(
        "token", "r", "n", "most", F.coalesce("component", "r").alias("comp")
    )
    links = keep(near.union(linked(crossing(labelled, percent, block))), "links")
    # Executors keep a broadcast on their disks; it is not needed any more.
    seen.destroy()
    # Back to rows: a component is named by the least row of its classes.
    label = components(links)
    member = names.join(label, F.col("r") == F.col("node"), "left").select(F.struct("_id", "_h").alias("rep"), F.coalesce("component", "r").alias("c"))
    least = member.groupBy("c").agg(F.min("rep").alias("least"))
    moved = member.join(least, "c").filter("rep != least").select("rep", "least")
    named = classes.join(moved, "rep", "left").select("n", "k1", "k2", F.coalesce("least", "rep").alias("_c"))
    full = keyed.filter("n > 0").join(named, ["n", "k1", "k2"]).select("_id", "_h", "n", "_c")
    out = full.union(keyed.filter("n = 0").select("_id", "_h", "n", F.struct("_id", "_h").alias("_c")))
    return out.select(
        id_or_null().alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), id_or_null("_c._id").alias("component_id"), "_h", "_c"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("_h", "_c")


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
    SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), r AS (
    SELECT doc_id AS a, doc_id AS c FROM w
    UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
