"""Paragraph units, greedy packing with one unit of overlap, chunk assembly.

Packing is a sequential fold over the units of one document. It is done as a
segmented scan: units are sorted, and a task walks through many documents in one
pass. A document longer than a block is dealt to several tasks; each block tells
where a chunk that starts in it would leave it, and these hops are chained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from veritrace.functions import text as tx
from veritrace.operators.ingest import running_totals
from veritrace.session import materialize

# Units of a document that one task takes at once, with their texts.
BLOCK_UNITS = 32_768


def paragraph_units(pages: DataFrame, sep: str = tx.PARAGRAPH_SEP) -> DataFrame:
    """Units of every document, its non-blank paragraphs: (document_id, unit_no,
    page_number, text, char_start, char_end, words, tokens). Offsets are in the page
    texts joined by a blank line; units are numbered from 0 in page order."""
    body = F.coalesce(F.col("text"), F.lit(""))
    solid = lambda parts: F.transform(parts, lambda p: ~tx.is_blank(p))
    # Stored, as both halves of the totals read it.
    sized = materialize(pages.select(
        "document_id", "page_number", F.length(body).alias("n_chars"),
        F.size(F.filter(solid(F.split(body, sep, -1)), lambda yes: yes)).alias("n_units"),
    ), "pages")
    placed = running_totals(
        sized, "document_id", "page_number", {"char_base": F.col("n_chars") + 2, "unit_base": F.col("n_units")}
    ).select("document_id", "page_number", "char_base", "unit_base")
    # Within a page, its one row gives the places; the texts stay where they are.
    cut = pages.join(placed, ["document_id", "page_number"]).select(
        "document_id", "page_number", "char_base", "unit_base", F.split(body, sep, -1).alias("parts"),
        F.regexp_extract_all(body, F.lit(sep), 0).alias("seps"),
    )
    wide = F.zip_with("parts", "seps", lambda p, s: F.length(p) + F.coalesce(F.length(s), F.lit(0)))
    ready = cut.withColumn("solid", solid(F.col("parts"))).withColumns({"start": _sum_before(wide), "nth": _sum_before(F.transform("solid", lambda y: y.cast("int")))})
    rows = F.filter(F.arrays_zip(F.col("parts").alias("text"), "solid", "start", "nth"), lambda u: u["solid"])
    units = ready.select("document_id", "page_number", "char_base", "unit_base", F.inline(rows))
    return units.select(
        "document_id", (F.col("unit_base") + F.col("nth")).alias("unit_no"), "page_number", "text",
        (F.col("char_base") + F.col("start")).alias("char_start"),
        (F.col("char_base") + F.col("start") + F.length("text")).alias("char_end"),
        tx.word_count(F.col("text")).alias("words"),
    ).withColumn("tokens", tx.tokens_of(F.col("words")))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sum_before(values: pd.Series) -> pd.Series:
    """For each place of a list the sum of the numbers before it."""
    return pd.Series([np.cumsum(v, dtype=np.int64) - v for v in values], dtype=object)


def _next_starts(tokens: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For each unit the one that opens the next chunk when this one opened a
    chunk as overlap; -1 where the chunk runs to the end. Units of several
    groups follow each other; ``ends`` has the end of each one's group.

    An overlap unit s always takes s+1 along; after that the chunk closes
    before the first unit j >= s+2 that would exceed the budget, and unit j-1
    opens the next.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    s = np.arange(len(tokens))
    j = np.searchsorted(total, total[s] + budget, side="right") - 1
    j = np.maximum(j, s + 2)
    return np.where(j >= ends, -1, j - 1)


def _exits(pdf: pd.DataFrame, budget: int, block: int) -> pd.DataFrame:
    """For each place where a chunk may enter a block: where it leaves the block, and after how many chunks."""
    pdf = pdf.sort_values("at")
    base = int(pdf["block"].iloc[0]) * block
    real = int((pdf["at"] < base + block).sum())
    tokens = pdf["tokens"].to_numpy(np.int64)
    out = _next_starts(tokens, np.full(len(tokens), len(tokens)), budget)[:real]
    steps = np.ones(real, dtype=np.int64)
    # Each step doubles the hops, until every unit has left the block.
    while (stay := np.flatnonzero((out >= 0) & (out < real))).size:
        steps[stay] += steps[out[stay]]
        out[stay] = out[out[stay]]
    # A chunk from an earlier block enters within the first units.
    entry = np.arange(1 if base == 0 else min(real, budget + 4))
    return pd.DataFrame({
        "document_id": _same(pdf, len(entry)), "entry": entry + base,
        "leave": np.where(out[entry] < 0, -1, out[entry] + base), "steps": steps[entry],
    })


def _chain(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Where each block of a document is entered, and how many chunks come before."""
    leave = dict(zip(pdf["entry"], zip(pdf["leave"], pdf["steps"])))
    at, number, seen = 0, 0, []
    while at >= 0:
        seen.append((at // block, at, number))
        at, steps = leave[at]
        number += steps
    blocks, entries, numbers = zip(*seen)
    return pd.DataFrame({"document_id": _same(pdf, len(seen)), "block": blocks, "entry": entries, "number": numbers})


def _same(pdf: pd.DataFrame, n: int) -> pd.Series:
    """The document's id, n times, with no dtype of its own."""
    return pd.Series([pdf["document_id"].iloc[0]] * n, dtype=object)


def _walk(batches: Iterator[pa.RecordBatch], budget: int, block: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows sorted by document, block and place. Borders of documents
    are walked over within a task; a row of place -1 tells where its block is entered."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return batch["document_id"][row], batch["block"][row]

    def borders(rows: pa.RecordBatch) -> np.ndarray:
        new = [pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy(zero_copy_only=False) for c in ("document_id", "block")]
        return np.concatenate([[0], np.flatnonzero(new[0] | new[1]) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.num_rows - 1
        if key(held[0], 0) == key(batch, last):
            continue
        rows = pa.concat_batches(held)
        begins = borders(rows)
        yield _chunks(rows.slice(0, begins[-1]), begins, budget, block)
        held = [rows.slice(begins[-1])]
    if held:
        rows = pa.concat_batches(held)
        yield _chunks(rows, np.append(borders(rows), rows.num_rows), budget, block)


def _chunks(rows: pa.RecordBatch, begins: np.ndarray, budget: int, block: int) -> pa.RecordBatch:
    """The chunks of whole groups, which begin at the places ``begins`` (the last is the end)."""
    blocks, places, tokens, numbers = (rows[c].to_numpy() for c in ("block", "at", "tokens", "number"))
    ends = np.repeat(begins[1:], np.diff(begins))
    hop = _next_starts(np.where(places < 0, 0, tokens), ends, budget)
    opened, closed, number = [], [], []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        marked = places[a] < 0
        first, base = a + int(marked), int(blocks[a]) * block
        if marked:
            at, n = first + int(tokens[a]) - base, int(numbers[a])
        elif base:
            continue
        else:
            at, n = first, 0
        real = first + int(np.searchsorted(places[first:b], base + block))
        while 0 <= at < real:
            opened.append(at)
            at = int(hop[at])
            closed.append(b - 1 if at < 0 else at)
            number.append(n)
            n += 1
    opened, closed = np.array(opened, dtype=np.int64), np.array(closed, dtype=np.int64)
    # The empty unit before a document opens its first chunk.
    first = opened + (places[opened] == 0)
    out = {
        "document_id": rows["document_id"].take(pa.array(first)), "chunk_no": pa.array(np.array(number, dtype=np.int32)),
        "first_unit": pa.array(places[first] - 1), "last_unit": pa.array(places[closed] - 1),
    }
    if "text" in rows.schema.names:
        sizes = closed + 1 - first
        ends = np.cumsum(sizes)
        chunk = np.repeat(np.arange(len(first)), sizes)
        place = np.arange(len(chunk)) - np.repeat(ends - sizes, sizes) + first[chunk]
        texts = rows["text"].take(pa.array(place))
        pages = pc.fill_null(rows["page_number"], 0).to_numpy()
        lengths, words = (np.concatenate([[0], np.cumsum(pc.fill_null(c, 0).to_numpy().astype(np.int64))]) for c in (pc.utf8_length(rows["text"]), rows["words"]))
        # The first unit of a chunk, and each that begins a page in it.
        turns = np.flatnonzero((place == first[chunk]) | (pages[place] != pages[place - 1]))
        at = lengths[place[turns]] - lengths[first[chunk[turns]]] + 2 * (place[turns] - first[chunk[turns]])
        starts = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(pages[place[turns]].astype(np.int32))], ["at", "page_number"])
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
        out |= {
            "page_start": rows["page_number"].take(pa.array(first)), "page_end": rows["page_number"].take(pa.array(closed)),
            "text": pc.binary_join(lists(ends, texts), "\n\n"), "char_start": rows["char_start"].take(pa.array(first)),
            "char_end": rows["char_end"].take(pa.array(closed)), "unit_pages": lists(np.searchsorted(turns, ends), starts),
            "words": pa.array((words[closed + 1] - words[first]).astype(np.int32)),
        }
    return pa.RecordBatch.from_pydict(out)


def _packed(units: DataFrame, budget: int, block: int) -> DataFrame:
    """Chunks of units (document_id, unit_no, tokens, and maybe page_number,
    text, char_start, char_end, words), by a segmented scan.

    Units are dealt by document and block and sorted; a task walks through its
    documents one after the other, so a document costs no call of its own. Only
    documents that reach into a second block need to know where each
    of their blocks is entered: every possible entry of a block has an exit, and these are chained.

    Every unit counts at least one token, so a chunk spans at most ``budget`` +
    2 units; a block plus that many units of the following ones decides every
    chunk that starts in the block.

    Positions are unit numbers plus one: position 0 is an empty unit put before
    each document, so that the first chunk follows the same rule as the others.
    """
    halo = budget + 4
    # Dear, and read by each of the steps below.
    units = materialize(units, "units")
    more = [c for c in ("page_number", "text", "char_start", "char_end", "words") if c in units.columns]
    kinds = dict(units.dtypes)
    row = lambda at, tokens, value: F.struct(
        at.cast("long").alias("at"), tokens.cast("int").alias("tokens"), F.lit(0).cast("long").alias("number"), *(value(c).alias(c) for c in more)
    )
    unit = row(F.col("unit_no") + 1, F.col("tokens"), F.col)
    nothing = lambda c: F.lit(None).cast(kinds[c])
    head = row(F.lit(0), F.lit(0), nothing)
    placed = units.select("document_id", F.inline(F.when(F.col("unit_no") == 0, F.array(head, unit)).otherwise(F.array(unit))))
    # Units near the head of a block are also shown to the blocks before it.
    blocks = placed.withColumn(
        "block",
        F.explode(F.sequence(F.greatest(F.floor((F.col("at") - halo) / block), F.lit(0)), F.floor(F.col("at") / block))),
    )
    long = units.filter(F.col("unit_no") >= block - 1).select("document_id").distinct()
    crossing = blocks.select("document_id", "block", "at", "tokens").join(long, "document_id", "left_semi")
    entries = (
        crossing.groupBy("document_id", "block")
        .applyInPandas(lambda pdf: _exits(pdf, budget, block), f"document_id {kinds['document_id']}, entry long, leave long, steps long")
        .groupBy("document_id")
        .applyInPandas(lambda pdf: _chain(pdf, block), f"document_id {kinds['document_id']}, block long, entry long, number long")
    )
    marks = entries.select(
        "document_id", F.lit(-1).cast("long").alias("at"), F.col("entry").cast("int").alias("tokens"), "number",
        *(nothing(c).alias(c) for c in more), "block",
    )
    met = blocks.unionByName(marks).repartition("document_id", "block").sortWithinPartitions("document_id", "block", "at")
    columns = f"document_id {kinds['document_id']}, chunk_no int, first_unit long, last_unit long"
    if more:
        columns += (
            ", page_start int, page_end int, text string, char_start long, char_end long, unit_pages array<struct<at:int,page_number:int>>, words int"
        )
    return met.mapInArrow(lambda it: _walk(it, budget, block), columns)


def pack_units(units: DataFrame, budget: int = tx.MAX_CHUNK_TOKENS, block: int = BLOCK_UNITS) -> DataFrame:
    """Chunk ranges (document_id, first_unit, last_unit) for any number of
    units per document. Needs only document_id, unit_no and tokens; unit
    numbers are dense from 0."""
    return _packed(units.select("document_id", "unit_no", "tokens"), budget, block).drop("chunk_no")


def build_chunks(
    pages: DataFrame, budget: int = tx.MAX_CHUNK_TOKENS, sep: str = tx.PARAGRAPH_SEP, block: int = BLOCK_UNITS
) -> DataFrame:
    """Chunks of (document_id, page_number, text) pages.

    Returns (document_id, chunk_no, first_unit, last_unit, page_start,
    page_end, text, char_start, char_end, unit_pages, token_count). ``token_count`` is
    estimated on the joined text, which differs from the sum over its units.
    ``unit_pages`` tells where in the text each page begins.
    """
    units = paragraph_units(pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text"), sep)
    # Units are joined by whitespace, so their words add up.
    return _packed(units, budget, block).withColumn("token_count", tx.tokens_of(F.col("words"))).drop("words")


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Left join on the chunk id; a chunk without a vector keeps NULL."""
    return chunks.join(vectors.select(key, "embedding"), key, "left")


def embed_chunks(chunks: DataFrame, embed) -> DataFrame:
    """Embeds in place: the vector follows its row, so no join is needed."""
    return chunks.withColumn("embedding", embed(F.col("text")))


__all__ = [
    "attach_embeddings", "build_chunks", "embed_chunks", "pack_units", "paragraph_units",
]
