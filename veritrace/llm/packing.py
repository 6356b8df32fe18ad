"""Best-fit packing of token sequences by matching large items.

Texts are tokenised whole; what is longer than the capacity is cut. Packing needs
only how many pieces there are of each length, so the plan is made on that
histogram: at most ``capacity`` rows, whatever the input. Pieces longer than a
third of the capacity come first: at most two fit in a sequence, and each is
matched with the longest partner that still fits. Shorter pieces, longest first,
go to the sequence whose gap they fill best. Equal pieces and equal sequences
are handled in bulk, so the plan is a short list of runs: "pieces number i to j
of length s go to sequences from q on, k in each". Pieces are numbered within
their length by a distributed count and look up their run.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrace.llm.base import id_or_null, identified, keep, number_within, table
from veritrace.llm.words import column, pieces

CAPACITY, END_ID = 4096, 1
#: Words whose ids a task remembers; it only saves time.
REMEMBERED = 1 << 20
PIECES = "_id long, _h long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whole texts, word by word, each distinct word once.

    The tokenizer drops white space and never joins what it parts, lower-cases,
    and parts a letter from a full stop or comma, so texts may be lower-cased and cut
    there before. Texts with a control string of its own, which must keep its
    case, are only cut at white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        self.control = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        # Where the ids of word number i begin; the last entry is where free room begins.
        self.begins = np.zeros(1 << 18, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        code = self.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(code.ids, dtype=np.uint32)
        owner = np.array(code.word_ids, dtype=np.int64)
        known, used = len(self.seen), int(self.begins[len(self.seen)])
        for name, need in (("ids", used + len(ids)), ("begins", known + len(words) + 1)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), need - len(held)), dtype=held.dtype)]))
        self.ids[used : used + len(ids)] = ids
        self.begins[known + 1 : known + len(words) + 1] = used + np.cumsum(np.bincount(owner, minlength=len(words)))
        self.seen.update(zip(words, range(known, known + len(words))))

    def _words(self, texts: pa.Array) -> pa.Array:
        own = pc.match_substring(texts, self.control[0])
        for control in self.control[1:]:
            own = pc.or_(own, pc.match_substring(texts, control))
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,])", r"\1 \2")
        if pc.any(own).as_py():
            kept = zip(own.to_pylist(), texts.to_pylist(), cut.to_pylist())
            cut = pa.array([t if o else c for o, t, c in kept], pa.large_string())
        return pc.ascii_split_whitespace(cut)

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text with the end id."""
        if len(self.seen) > REMEMBERED:
            self._reset()
        lists = self._words(texts)
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.seen])
        place = np.array([self.seen[w] for w in words], dtype=np.int64)
        word = place[flat.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
        first = self.begins[word]
        size = self.begins[word + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.append(ids[a:b], np.uint32(END_ID))


@lru_cache(maxsize=1)
def _known(path: str) -> WordIds:
    """Kept by a worker from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every text: the ids of its words, then the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for batch in batches:
            for at, end, buf, offsets in pieces(batch["text"]):
                part = batch.slice(at, end - at)
                out = defaultdict(list)
                for key, h, ids in zip(part["_id"].to_pylist(), part["_h"].to_pylist(), known.texts(column(buf, offsets))):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        crc = zlib.crc32(own.astype("<u4").tobytes())
                        for name, value in zip(("_id", "_h", "piece", "start", "length", "ids_crc32"), (key, h, piece, start, len(own), crc)):
                            out[name].append(value)
                types = {"piece": pa.int32()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return identified(docs).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first piece, pieces, first sequence, pieces in each, offset)."""
    left = {s: n for s, n in histogram.items() if n}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    runs, sequences = [], 0

    def put(size: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((size, used[size], pieces, first, each, offset))
        used[size] += pieces
        left[size] -= pieces

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    partner = np.zeros(capacity + 1, dtype=bool)
    partner[large] = True
    for size in large:
        while left[size]:
            fitting = np.flatnonzero(partner[: min(size, capacity - size) + 1])
            if len(fitting) and fitting[-1] == size and left[size] < 2:
                fitting = fitting[:-1]
            mate = int(fitting[-1]) if len(fitting) else None
            if mate is None:
                n = left[size]
                put(size, n, sequences, 1, 0)
                gaps[capacity - size].append((sequences, n))
            elif mate == size:
                n = left[size] // 2
                put(size, 2 * n, sequences, 2, 0)
                gaps[capacity - 2 * size].append((sequences, n))
            else:
                n = min(left[size], left[mate])
                put(size, n, sequences, 1, 0)
                put(mate, n, sequences, 1, size)
                gaps[capacity - size - mate].append((sequences, n))
            sequences += n
            if mate is not None:
                partner[mate] = left[mate] > 0
        partner[size] = False
    open_gap = np.zeros(capacity + 1, dtype=bool)
    for gap in gaps:
        open_gap[gap] = True
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = int(np.argmax(open_gap[size:]))
            if open_gap[size + at]:
                gap = size + at
                first, n = gaps[gap].pop()
                open_gap[gap] = bool(gaps[gap])
            else:
                gap, each = capacity, capacity // size
                first, n = sequences, -(-left[size] // each)
                sequences += n
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                put(size, full * each, first, each, capacity - gap)
                gaps[gap - each * size].append((first, full))
                open_gap[gap - each * size] = True
            if full < n:
                rest = left[size]
                if rest:
                    put(size, rest, first + full, rest, capacity - gap)
                    gaps[gap - rest * size].append((first + full, 1))
                    open_gap[gap - rest * size] = True
                if full + bool(rest) < n:
                    gaps[gap].append((first + full + bool(rest), n - full - bool(rest)))
                    open_gap[gap] = True
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that agree in id and text
    are packed one by one; which of their equal pieces goes where is not fixed. An
    empty table gives no rows. Sequences are numbered from 0 without gaps.
    """
    spark = docs.sparkSession
    rows = keep(token_pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, capacity)
    by_size: dict[int, np.ndarray] = {}
    grouped = defaultdict(list)
    for size, *run in runs:
        grouped[size].append(run)
    for size, own in grouped.items():
        by_size[size] = np.array(own, dtype=np.int64)
    # Bounded by the lengths there can be, not by the input.
    shared = spark.sparkContext.broadcast(by_size)
    numbered = number_within(rows, ["length"], ["_id", "_h", "piece"], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                table_ = shared.value[int(s)]
                run = table_[np.searchsorted(table_[:, 0], rank[rows], side="right") - 1]
                nth = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + nth // run[:, 3]
                offset[rows] = run[:, 4] + nth % run[:, 3] * s
            cols = [batch[c] for c in ("_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(sequence), pa.array(offset)],
                names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = numbered.mapInArrow(place, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(id_or_null().alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
